import pytest

pytest.importorskip("tubal.llm")
