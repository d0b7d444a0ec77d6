"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Plain texts, those without two white spaces in a row or a special token's string, go through
tiktoken's merge loop over the same vocabulary, several times as fast; for them the look-ahead in the
usual splitting pattern changes nothing and is left out. All others go through ``tokenizers`` itself.
The tests hold the two equal."""

from __future__ import annotations

import json
import re

import numpy as np

_PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Longer texts are encoded in stretches that end before a space, where a new piece starts anyway.
STRETCH = 1 << 20


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the rest as characters from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = [t["content"] for t in described.get("added_tokens", [])]
        of = _byte_of_symbol()
        ranks = {bytes(of[c] for c in token): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.plain = tiktoken.Encoding(path, pat_str=_PLAIN_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("|".join([r"\s\s", *map(re.escape, special)]))

    def encode(self, text: str) -> np.ndarray:
        """The ids, without special tokens added."""
        if self.other.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) <= STRETCH:
            return np.array(self.plain.encode_ordinary(text), "<u4")
        parts, start = [], 0
        while start < len(text):
            end = len(text) if len(text) - start <= STRETCH else text.rfind(" ", start + 1, start + STRETCH)
            end = end if end > start else len(text)
            parts.append(np.array(self.plain.encode_ordinary(text[start:end]), "<u4"))
            start = end
        return np.concatenate(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
