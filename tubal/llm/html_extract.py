"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page.

Features are the blocks' ancestor tags, what the words of all their ancestors' classes and ids name, the three-letter
parts of those words, and the shape of the text.
The field is trained by maximum likelihood on labelled pages and decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import map_batches
from tubal.llm.html_blocks import Block, bits_of, blocks_of, parts_of
from tubal.llm.html_pages import labelled_pages

def features(block: Block, place: int, count: int, known: int = -1) -> list[str]:
    """Of the parts of names only those in ``known`` (bits); by default all."""
    at = block.place
    out = ["bias", f"own={at.tag}", *(f"in={t}" for t in at.around)]
    out += [f"name={g}" for g in at.groups]
    if at.groups - {"content"}:
        out.append("name=aside-of-text")
    out += [f"part={p}" for p in parts_of(at.parts & known)]
    words = block.text.count(" ") + 1
    out.append("words=" + ("1" if words == 1 else "2-4" if words < 5 else "5-9" if words < 10 else "10-24" if words < 25 else "25-79" if words < 80 else "80+"))
    share = block.link_chars / len(block.text)
    out.append("links=" + ("none" if share == 0 else "some" if share < 0.3 else "many" if share < 0.8 else "all"))
    if block.text[-1] in ".!?…\"'”»:":
        out.append("ends")
    if "©" in block.text or "\N{COPYRIGHT SIGN}" in block.text:
        out.append("copyright")
    if place == 0:
        out.append("first")
    if place == count - 1:
        out.append("last")
    return out


class Extractor:
    """Two labels: 0 other, 1 article. ``weights`` has a pair per feature, ``moves`` the transitions."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves
        self.known = 0
        for f in weights:
            if f.startswith("part="):
                self.known |= bits_of(f.removeprefix("part="))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        n, none = len(blocks), (0.0, 0.0)
        (m00, m01), (m10, m11) = self.moves
        back, a, b = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            pairs = [self.weights.get(f, none) for f in features(block, i, n, self.known)]
            s0, s1 = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
            if i == 0:
                a, b = s0, s1
                continue
            to0, to1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((int(to0), int(to1)))
            a, b = (b + m10 if to0 else a + m00) + s0, (b + m11 if to1 else a + m01) + s1
        if not n:
            return []
        labels = [int(b > a)]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def text(self, html: str | None) -> str:
        blocks = blocks_of(html or "")
        return "\n".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def _examples(pages: list[list[tuple[str, int]]]) -> list[tuple[list[Block], list[int]]]:
    """Blocks of whole pages with the labels of the parts they come from."""
    out = []
    for page in pages:
        labels = [y for part, y in page if y >= 0 for _ in blocks_of(part)]
        blocks = blocks_of("".join(part for part, _ in page))
        if len(blocks) == len(labels):
            out.append((blocks, labels))
    return out


def chain_sums(s: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chances of each block's labels and of each pair of neighbours' labels, and the logarithm of the sum over
    all labellings, by sums forwards and backwards over pages of ``s`` (page, block, label)."""
    longest, pairs = s.shape[1], there[:, 1:] & there[:, :-1]
    ahead, behind = np.zeros_like(s), np.zeros_like(s)
    ahead[:, 0] = s[:, 0]
    for t in range(1, longest):
        step = np.logaddexp(ahead[:, t - 1, :1] + moves[0], ahead[:, t - 1, 1:] + moves[1]) + s[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        nxt = s[:, t + 1] + behind[:, t + 1]
        step = np.logaddexp(nxt[:, :1] + moves[:, 0], nxt[:, 1:] + moves[:, 1])
        behind[:, t] = np.where(there[:, t + 1, None], step, 0)
    z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    p = np.exp(ahead + behind - z[:, None, None]) * there[..., None]
    joint = np.exp(ahead[:, :-1, :, None] + moves + (s + behind)[:, 1:, None, :] - z[:, None, None, None]) * pairs[..., None, None]
    return p, joint, z


def train(pages: list[list[tuple[str, int]]] | None = None, steps: int = 150, ridge: float = 0.05) -> Extractor:
    """Maximum likelihood with a ridge, by gradient steps with momentum on all pages at once."""
    examples = _examples(pages or labelled_pages())
    named: dict[str, int] = {}
    rows = [[[named.setdefault(f, len(named)) for f in features(b, i, len(blocks))] for i, b in enumerate(blocks)] for blocks, _ in examples]
    n, longest, width = len(rows), max(map(len, rows)), len(named)
    x = np.zeros((n, longest, width), np.float32)
    y = np.zeros((n, longest), int)
    there = np.zeros((n, longest), bool)
    for i, (page, (_, labels)) in enumerate(zip(rows, examples, strict=True)):
        for t, fs in enumerate(page):
            x[i, t, fs] = 1
        y[i, : len(labels)], there[i, : len(labels)] = labels, True
    truth = np.eye(2)[y] * there[..., None]
    pairs = there[:, 1:] & there[:, :-1]
    true_moves = np.einsum("nti,ntj->ij", truth[:, :-1] * pairs[..., None], truth[:, 1:])
    flat = x[there]
    true_counts = flat.T @ truth[there]
    w, moves = np.zeros((width, 2)), np.zeros((2, 2))
    vw, vm = np.zeros_like(w), np.zeros_like(moves)
    total = there.sum()
    for _ in range(steps):
        s = np.zeros((n, longest, 2))
        s[there] = flat @ w.astype(np.float32)
        p, joint, _ = chain_sums(s, moves, there)
        gw = (true_counts - flat.T @ p[there].astype(np.float32)) / total - ridge * w / width
        gm = (true_moves - joint.sum((0, 1))) / total - ridge * moves / width
        vw, vm = 0.9 * vw + gw, 0.9 * vm + gm
        w, moves = w + vw, moves + vm
    return Extractor({f: (float(w[i, 0]), float(w[i, 1])) for f, i in named.items()}, moves.tolist())


_trained: list[Extractor] = []


def default_extractor() -> Extractor:
    if not _trained:
        _trained.append(train())
    return _trained[0]


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), extractor: Extractor | None = None) -> DataFrame:
    """The columns ``keep``, ``text`` (main text; blocks in page order, joined by newlines) and ``n_chars``.

    A null or empty page, and one without article blocks, has an empty text. Markup may be cut off
    anywhere: an unfinished tag at the end is dropped. Pages of any length and depth are taken whole. Repeated rows are each answered; an empty table
    gives no rows; other columns are ignored."""
    model = extractor or default_extractor()
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [model.text(h) for h in batch.column(0).to_pylist()]
        yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return map_batches(pages.select(F.col(html_col).cast("string").alias("_html"), *keep), run, f"{kinds}, text string, n_chars long")
