"""Language identification by cross-parsing against suffix automata.

A text is parsed into the longest phrases that occur in a language's training text, phrase after
phrase, by walking that text's suffix automaton; the language that needs the fewest phrases, normalised
by what a pointer into its training text costs, wins (Ziv and Merhav 1993). A letter that a language
lacks is a phrase of its own there. All letters are told apart, in any script.

Texts are cut into blocks that are parsed side by side in NumPy, one symbol of each at a time. Each
block is first parsed as if a phrase started with it; then it is entered again with the state in which
the block before ends, until both ways start a phrase at the same place, from where on they are one.
That is repeated while the end of a block changes, so the counts are those of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tubal.llm.common import map_batches

#: Training bounds: so many documents of each language, and so many characters of each document.
TRAIN_DOCS = 64
TRAIN_CHARS = 1000
#: Characters of all languages together; with many languages each gets less.
TRAIN_TOTAL = 1 << 19
BLOCK = 512
UNKNOWN = "und"


def training_sample(docs: DataFrame, seed: int = 11, docs_per_language: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> DataFrame:
    """``lang, piece``: an excerpt of bounded length from a bounded number of documents per language,
    chosen by hash: for each language and bucket of hashes the document with the smallest hash."""
    order = F.xxhash64(F.lit(seed), "doc_id")
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text", order.alias("order"))
    chosen = pool.groupBy("lang", F.pmod("order", F.lit(docs_per_language)).alias("bucket")).agg(F.min("order").alias("order"))
    chosen = chosen.select(F.col("lang").alias("lang_"), F.col("order").alias("order_"))
    picked = pool.join(F.broadcast(chosen), (F.col("lang") == F.col("lang_")) & (F.col("order") == F.col("order_")))
    at = F.pmod(F.xxhash64("order"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    return picked.select("lang", "order", F.col("text").substr(at.cast("int"), F.lit(chars)).alias("piece")).groupBy("lang", "order").agg(F.min("piece").alias("piece"))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Moves of each state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Moves:
    """The moves of an automaton in a hash table of arrays, a quarter full, whatever the number of letters."""

    def __init__(self, moves: list[dict[int, int]], symbols: int):
        self.dead = len(moves)  # a state without moves: after a letter that no phrase has, and before a text
        self.symbols = np.int64(symbols)
        self.start = np.full(symbols, self.dead, np.int64)
        self.start[list(moves[0])] = list(moves[0].values())
        keys = np.array([s * symbols + c for s, m in enumerate(moves) for c in m], np.int64)
        to = np.array([t for m in moves for t in m.values()], np.int64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.to[at[free]] = keys[free], to[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, to, at = keys[rest], to[rest], (at[rest] + 1) & self.last

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase starts with the symbol."""
        keys = state * self.symbols + symbol
        at = self._slots(keys)
        there = self.keys[at]
        out, starts = self.to[at], there != keys
        look = np.flatnonzero(starts & (there >= 0))
        while len(look):
            at = (at[look] + 1 if len(at) == len(keys) else at + 1) & self.last
            there = self.keys[at]
            hit = there == keys[look]
            out[look[hit]], starts[look[hit]] = self.to[at[hit]], False
            go = ~hit & (there >= 0)
            look, at = look[go], at[go]
        out[starts] = self.start[symbol[starts]]
        return out, starts


class Parser:
    """Phrase counts of texts for every language. ``training`` maps a language to its pieces."""

    def __init__(self, training: dict[str, list[str]]):
        self.languages = sorted(training, key=lambda x: x.encode())
        folded = {k: " ".join(v).lower() for k, v in training.items()}
        # Symbols: 0 anything but letters, 1 letters that no training text has, 2.. the others.
        known = sorted({c for t in folded.values() for c in t if c.isalpha()})
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
        for i, c in enumerate(known):
            for x in (c, c.upper(), c.title()):
                if len(x) == 1:
                    self.symbol[ord(x)] = i + 2
        self.moves, self.costs = [], []
        for language in self.languages:
            symbols = self.fold(folded[language])
            self.moves.append(Moves(suffix_automaton(symbols.tolist()), len(known) + 2))
            self.costs.append(math.log2(max(len(symbols), 1) + 1))

    def fold(self, text: str) -> np.ndarray:
        """Symbols of the text, runs of anything but letters as one."""
        s = self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def phrases(self, texts: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
        """Phrases that each language needs for each text of symbols."""
        blocks = np.array([-(-len(t) // block) for t in texts])
        rows = np.repeat(np.arange(len(texts)), blocks)
        grid = np.zeros((len(rows), block), np.int32)
        at = (np.cumsum(blocks) - blocks) * block
        for t, a in zip(texts, at, strict=True):
            grid.reshape(-1)[a : a + len(t)] = t
        # Blocks in falling order of length, so that at each step the first so many go on.
        length = np.full(len(rows), block)
        ends = np.cumsum(blocks) - 1
        length[ends] = np.array([len(t) for t in texts]) - (blocks - 1) * block
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        steps, length, rows_of = np.ascontiguousarray(grid[order].T).astype(np.int64), length[order], rows[order]
        after = np.where(np.r_[rows[1:] == rows[:-1], False], np.r_[place[1:], 0], -1)[order]  # the block that follows in its text
        active = np.searchsorted(-length, -np.arange(block), "left")
        out = np.zeros((len(texts), len(self.languages)))
        for k, moves in enumerate(self.moves):
            started = np.zeros((block, len(rows)), bool)
            state = np.full(len(rows), moves.dead, np.int64)
            for t, (c, n) in enumerate(zip(steps, active, strict=True)):
                state[:n], started[t, :n] = moves.step(state[:n], c[:n])
            count, last = started.sum(axis=0), state
            into = after[after >= 0]
            entry = last[after >= 0]
            while len(into):
                changed, ends = self._entered(moves, into, entry, steps, length, started, count)
                last[changed] = ends
                go = after[changed] >= 0
                into, entry = after[changed][go], ends[go]
            out[:, k] = np.bincount(rows_of, count, len(texts))
        return out

    @staticmethod
    def _entered(moves: Moves, into: np.ndarray, state: np.ndarray, steps: np.ndarray, length: np.ndarray, started: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parses blocks ``into`` from given states until they meet what was found before, and corrects
        ``started`` and ``count``. Returns the blocks whose end is another now, and their last states."""
        t, done, ends = 0, [], []
        while len(into):
            over = length[into] <= t
            done.append(into[over])
            ends.append(state[over])
            into, state = into[~over], state[~over]
            if not len(into):
                break
            state, starts = moves.step(state, steps[t, into])
            before = started[t, into]
            started[t, into] = starts
            count[into] += starts.astype(np.int64) - before
            apart = ~(starts & before)
            into, state, t = into[apart], state[apart], t + 1
        return np.concatenate([np.empty(0, np.int64), *done]), np.concatenate([np.empty(0, np.int64), *ends])

    def predict(self, texts: list[str | None], batch: int = 1 << 22) -> tuple[list[str], list[float]]:
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        waiting, size = [], 0

        def judge():
            counts = self.phrases([s for _, s in waiting])
            for (i, s), row in zip(waiting, counts, strict=True):
                cost = row * self.costs / len(s)
                order = np.argsort(cost, kind="stable")
                languages[i] = self.languages[order[0]]
                scores[i] = 1.0 if len(order) == 1 else float(1 - cost[order[0]] / cost[order[1]])

        for i, text in enumerate(texts):
            s = self.fold(text or "")
            if self.languages and s.any():
                waiting.append((i, s))
                size += len(s)
                if size >= batch:
                    judge()
                    waiting, size = [], 0
        if waiting:
            judge()
        return languages, scores


_parsers: dict[int, Parser] = {}


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", total: int = TRAIN_TOTAL) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs``, from the rows ``lang, piece`` of ``training``,
    which are bounded (``training_sample``) and sent to all workers.

    ``und`` with score 0 where the text is null or has no letter, or nothing is learned. Ties go to the
    language first in code point order. The score is 1 less the ratio of the best to the second-best
    cost. Texts of any length are parsed whole. Repeated rows are each answered; an empty table gives no rows; other columns are ignored."""
    pieces: dict[str, list[str]] = {}
    for r in training.orderBy("lang", "order").collect():
        pieces.setdefault(r.lang, []).append(r.piece)
    most = total // max(1, len(pieces))
    bounded = {}
    for k, v in pieces.items():
        kept, n = [], 0
        for p in v:
            if kept and n + len(p) > most:
                break
            kept.append(p)
            n += len(p)
        bounded[k] = kept
    key = hash(tuple((k, tuple(v)) for k, v in sorted(bounded.items())))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(bounded)
        found, scores = _parsers[key].predict(batch.column(1).to_pylist())
        yield pa.record_batch([batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
