"""The corpus operators on small tables, against brute force, with nulls, empty and repeated rows."""

import collections
import hashlib
import itertools
import os
import re
import time
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tubal.llm import chat, embedding_dedup, exact_dedup, html_extract, langid, mixing, packing, quality, queries, simhash, simhash_wide, substring_dedup
from tubal.llm.common import maybe_among
from tubal.llm.components import connected_components
from tubal.llm.html_blocks import blocks_of
from tubal.llm.html_pages import labelled_pages
from tubal.llm.queries import tokenizer_path
from tubal.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size int, fp int"


def words(n, seed, vocabulary=500):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, vocabulary, n)]


def corpus():
    passage = words(60, 1)
    texts = [None, "", " \n\t ", "One", "one", " ".join(words(34, 2)), " ".join(words(90, 3)), " ".join(words(90, 3)), " ".join(["und"] * 80)]
    texts += [" ".join(words(40, 10 + k) + passage + words(30, 90 + k)) for k in range(4)]
    texts += [" ".join(words(3000, 5)), " ".join(words(300, 6)) + "\n" + " ".join(passage[:35]), " ".join(words(300, 6)[:-1] + ["other"]), "ÄÖ  ü\x0bx"]
    rows = [(i, t, "en", f"s{i % 3}", 0, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None), (3, "same id", "fr", None, 1, "y", 1, 2)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (1, 1), (20, 21), (22, 21), (None, 3)] + [(100, 101 + k) for k in range(50)] + [(k, k + 1) for k in range(200, 230)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20} | {100 + k: 100 for k in range(51)} | {k: 200 for k in range(200, 231)}
    assert got == want


def test_exact(docs, none):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = collections.defaultdict(list)
    for r in corpus():
        groups[r[1] or ""].append(r[0])
    assert len(rows) == len(corpus()) and sum(r.kept for r in rows) == len(groups)
    digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in rows:
        ids = digest[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


@pytest.mark.parametrize("chunk,held", [(None, None), (700, 8), (64, 2)])
def test_substring(docs, none, monkeypatch, chunk, held):
    if chunk:  # texts in stretches, groups in parts
        monkeypatch.setattr(substring_dedup, "_CHUNK", chunk)
        monkeypatch.setattr(substring_dedup, "_HELD", held)
    seqs = [(r[0], tokens(r[1])) for r in corpus()]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in seqs for i in range(len(w) - 34))
    want = []
    for doc_id, w in seqs:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((doc_id, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 300
    assert substring_dedup.remove_repeats(none).count() == 0


def test_stretches(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_CHUNK", 50)
    text = " \n".join(words(300, 3)).encode()
    for t in (text, text + b"  ", b"x" * 500 + b" " + text, b"", b" " * 300, text[:60]):
        want = np.flatnonzero(np.arange(len(t.split())) + 35 <= len(t.split()))
        got = [substring_dedup.Windows([t[a:b]], 35).start + first for a, b, first in substring_dedup.stretches(t, 35)]
        assert np.array_equal(np.sort(np.concatenate(got)), want)
    anchors = [(k, w) for k, (a, b, _) in enumerate(substring_dedup.stretches(text, 35)) for w in [substring_dedup.Windows([text[a:b]], 35)]]
    marks = np.unique(np.concatenate([((k << substring_dedup._LOCAL | w.anchor) << 2) + substring_dedup._OPEN for k, w in anchors]))
    settled, waiting = substring_dedup._starts_of(text, marks, 35)
    assert not len(settled) and np.array_equal(np.sort(waiting), np.arange(266))


def brute_print(text):
    w = [x for x in tokens("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    prints = [(r[0], brute_print(r[1])) for r in corpus()]
    low = {p: p for _, p in prints}
    for _ in low:
        for a in low:
            for b in low:
                if (a ^ b).bit_count() <= 4:
                    low[a] = low[b] = min(low[a], low[b])
    first = {}
    for i, p in prints:
        if i is not None:
            first[low[p]] = min(i, first.get(low[p], i))
    want = [(i, p - (1 << 64) if p >> 63 else p, first.get(low[p])) for i, p in prints]
    rows = simhash.simhash_components(docs).collect()
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in rows), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(none).count() == 0


def test_near_copies_without_usable_ids(spark):
    texts = [" ".join(words(80, k)) for k in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[3]), (7, texts[4]), (7, texts[4]), (None, texts[5]), (1, texts[5])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, texts.index(r.text)) for r in simhash_wide.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(None, 0), (None, 1), (7, 2), (3, 3), (7, 4), (1, 5)], key=str)


def _shuffled_bytes(spark) -> dict[int, int]:
    """Bytes that the latest stages of the session have written to shuffles."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty(30_000)
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_near_copies_shuffle_few_texts(spark):
    """Texts that are in no component and are not dropped stay where they are, also where no table is small enough to broadcast."""
    r = np.random.default_rng(31)
    texts = [" ".join(f"{x:016x}" for x in r.integers(0, 1 << 62, 1200)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + k, t + " more") for k, t in enumerate(texts[:10])] + [(None, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    size, usual, before = sum(len(t) for _, t in rows), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = sorted((x.doc_id, x.text) for x in simhash_wide.drop_near_copies(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert kept == list(enumerate(texts))
    written = [n for stage, n in _shuffled_bytes(spark).items() if stage > max(before, default=-1)]
    assert written and sum(written) < 0.4 * size


def test_maybe_among(spark):
    """No key is missed, few others pass, and nulls are values; a filter of few bits only passes more."""
    keys = spark.range(3000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("s")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 'none' AS s"))
    rows = spark.range(10_000).select(F.col("id").alias("a`b"), F.concat(F.lit("t"), "id").alias("t")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS `a``b`, 'none' AS t"))
    for most, passing in ((1 << 26, 0.1), (1 << 10, 0.2)):
        got = maybe_among(rows, [F.col("`a``b`"), F.col("t")], keys, [F.col("k"), F.col("s")], most).collect()
        assert len(got) == 10_001 and all(x["_maybe"] for x in got if x[0] is None or x[0] < 3000)
        assert sum(x["_maybe"] for x in got if x[0] is not None and x[0] >= 3000) < passing * 7000
    assert not maybe_among(rows, [F.col("t")], keys.limit(0), [F.col("s")]).where("_maybe").count()


def test_simhash_large_buckets(spark):
    r = np.random.default_rng(8)
    values = r.integers(0, 1 << 64, 400, np.uint64, endpoint=False)
    values = np.concatenate([values, [int(v) ^ (1 << int(a)) ^ (1 << int(b)) for v in values[:150] for a, b in [r.choice(64, 2, False)]], [(1 << 40) + k for k in range(300)]]).astype(np.uint64)
    values = np.unique(values)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = []
    for large in (1 << 20, 40, 3):
        found = connected_components(simhash.near_pairs(df, large=large)).collect()
        roots.append({x.node: x.component for x in found})
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    np.fill_diagonal(distance, 99)
    assert roots[0] == roots[1] == roots[2] and set(roots[0]) == set(values[(distance <= 4).any(1)].view(np.int64).tolist())


def test_embeddings(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((400, 16))
    near = np.concatenate([base[:40] + 0.05 * r.standard_normal((40, 16)), base[0] + 0.05 * r.standard_normal((120, 16)), base[5:8], np.repeat(base[:1], 90, 0)])
    vectors = np.concatenate([base, near])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [float("nan")] * 16), (9005, [None] * 16), (9006, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df, block=50).collect()}
    assert len(got) == len(rows)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (9001, 9002, 9003, 9004, 9005, 9006))
    assert got[None].n_links == 0 and got[400].component_id == 0 and not got[400].kept
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def brute_links(vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = [], []
    for i in range(0, len(unit), 1000):
        p, q = np.nonzero(unit[i : i + 1000] @ unit.T >= threshold)
        a.append(p[p + i < q] + i)
        b.append(q[p + i < q])
    return np.concatenate(a), np.concatenate(b)


def planted(r, base, cosine):
    """A vector at a given cosine to each of ``base`` (unit vectors)."""
    side = r.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = r.uniform(*cosine, (len(base), 1))
    return c * base + np.sqrt(1 - c * c) * side


@pytest.mark.parametrize("kind", ["even", "dense"])
def test_embedding_recall(spark, kind, tmp_path):
    """Links at 0.9005 to 0.92: among 16,000 vectors, and inside a cluster of 6,000 whose cosine to each other is about 0.8."""
    r = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "even":
        base = unit(r.standard_normal((15000, 64)))
        vectors = np.concatenate([base, planted(r, base[:1000], (0.9005, 0.92))])
    else:
        centre = unit(r.standard_normal((1, 256)))
        cluster = planted(r, np.repeat(centre, 5700, 0), (0.894, 0.895))
        vectors = np.concatenate([unit(r.standard_normal((2000, 256))), cluster, planted(r, cluster[:300], (0.905, 0.92))])
    frame = pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": list(vectors.astype(np.float32)), "node": 1})
    frame.to_parquet(tmp_path / "vectors.parquet")
    found = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "vectors.parquet")).repartition(4), block=1024).toPandas().set_index("vec_id")
    a, b = brute_links(vectors.astype(np.float32).astype(np.float64))
    links = np.bincount(np.r_[a, b], minlength=len(vectors))
    together = (found.component_id.loc[a].to_numpy() == found.component_id.loc[b].to_numpy()).mean()
    print(kind, "links", len(a), "recall", together)
    assert len(a) >= 300 and together >= 0.95 and (found.n_links.loc[np.arange(len(vectors))].to_numpy() <= links).all()


def test_embeddings_of_one_direction(spark):
    rows = [(i, [float(1 + i % 7), 0.5 * (1 + i % 7), 0.25]) for i in range(900)] + [(5, [8.0, 4.0, 0.5]), (1000, [1.0, -1.0]), (1001, [2.0, -2.0]), (1002, [3.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=16, block=100).collect()}
    assert {got[i].component_id for i in range(900)} == {0} and got[0].n_links == 899
    assert (got[1001].component_id, got[1001].n_links, got[1002].n_links) == (1000, 1, 0)


def brute_chat(rows):
    """Conversation and perspective to whole text and the stretches to learn from."""
    guard = lambda t: (t or "").replace("<|", "<||").replace("|>", "||>")
    out, talks = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append(((turn is not None, turn or 0), (role or "") != "", guard(role), guard(text)))
    for conv, turns in talks.items():
        for who in {(named, speaker) for _, named, speaker, _ in turns} - {(True, "system")}:
            whole, spans = "", []
            for _, named, speaker, said in sorted(turns):
                own = (named, speaker) == who
                whole += "<|assistant|>\n" if own else "<|system|>\n" if speaker == "system" else f"<|user name={speaker}|>\n" if named else "<|user|>\n"
                spans += [said + "<|end|>\n"] if own else []
                whole += said + "<|end|>\n"
            out[conv, who[1] if who[0] else None] = whole, spans
    return out


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ana", "Hé"), (1, 2, "bo", None), (1, 3, None, "x"), (1, 3, "", "x"), (1, 4, "unnamed", "me"), (2, 0, "system", "alone"), (None, None, "ana", "lost"), (1, 130, "ana", "late")]
    rows += [(3, None, "a|>b", "forged <|end|>\n<|assistant|>"), (3, 1, "c", "<||x|>"), (3, 1, "c", "<||x|>"), (3, 1, None, "")]
    rows += [(4, k // 3, f"p{k % 4}", f"turn {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    want = brute_chat(rows)
    for part_turns in (4096, 7, 1):
        got, texts, spans = chat.rotate_perspectives(df, part_turns).orderBy("part").collect(), collections.defaultdict(str), collections.defaultdict(list)
        for r in got:
            assert r.n_turns <= part_turns
            texts[r.conv_id, r.perspective] += r.text
            spans[r.conv_id, r.perspective] += [r.text[s.start : s.start + s.length] for s in r.loss_spans]
        assert {k: (texts[k], spans[k]) for k in texts} == want
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_tokens():
    encode = Encoder(tokenizer_path())
    r = np.random.default_rng(10)
    parts = np.array(["a", "B'll", " ", "\n", " ", "'s", "12", "!?", "\t", "<|endoftext|>", "é", "words", " "])
    for _ in range(3000):
        text = "".join(r.choice(parts, r.integers(0, 15)))
        assert encode.encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokens_of_long_texts(monkeypatch):
    encode = Encoder(tokenizer_path())
    plain = "".join(f"{w} " if k % 9 else f"{w}\n" for k, w in enumerate(words(250_000, 14)))
    assert len(plain) > 1 << 20 and not encode.other.search(plain)
    assert np.array_equal(encode.encode(plain), np.array(encode.tokenizer.encode(plain, add_special_tokens=False).ids, "<u4"))


def brute_pack(sizes, capacity, windows):
    """Windows as lists of (document, start, length), by the rules alone."""
    out, opened = [], []
    for doc, size in enumerate(sizes):
        at = 0
        while size - at >= capacity:
            out.append([(doc, at, capacity)])
            at += capacity
        while at < size:
            left, used = size - at, lambda w: sum(n for _, _, n in w)
            fits = [w for w in opened if used(w) + left <= capacity]
            if fits or len(opened) < windows:
                w = max(fits, key=used) if fits else []
                if not fits:
                    opened.append(w)
                w.append((doc, at, left))
                at = size
                gone = used(w) == capacity
            else:
                w = max(opened, key=used)
                take = min(capacity - used(w), left - 8)
                if take >= 8:
                    w.append((doc, at, take))
                    at += take
                gone = True
            opened = [x for x in opened if x is not w] + ([] if gone else [w])
            out += [w] if gone else []
    return out + opened


def test_packer_against_rules():
    r = np.random.default_rng(15)
    for trial in range(60):
        sizes = r.integers(1, 90 if trial % 2 else 200, 150).tolist()
        packer, got = packing.Packer(64, 1 + trial % 4, 0), []
        for doc, size in enumerate(sizes):
            got += [p for _, p in packer.add(doc, 0, np.arange(size), size)]
        closed = len(got)
        got += [p for _, p in packer.rest()]
        plain = [[(d, start, len(ids)) for d, start, ids, _ in p] for p in got]
        assert sorted(plain) == sorted(brute_pack(sizes, 64, 1 + trial % 4))
        assert all(sum(n for _, _, n in p) > 64 - 16 for p in plain[:closed])


def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer_path(), capacity=128, windows=3).collect()
    tokenizer = Encoder(tokenizer_path()).tokenizer
    pieces = collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 128
    of = {r[0]: r[1] for r in corpus() if r[0] not in (3, 6, None)}
    for i, text in of.items():
        own = sorted((r.start, r.ids, r.doc_tokens) for r in rows if r.doc_id == i)
        ids = np.frombuffer(b"".join(x for _, x, _ in own), "<u4").tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] and own[0][2] == len(ids)
    used = sum(r.length for r in rows)
    assert used == sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in corpus())
    assert 1 - used / (128 * len(pieces)) < 0.1
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_carries_any_ids(spark):
    """Longs beyond what a double holds, beside a null, in one merge; and ids that are no numbers."""
    rows = [((1 << 60) + 1, "one two"), ((1 << 60) + 3, "three"), (None, "four"), (-(1 << 62) - 1, "five")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tokenizer_path(), with_ids=False)
    assert got.schema["doc_id"].dataType.simpleString() == "bigint"
    assert {r.doc_id for r in got.collect()} == {i for i, _ in rows}
    named = packing.pack(spark.createDataFrame([("a", "x"), (None, "y")], "doc_id string, text string"), tokenizer_path()).collect()
    assert {r.doc_id for r in named} == {"a", None}


def test_language(spark, none):
    r = np.random.default_rng(11)
    stems = {"aa": "kalo mira tesu pano".split(), "bb": "schrunk gewelt plichten drost".split()}
    make = lambda k, n: " ".join(r.choice(stems[k]) + r.choice(["a", "en", "ist", "o"]) for _ in range(n))
    rows = [(i, make(k, 60), k, "s", 0, "", 0, 0) for i in range(60) for k in ("aa", "bb")]
    training = langid.training_sample(spark.createDataFrame(rows, DOCS))
    test = [(1, make("aa", 400), None), (2, make("bb", 5), None), (3, None, None), (4, "", None), (5, "12 ?!", None), (6, "K", None), (6, "K", None)]
    got = langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), training).collect()
    pred = {x.doc_id: x.lang_pred for x in got}
    assert len(got) == 7 and pred[1] == "aa" and pred[2] == "bb" and {pred[3], pred[4], pred[5]} == {"und"} and pred[6] in ("aa", "bb")
    assert all(0 <= x.score <= 1 for x in got)
    assert {x.lang_pred for x in langid.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), langid.training_sample(none)).collect()} == {"und"}


def brute_phrases(text, trained):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in trained:
            n += 1
        count, at = count + 1, at + n
    return count


def test_parser_counts():
    r = np.random.default_rng(13)
    letters = {"x": "abcd", "y": "abz", "Ω": "αβγδ", "漢": [chr(0x4E00 + i) for i in range(300)]}
    text = lambda of, n: "".join(r.choice([*of, " "]) for _ in range(n))
    squeezed = lambda t: re.sub(" +", " ", t)
    training = {k: [text(v, 2000)] for k, v in letters.items()}
    parser = langid.Parser(training)
    texts = [text("abcdzq", n) for n in (1, 7, 8, 9, 300)] + [text("αβγabж", 200), text(letters["漢"], 500), "a", training["x"][0], "Я" * 40, "".join(r.permutation(list(training["漢"][0])))]
    want = [[brute_phrases(squeezed(t), squeezed(training[k][0])) for k in parser.languages] for t in texts]
    for block in (3, 8, 64, 512):
        assert parser.phrases([parser.fold(t) for t in texts], block).tolist() == want, block
    assert parser.predict([training["漢"][0][:50], training["Ω"][0][50:99]])[0] == ["漢", "Ω"]


def test_quality(spark):
    r = np.random.default_rng(12)
    good = lambda: " ".join(f"{r.choice(list('abcde'))}{r.choice(['lor', 'mit', 'sun'])}" for _ in range(80))
    rows = [(i, good() if i % 2 else good().upper().replace(" ", "!! "), "l", "s", 0, "", 0, 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    training = quality.training_sample(docs, labels)
    scores = {x.doc_id: x.score for x in quality.score_quality(docs, training).select("row.doc_id", "score").collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 2 == 1) for i in range(300, 400)]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert all(0 <= x.score <= 1 for x in quality.score_quality(odd, training).collect())
    assert {x.score for x in quality.score_quality(odd, training.limit(0)).collect()} == {0.5}


def test_classifier_against_plain_steps():
    r = np.random.default_rng(18)
    word = lambda of: "".join(r.choice(list(of), 5))
    rows = [(q, b, " ".join(word("abcdefgh" if q else "ghijklmn") for _ in range(60))) for q in (0, 1) for b in range(120)]
    rows = [(q if r.random() > 0.1 else 1 - q, b, p) for q, b, p in rows]
    model = quality.Classifier(rows)
    text = rows[0][2].encode() * 20
    sizes = [sum(len(c.compress(text[i : i + quality.BLOCK])) for i in range(0, len(text), quality.BLOCK)) for c in model.compressors]
    assert model.difference(text) == (sizes[0] - sizes[1]) / len(text) and model.difference(b"") == 0
    x = np.array([model.difference(p.encode()) for q, b, p in sorted(rows) if b % 2])
    y = np.array([q for q, b, _ in sorted(rows) if b % 2], float)
    z, w = x / x.std(), np.zeros(2)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    for _ in range(40_000):  # plain gradient steps to the same optimum
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        w += 0.02 * (np.array([(weight * (y - p) * z).sum(), (weight * (y - p)).sum()]) - 0.01 * w)
    assert (model.slope * x.std(), model.offset) == pytest.approx(tuple(w), rel=1e-3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = queries.op5_language_id(spark, "/root/testdata/sf0.1").where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.99
    found = queries.op9_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id")
    assert found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.97


def test_learners_without_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(none, quality.training_sample(none, labels)).count() == 0
    assert langid.identify(none, langid.training_sample(none)).count() == 0
    same_id = spark.createDataFrame([(1, "b a", "x", 3), (1, "a b", "x", 4)], "doc_id long, text string, lang string, score int")
    rated = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.piece for r in quality.training_sample(same_id, rated).collect()] == ["a b"]
    assert [r.piece for r in langid.training_sample(same_id).collect()] == ["a b"]
    assert [r.row.score for r in quality.score_quality(same_id, quality.training_sample(same_id, rated)).collect()] == [3, 4]


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        key = f"k{n}"
        moved = mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key), F.array(*[F.lit(x) for x in mixing._offsets(key, 6)]))
        got = [r[0] for r in spark.range(n).orderBy("id").select(moved).collect()]
        assert sorted(got) == list(range(n)) and all(mixing.index_of(v, n, key, 6) == i for i, v in enumerate(got))


def test_mixing(docs, none, spark):
    rows = mixing.mix_report(docs, block_words=16).collect()
    again = mixing.mix_report(docs, block_words=16).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(corpus())
    sizes, target = collections.Counter(), {}
    for r in corpus():
        sizes[r[3]] += len(tokens(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the excess is shared again until no source is above its limit
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    target |= {s: level * weight[s] for s in free}
    assert {round(r.target, 6) for r in rows} == {round(x, 6) for x in target.values()}
    assert all(r.taken <= 2 * r.size for r in rows) and abs(sum(r.taken for r in rows) - 1.5 * sum(sizes.values())) < 8
    mixed = mixing.mix_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(tokens(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix_report(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mixing_shards_and_repeated_ids(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20 + i % 13)), f"s{i % 2}", 0) for i in range(400)]
    rows += [(7, " ".join(f"r{k}x{j}" for j in range(40 + k)), "s1", 0) for k in range(9)] + [(None, " ".join(f"n{k}x{j}" for j in range(30)), "s0", 0) for k in range(9)]
    rows += [rows[3]] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    report = mixing.mix_report(df, block_words=8, shard_slots=100).collect()
    assert len(report) == len(rows) and all(r.taken <= 2 * r.size for r in report)
    for name in ("s0", "s1"):
        own = [r for r, x in ((r, r) for r in report) if r.source_size == sum(len(t.split()) for _, t, s, _ in rows if s == name)]
        assert own and abs(sum(r.taken for r in own) - own[0].target) <= 1
    sized = mixing._sized(df, F.col("doc_id"))
    slots = mixing.plan_mix(sized, block_words=8, shard_slots=100)[2].collect()
    places = {r.place for r in slots}  # the last slots of a source may be empty
    assert len(places) == len(slots) and max(places) < len(slots) + 4 and all(r.shard == r.place // 100 for r in slots)
    share = np.mean([r.nth for r in slots])
    parts = collections.defaultdict(list)
    for r in slots:
        parts[r.shard].append(r.nth)
    spread = [(np.mean(v) - share) / np.sqrt(share * (1 - share) / len(v)) for v in parts.values() if len(v) == 100]
    assert max(map(abs, spread)) < 5 and 0.4 < np.std(spread) < 1.8  # as draws are, neither even nor clustered
    mixed = mixing.mix_documents(df, block_words=8, shard_slots=100)
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in report)
    in_order = mixed.coalesce(1).collect()
    docs_between = np.mean([a.doc_id != b.doc_id for a, b in zip(in_order, in_order[1:], strict=False)])
    assert docs_between > 0.9  # not document after document


def test_exact_levels(spark):
    head = "h" * 200
    texts = [head + "a" * 50, head + "b" * 50, head + "b" * 50, head + "c" * 49, "x" * 250, None, ""]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, text_sha256 string, n_top int")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {0: 0, 1: 2, 2: 2, 3: 3, 4: 4, 5: 6, 6: 6}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 6]


def test_blocks_and_extraction(spark):
    page = "<html><head><title>no</title><script>var a='<p>x</p>'</script></head><body><nav><a href=1>Home</a></nav><!-- c -->"
    page += "<article><h1>A &amp; B</h1><p>First  line\n here.<br>And <b>more.<p>Second &eacute;t&eacute;.</article><footer>&copy; me</footer><p unfinished"
    assert [b.text for b in blocks_of(page)] == ["Home", "A & B", "First line here. And more.", "Second été.", "© me"]
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<nav>x</nav>"), (4, None, "<nav>x</nav>"), (5, "u", "<p>" * 3000 + "a 'b\" <"), (6, "u", "plain")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract_text(df.withColumn("text", F.lit("clash"))).collect()}
    assert got[1].text == "A & B\nFirst line here. And more.\nSecond été." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[4].text == "" and html_extract.extract_text(df.limit(0)).count() == 0


def test_names_of_any_number_and_depth():
    """Long lists of classes and named elements in between hide no sidebar; classes of the whole page make none."""
    text = "The river rose through the night and the town council met to decide what to do about the bridge."
    box, article = "<p>Short words in the box, read more of our other stories today.</p>", f'<article class="post"><p>{text}</p><p>{text}</p></article>'
    utility = " ".join(f"u{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60))
    model = html_extract.default_extractor()
    for page in (
        f'<body>{article}<div class="{utility} sidebar ad promo">{box}</div></body>',
        f'<body>{article}<div class="sidebar ad promo">{"".join(f"<div class=level{c}>" for c in "abcdef")}{box}{"</div>" * 7}</body>',
        f'<body class="home page has-sidebar"><div class="page"><div class="wrap">{article}</div></div></body>',
    ):
        assert model.text(page) == f"{text}\n{text}"


def test_text_inside_math_and_objects():
    """Only the parts that are no article text are dropped."""
    page = "<article><p>Energy is <math><mi>E</mi>=<mi>m</mi><mi>c</mi></math> as said, <object data=x>a picture</object> and <svg><text>no</text></svg>all.</p></article>"
    assert [b.text for b in blocks_of(page)] == ["Energy is E=mc as said, a picture and all."]


def test_many_names_in_a_page():
    r = np.random.default_rng(3)
    names = ["".join(chr(97 + c) for c in row) for row in r.integers(0, 26, (5000, 6))]
    began = time.perf_counter()
    html_extract.default_extractor().text("".join(f"<div class={n}>x" for n in names))
    assert time.perf_counter() - began < 30


def test_parts_of_names():
    from tubal.llm import html_blocks

    bits = html_blocks._parts("ad") | html_blocks._parts("aside")
    assert sorted(html_blocks.parts_of(bits)) == sorted({"^ad", "ad$", "^as", "asi", "sid", "ide", "de$"})
    assert sum(map(html_blocks.bits_of, html_blocks.parts_of(bits))) == bits


def test_chain_against_enumeration():
    r = np.random.default_rng(17)
    s, moves = r.standard_normal((3, 6, 2)), r.standard_normal((2, 2))
    there = np.arange(6) < np.array([[6], [4], [1]])
    p, joint, z = html_extract.chain_sums(s, moves, there)
    for page in range(3):
        n = int(there[page].sum())
        score = {ys: sum(s[page, i, y] for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in zip(ys, ys[1:], strict=False)) for ys in itertools.product((0, 1), repeat=n)}
        total = sum(np.exp(v) for v in score.values())
        assert z[page] == pytest.approx(np.log(total))
        for i in range(n):
            assert p[page, i, 1] == pytest.approx(sum(np.exp(v) for ys, v in score.items() if ys[i]) / total)
        for i in range(n - 1):
            assert joint[page, i, 0, 1] == pytest.approx(sum(np.exp(v) for ys, v in score.items() if ys[i : i + 2] == (0, 1)) / total)
        blocks = blocks_of("".join(f"<{t}>x</{t}>" for t in ["h1", "p", "li", "div", "h2", "td"][:n]))
        weights = {f"own={b.place.tag}": tuple(s[page, i]) for i, b in enumerate(blocks)}
        model = html_extract.Extractor(weights, moves.tolist())
        assert tuple(model.decode(blocks)) == max(score, key=score.get)


def test_deep_pages():
    began = time.perf_counter()
    deep = "<div class=a>x" * 80_000
    assert len(blocks_of(deep)) == 80_000 and len(blocks_of("<div>x" * 5000 + "</section>" * 20_000)) == 5000
    assert html_extract.default_extractor().text(deep[:200_000]) is not None
    assert time.perf_counter() - began < 40


def test_extractor_on_hostile_pages():
    """Layouts that the training pages do not have."""
    text = "The river rose again in the night, and by the morning the lower fields were under water. Nobody had seen it so high since the mill was built."
    menu = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Archive</a></li></ul>"
    pages = [
        f"<body><div><div>{menu}</div><div><h1>The flood</h1><div>{text}</div><div>{text}</div></div><footer>&copy; 2020 Mill Press</footer></div></body>",
        f"<body><div id=wrap><div class=topnavbar>{menu}</div><div class=maincontent><h2>The flood</h2><p>{text}</p><p>{text}</p></div><section class=commentsection><p>Nice one</p><p>I do not agree with this at all, sorry.</p></section><div class=sidebarright><p>More from us</p></div></div></body>",
        f"<body><header><p>Mill Press</p></header><main><h1>The flood</h1><p>{text}</p><aside><p>Buy our book today!</p></aside><p>{text}</p></main><div class=cookiebar><p>We use cookies to make this site better.</p></div></body>",
    ]
    for page in pages:
        assert html_extract.default_extractor().text(page).split("\n") == ["The flood", text, text], html_extract.default_extractor().text(page)


def test_extractor_on_unseen_pages():
    model = html_extract.default_extractor()
    examples = html_extract._examples(labelled_pages(80, seed=77))
    pairs = [(p, y) for blocks, labels in examples for p, y in zip(model.decode(blocks), labels, strict=True)]
    assert len(examples) > 70 and np.mean([p == y for p, y in pairs]) > 0.98


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, " ".join(words(50 + i, i)), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(5)]
    rows += [(200 + i, "BAD!! " * 40, "en", "s2", 0) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame, kept = table, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == table.columns
        frame.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = frame.collect()
    assert {r.doc_id for r in kept["quality"]} == {r[0] for r in rows if r[0] < 200}
    assert {r.doc_id for r in kept["exact_dedup"]} == {100, 101, 102, 103, 104, *range(5, 60)}
    assert len(kept["near_dedup"]) == 60
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "sequence_id", "length"} <= set(result.columns) and result.count() > 0


ODD = ["score", "row", "key", "shared", "sketch", "digest", "low", "doc_key", "cuts", "part", "shard", "place", "all", "_sha256", "_keep_id", "_n_top", "_len", "_text", "text_sha256", "n", "a b"]


@pytest.mark.parametrize("stage", ["quality", "exact_dedup", "near_dedup", "mixing", "packing"])
def test_pipeline_stage_on_odd_rows(spark, tmp_path, stage):
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    function = dict(corpus_pipeline.STAGES)[stage]
    long = " ".join(words(120_000, 55, 50_000))
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1), (None, None, None, None, None), (None, "", None, None, None), (2, long, "en", "s", 9), (3, long, None, None, 9), (3, " \n", "de", "t", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit("x").alias(c) for c in ODD])
    spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = function(spark, df, str(tmp_path)).collect()
    if stage == "packing":
        assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    else:
        assert function(spark, df, str(tmp_path)).columns == df.columns and all(r["a b"] == "x" for r in got)
    if stage == "exact_dedup":
        assert sorted(len(r.text or "") for r in got) == sorted(len(t) for t in {t or "" for _, t, *_ in rows})
    if stage == "near_dedup":
        assert sorted((str(r.doc_id), len(r.text or "")) for r in got) == [("1", 27), ("2", len(long)), ("3", 2)]
    if stage == "mixing":
        assert {len(r.text) == r.n_chars for r in got} == {True} and "".join(r.text for r in got if r.doc_id == 1).startswith("one two")
    empty = function(spark, df.limit(0), str(tmp_path))
    assert empty.count() == 0


def shingles(text, n=5):
    w = tokens(text.lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def near_copies(pairs=240):
    """Texts and copies with single words replaced, at five-word Jaccard of about 0.6 to 1."""
    r = np.random.default_rng(31)
    for k in range(pairs):
        base = words(int(r.integers(60, 600)), 7000 + k, 20000)
        copy, share = list(base), r.uniform(0, 0.05)
        for at in r.choice(len(copy), max(1, int(share * len(copy))), False):
            copy[at] = f"other{at}"
        yield " ".join(base), " ".join(copy)


def test_pipeline_near_copies(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = list(near_copies())
    similarity = np.array([jaccard(a, b) for a, b in texts])
    rows = [(i, a, "x") for i, (a, _) in enumerate(texts)] + [(1000 + i, b, "x") for i, (_, b) in enumerate(texts)]
    rows += [(5000 + i, t, "x") for i, t in enumerate(["Four words at least", "four WORDS  at least", "four words at most", "", " \n"])]
    table = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, table, str(tmp_path)).collect()}
    gone = np.array([1000 + i not in kept for i in range(len(texts))])
    assert all(i in kept for i in range(len(texts)))
    around = (similarity >= 0.8) & (similarity < 0.85)
    print("pairs", around.sum(), "recall at 0.80 to 0.85", gone[around].mean(), "at 0.8 or more", gone[similarity >= 0.8].mean())
    assert around.sum() >= 20 and gone[around].mean() >= 0.9 and gone[similarity >= 0.8].mean() >= 0.95
    assert gone[similarity < 0.8].sum() == 0 and (similarity < 0.65).sum() >= 10
    assert ((similarity >= 0.7) & (similarity < 0.8)).sum() >= 20
    assert kept & set(range(5000, 5005)) == {5000, 5002, 5003}
    assert corpus_pipeline.near_stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_large_buckets_of_near_copies(spark):
    texts = [" ".join(words(100, 40) + words(4, 900 + k)) for k in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for large in (8, 4096):
        assert [r.doc_id for r in simhash_wide.drop_near_copies(df, large=large).collect()] == [0]


def test_verified_links(spark):
    """One component of chains, of copies of a text and of texts just below the threshold, with repeated rows, a
    null id and texts of few words: whatever the size of the parts, the links join what brute force joins."""
    texts = []
    for k in range(12):
        chain = words(90, 50 + k)
        for step in range(9):
            texts.append(" ".join(chain))
            chain = [f"w{k}x{step}{i}" if step <= i // 3 < step + (1, 2, 5)[k % 3] else w for i, w in enumerate(chain)]
    hub = words(200, 99)
    texts += [" ".join(w if i != 3 * k else "new" for i, w in enumerate(hub)) for k in range(60)]
    texts += ["a b", "A b", "a c", "one two three four five"]
    first = {}
    for t in texts:
        first.setdefault(frozenset(shingles(t)), t)
    texts = list(first.values())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    assert 20 < len(set(root)) < len(texts) - 50
    docs = spark.createDataFrame([(None if i == 0 else i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, key int")
    sizes = [len(shingles(t)) for t in texts]
    low = [(None if i == 0 else i, hashlib.md5(t.encode()).digest()) for i, t in enumerate(texts)]
    members = spark.createDataFrame([(0, x, i, n) for i, (x, n) in enumerate(zip(low, sizes, strict=True))], "component long, low struct<doc_id: long, digest: binary>, node long, n_shingles long")
    for large, group_bytes in ((4096, 1 << 23), (7, 1 << 13)):
        links = simhash_wide.verified_links(members, docs, "doc_id", "text", large, group_bytes)
        found = {x.node: x.component for x in connected_components(links).collect()}
        assert [found.get(k, k) for k in range(len(texts))] == root, (large, group_bytes)


def test_large_buckets_of_chains(spark):
    """All sketches share all least hashes, so that no dealing out parts them; links by way of others than the pivot count."""
    r = np.random.default_rng(21)
    bits = [r.integers(0, 2, 8 * simhash_wide.BYTES)]
    for k in range(160):
        row = (bits[-1] if k % 40 else r.integers(0, 2, 8 * simhash_wide.BYTES)).copy()
        row[r.choice(len(row), 60 + k, False)] ^= 1
        bits.append(row)
    bits = np.array(bits)
    rows = [(k, np.packbits(b).tobytes() + bytes(simhash_wide._MINIMA)) for k, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "node long, sketch binary")
    root = list(range(len(bits)))
    for a, b in zip(*np.nonzero((bits[:, None] != bits[None]).sum(2) <= simhash_wide.RADIUS), strict=True):
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    assert 3 < len(set(root)) < 120
    for large in (6, 50, 4096):
        found = {x.node: x.component for x in connected_components(simhash_wide.similar_pairs(df, large)).collect()}
        assert [found.get(k, k) for k in range(len(bits))] == root


def test_mixing_keeps_white_space(spark):
    texts = ["\n\n  def f(x):\n\treturn x\n\n\nf(1)\r\n", "a\tb\n" * 300, " one ", "no space", "é \u00a0x\n"]
    df = spark.createDataFrame([(i, t, f"s{i}", 0) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix_documents(df, block_words=4096, share=1.0, weights=(1,), most=1).collect()
    got = collections.defaultdict(list)
    for r in mixed:
        got[r.doc_id].append(r.text)
    assert got[2] == [texts[2]] and got[3] == [texts[3]] and got[4] == [texts[4]]
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)
    many = df.where("doc_id = 1").withColumn("n_chars", F.lit(1).cast("long"))
    pieces = [r.text for r in mixing.mix_documents(many, block_words=7, share=1.0, most=1).collect()]
    assert len(pieces) > 80 and sum(map(len, pieces)) == len(texts[1]) and all(p in texts[1] for p in pieces)


def test_mixing_of_many_sources(spark):
    n = 20_500
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b\tc").alias("text"), F.concat(F.lit("site"), F.col("id")).alias("source"))
    got = mixing.mix_report(df, block_words=2).agg(F.count(F.lit(1)), F.sum("taken"), F.sum("target"), F.max("taken"), F.count_distinct("target")).first()
    # Weights 3, 1, 2 in turn: the sources of weight 3 reach their limit of 6 words, the others get 2.5 and 5.
    assert got[0] == n and got[2] == pytest.approx(4.5 * n) and got[3] == 6 and got[4] == 3
    assert abs(got[1] - 4.5 * n) <= 0.5 * n / 3 + 2
    names = [F.concat(F.lit("mix/"), F.col("id").cast("string"))]
    rows = spark.range(5).select(mixing.offsets_of(names[0], 12).alias("o"), "id").collect()
    assert all(list(r.o) == mixing._offsets(f"mix/{r.id}", 12) for r in rows)
    back = spark.range(7).select("id", mixing.permuted(F.col("id"), F.lit(7).cast("long"), F.lit("k"), F.array(*[F.lit(x) for x in mixing._offsets("k", 6)]), back=True).alias("i"))
    assert all(mixing.index_of(r.id, 7, "k", 6) == r.i for r in back.collect())


def test_substring_rows_of_one_text_and_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_OFTEN", 5)
    shared, other = words(40, 50), words(60, 51)
    texts = [" ".join(words(30 + k, 60 + k) + shared) for k in range(3)] + [" ".join(other)]
    rows = [(None, t) for t in texts] + [(None, texts[3])] * 20 + [(1, texts[0])] + [(None, "short")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    places = substring_dedup._judged_anchors(substring_dedup._anchors(df, 35))
    marks = substring_dedup._per_document(places, F.shiftleft(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 2) + F.col("state"))
    assert max(len(r.marks) for r in marks.collect()) <= 60 and marks.count() == 4 and marks.where("copies > 5").count() == 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == {(None, 70, 70): 1, (1, 70, 70): 1, (None, 71, 40): 1, (None, 72, 40): 1, (None, 60, 60): 21, (None, 1, 0): 9}


def test_substring_texts_of_one_short_hash(spark, monkeypatch):
    monkeypatch.setattr(F, "hash", lambda *c: F.lit(7))  # what 32 bits cannot tell apart
    texts = [" ".join(words(20 + 30 * k, 70 + k) + words(40, 80)) for k in range(4)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(60 + 30 * k, 40) for k in range(4)]


@pytest.mark.parametrize("window,lengths", [(5, []), (35, [9]), (70, [9, 18]), (100, [13, 25])])
def test_substring_levels(spark, window, lengths):
    """Runs of all lengths that documents share: the survivors of a level are those repeated at its length,
    and what is removed is what all windows compared say."""
    assert substring_dedup.short_lengths(window) == lengths
    texts = []
    for k, n in enumerate((3, 8, 9, 12, 17, 18, 24, 34, 35, 50, 69, 70, 99, 100, 150)):
        shared = words(n, 500 + k)
        texts += [words(11 + k, 600 + k) + shared + words(90, 700 + k), words(40, 800 + k) + shared + words(60, 900 + k)]
    texts += [words(12, 1000) * 20, words(13, 1001) * 2]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    count = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    want = []
    for doc_id, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                gone.update(range(i, i + window))
        want.append((doc_id, len(t), len(gone)))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df, window=window).collect())
    assert got == want and sum(x[2] for x in want) > 150
    anchors = every = [r.asDict() for r in substring_dedup._anchors(df, window).collect()]
    for k in range(len(lengths)):
        met = collections.Counter(r[f"short{k}"] for r in anchors)
        anchors = [r for r in anchors if met[r[f"short{k}"]] > 1]
    assert anchors and (len(anchors) < len(every)) == bool(lengths)
    left = sorted((r.key, r.place) for r in substring_dedup._candidates(df, window).collect())
    assert left == sorted((r["key"], r["place"]) for r in anchors)


@pytest.mark.parametrize("needs", [[37, 0, 90, 1, 260], [1] * 60, [500], []])
def test_slots_are_dealt_as_drawn(spark, needs):
    starts = np.r_[0, np.cumsum(needs)].astype(int)
    schema = "nth long, first_slot long, slots long"
    got = mixing.deal_slots(spark.createDataFrame([(k, int(starts[k]), n) for k, n in enumerate(needs)], schema), shard_slots=50, seed="t").collect()
    total = int(starts[-1])
    drawn = [int(np.searchsorted(starts, int(hashlib.md5(f"t/draw/{p}".encode()).hexdigest()[:14], 16) % total, "right")) - 1 for p in range(total)]
    next_of, spare, shards = collections.Counter(), [], {}
    for nth, shard in sorted((s, p // 50) for p, s in enumerate(drawn)):
        if next_of[nth] < needs[nth]:
            shards[nth, next_of[nth]] = shard
        else:
            spare.append(shard)
        next_of[nth] += 1
    free = [(k, i) for k, n in enumerate(needs) for i in range(next_of[k], n)]
    shards |= dict(zip(free, spare, strict=True))
    assert {(r.nth, r.ordinal): r.shard for r in got} == shards and len(got) == total
    assert sorted(r.place for r in got) == list(range(total)) and all(r.place // 50 == r.shard for r in got)
