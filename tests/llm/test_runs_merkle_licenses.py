"""Periodic runs, the Merkle manifest and license scans on small tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubal.llm import licenses, merkle, periodic_runs, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, leaf int, pos int, `a``b` string"


def corpus():
    loop = "alpha beta gamma " * 9
    texts = [None, "", " \n\t ", "one", "go " * 6, "go " * 5, f"Start {loop}end", f"x {loop}y {loop}z", " ".join(f"w{i % 700}" for i in range(3000)), "no\x0bno no no  no\nno NO"]
    texts += ["Released under the MIT License.", "Licensed under CC BY-NC 4.0, cc-by nc; cc by nc by nc", "Apache License, Version 2.0 and under the mit license " * 3, "under the mit licence", "cc by", "Ünder the MIT license"]
    rows = [(i, t, "en", ["a", "b", "ß", "", None][i % 5], i, "r", 1, 2, "c") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id " * 40, None, None, None, None, None, None, None), (3, "same id", "fr", "b", 1, "y", 1, 2, None), (-5, loop, "fr", "b", 1, "y", 1, 2, None)]
    return rows + [(1000 + i, f"t{i % 40} " * (i % 9), "en", "hot", i, "r", 1, 2, "c") for i in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, none, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    none.write.parquet(f"{path}/documents.parquet")
    return path


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# Periodic runs


def brute_runs(words, least=6, periods=4):
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, periods * q) and not any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,periods", [(6, 4), (2, 2)])
def test_runs_against_brute_force(least, periods):
    rnd = random.Random(5)
    for _ in range(300):
        documents = []
        for _ in range(rnd.randint(1, 5)):
            kinds = rnd.choice([1, 2, 3, 5])
            words = [b"%d" % rnd.randrange(kinds) for _ in range(rnd.randint(0, 60))]
            for _ in range(rnd.randint(0, 3)):
                words += [b"%d" % rnd.randrange(kinds) for _ in range(rnd.randint(1, 4))] * rnd.randint(1, 7)
            documents.append(words)
        for found, words in zip(periodic_runs.periodic_runs(documents, least, periods), documents, strict=True):
            want = brute_runs(words, least, periods)
            assert [tuple(r) for r in found.runs.tolist()] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert [i for i in range(len(words)) if not found.kept[i]] == sorted(gone)


def test_suffix_array():
    numbers = np.random.default_rng(2).integers(0, 3, 400)
    found = periodic_runs.Repeats(numbers)
    plain = numbers.tolist() + [-1]
    assert found.order.tolist() == sorted(range(400), key=lambda i: plain[i:])
    assert (found.order[found.inverse[:-1]] == np.arange(400)).all()


def test_squares_go_through_all_intervals():
    """Each square of two equal halves that does not go on to the right is found, and nothing else."""
    numbers = np.array([0, 1, 1, 0, 1, 1, 0, 1, 1, 1, 0, 0, 2, 0, 0, 2])
    n, plain = len(numbers), [*numbers.tolist(), -1]
    want = {(s, h) for h in range(1, n // 2 + 1) for s in range(n - 2 * h + 1) if plain[s : s + h] == plain[s + h : s + 2 * h] and plain[s + h] != plain[s + 2 * h]}
    assert {*zip(*(x.tolist() for x in periodic_runs.Repeats(numbers).squares()), strict=True)} == want


def test_long_text_of_one_word():
    (found,) = periodic_runs.periodic_runs([[b"a"] * 200_000])
    assert found.runs.tolist() == [[0, 200_000, 1]] and found.kept.sum() == 1
    (found,) = periodic_runs.periodic_runs([[b"%d" % (i % 501) for i in range(100_000)]])
    assert found.runs.tolist() == [[0, 100_000, 501]]


def test_greatest_run():
    assert periodic_runs.greatest(np.array([[0, 12, 3], [20, 8, 2], [40, 9, 2]])) == (40, 9, 2)
    assert periodic_runs.greatest(np.array([[0, 12, 3], [0, 8, 2], [40, 4, 1]])) == (0, 12, 3)
    assert periodic_runs.greatest(np.zeros((0, 3), int)) is None


def test_runs_query(spark, folder, empty):
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, folder).collect()), key=repr)
    want = []
    for doc_id, text, *_ in corpus():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        n = len(words)
        if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(b" ".join(kept))))
    assert got == sorted(want, key=repr)
    assert queries.op11_periodic_runs(spark, empty).collect() == []


def test_runs_keep_columns(docs):
    found = periodic_runs.find_runs(docs, F.col("text"))
    assert found.select("row.*").columns == docs.columns
    one = found.where("row.doc_id = 6").first()
    assert one.n_words == 29 and [tuple(r) for r in one.runs] == [(1, 27, 3)] and tuple(one.best) == (1, 27, 3, 9000)


# Merkle manifest


def brute_tree(leaves, arity):
    """Top, and for each leaf its siblings, level by level, as (before, after)."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i in range(len(leaves)):
            g = at[i] // arity * arity
            paths[i].append(("".join(nodes[g : at[i]]), "".join(nodes[at[i] + 1 : g + arity])))
            at[i] //= arity
        nodes = [sha("".join(nodes[g : g + arity])) for g in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute_manifest(rows, arity=16, lowered=False):
    """Rows of doc_id, leaf, subroot, root, path, claimed."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    lower = lambda t: t and re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    leaf = lambda r, t: sha("".join(map(field, (r[0], r[3], r[2], r[4], t))))
    out, tops = [], []
    for source in sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(((r[0], leaf(r, r[1]), leaf(r, lower(r[1]))) for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        top, paths = brute_tree([r[1] for r in mine], arity)
        out += [(r, len(tops), p) for r, p in zip(mine, paths, strict=True)]
        tops.append(top)
    root, upper = brute_tree(tops, arity) if tops else (None, [])
    return [(i, own, tops[k], root, path + upper[k], changed) for (i, own, changed), k, path in out]


def folded(node, path):
    for before, after in path:
        node = sha(before + node + after)
    return node


def test_merkle_query(spark, folder, empty):
    got = sorted(map(tuple, queries.op12_merkle_manifest(spark, folder).collect()), key=repr)
    want = []
    for i, leaf, subroot, root, path, lowered in brute_manifest(corpus()):
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        top = folded(lowered if tampered else leaf, path)
        want.append((i, leaf, subroot, root, sha("".join(a + b for a, b in path)), top, top == root))
    assert got == sorted(want, key=repr)
    assert {r[-1] for r in got} == {True, False}
    assert queries.op12_merkle_manifest(spark, empty).collect() == []


@pytest.mark.parametrize("arity,stride", [(2, 1), (2, 3), (3, 2)])
def test_merkle_levels(spark, docs, arity, stride):
    """Any arity and any distance of kept levels give the same proofs; equal rows are leaves of their own."""
    rows = docs.select("doc_id", "source", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"), F.lit(None).cast("string").alias("claimed"))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in merkle.manifest(rows, arity, stride).collect()]
    assert sorted(got, key=repr) == sorted((r[:5] for r in brute_manifest(corpus(), arity)), key=repr)


def test_merkle_of_one_source_and_one_row(spark):
    for count in (1, 17, 257):
        rows = spark.range(count).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"), F.lit(None).cast("string").alias("claimed"))
        got = merkle.manifest(rows).withColumn("top", merkle.fold(F.col("leaf"), F.col("path"))).collect()
        top, paths = brute_tree([sha(str(i)) for i in range(count)], 16)
        assert len(got) == count and {(r.subroot, r.root, r.top) for r in got} == {(top, top, top)}
        assert {r.doc_id: [tuple(s) for s in r.path] for r in got} == dict(enumerate(paths))


def test_ids_of_other_types(spark):
    rows = spark.createDataFrame([("b", None, "x", None), ("a", None, "y", "z")], "doc_id string, source string, leaf string, claimed string")
    got = sorted((r.doc_id, r.claimed, [tuple(s) for s in r.path]) for r in merkle.manifest(rows).collect())
    assert got == [("a", "z", [("", "x")]), ("b", None, [("y", "")])]


# License scans


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    words, places = license_words(text), []
    for label, phrase in licenses.PHRASES:
        p = phrase.split(" ")
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_query(spark, folder, empty):
    got = sorted((tuple(r)[:6] for r in queries.op13_license_scan(spark, folder).collect()), key=repr)
    assert got == sorted(((i, *brute_base(t)) for i, t, *_ in corpus()), key=repr)
    assert queries.op13_license_scan(spark, empty).collect() == []


def test_base_phrases_at_random(spark):
    """Words of the phrases in any order, so that diagonals cross and touch."""
    rnd, vocabulary = random.Random(4), [*{w for _, p in licenses.PHRASES for w in p.split(" ")}, "x"]
    rows = [(i, rnd.choice([" ", "-", " . "]).join(rnd.choice([*vocabulary, *(p for _, p in licenses.PHRASES)]) for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    got = sorted(tuple(r)[:6] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == sorted((i, *brute_base(t)) for i, t in rows)


def test_notices(spark):
    """Notices with words put in and left out are found, and others are not."""
    mit = licenses.NOTICES[0][1].split(" ")
    texts = {
        1: " ".join(mit), 2: " ".join(["so", *mit[:9], "kindly", "and", "gladly", *mit[9:], "etc"]), 3: " ".join(mit[:12]), 4: " ".join(reversed(mit)),
        5: "under the GNU General Public License, version 3", 6: "under the GNU General Public License", 7: "the terms of the GNU Lesser General Public License as published by the FSF",
        8: " ".join(mit) + " filler" * 50 + " under the MIT license", 9: " ".join(mit[:14]) + " far" * 200 + " " + " ".join(mit[14:]),
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == {1: "mit", 2: "mit", 3: "", 4: "", 5: "gpl-3", 6: "", 7: "lgpl", 8: "mit", 9: ""}
    assert got[1].score == 1 and 0.8 <= got[2].score < 1 and got[3].score == 0 and got[8].n_base == 1 and got[1].n_base == 0


def test_license_scan_is_native(spark, folder):
    plan = queries.op13_license_scan(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_short_templates_are_refused(docs):
    with pytest.raises(ValueError):
        licenses.scan_licenses(docs, phrases=[("x", "two words")])
