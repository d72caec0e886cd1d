import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.components import components


def sets_of(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, words=5, percent=80):
    """doc_id -> (shingles, component) by comparing all pairs."""
    sets = {d: sets_of(t, words) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, "x " * 3000), (8, "é É x y z"), (9, "é é x y z")]
    for g in range(12):  # chains and groups of near copies, more or less alike
        base = [word() for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            out.append((100 + len(out), " ".join(copy) if rng.random() < 0.8 else " ".join(base).upper()))
            if g % 3 == 0:
                base = copy
    return out


def test_components_equal_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, component_id int").repartition(3)
    for words, percent in ((4, 80), (5, 80)):
        assert result(minhash.near_duplicates(docs, words, percent)) == brute(rows, words, percent)
    kept = {r.doc_id for r in minhash.deduplicate(docs).collect()}
    assert kept == {d for d, (_, c) in brute(rows).items() if c == d}
    assert minhash.deduplicate(docs).columns == docs.columns


def test_blocks_of_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(minhash.near_duplicates(docs, 4)) == brute(rows, 4)


def test_buckets_without_links_and_hidden_links(spark, monkeypatch):
    """Many documents of one template: about 0.6 alike, so they share buckets, and some pairs among them link."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template, rows = [word() for _ in range(100)], []
    for k in range(120):
        own = template + [word() for _ in range(30)]
        rows.append((k, " ".join(own)))
        if k % 4 == 0:
            rows.append((1000 - k, " ".join([*own[:-3], word()])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    assert len({c for _, c in want.values()}) == 120
    assert result(minhash.near_duplicates(docs, 4)) == want


def test_defined_results(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (2, 0, 2, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert minhash.deduplicate(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, a), (5, a.upper()), (7, a), (7, b), (7, b + " end"), (9, c), (2, None), (2, None), (None, c), (None, c), (4, "")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, row string, d int")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(5, 36, 5), (7, 36, 5), (7, 36, 7), (7, 37, 7), (9, 36, 9), (2, 0, 2), (None, 36, None), (4, 0, 4)}
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([5, 7, 9, 2, 2, None, None, 4], key=str)


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(minhash.near_duplicates(docs, 4)) == brute([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 1000 + i) for i in range(200)] + [(7, 7), (None, 3), (9, 8)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            p, q = sorted((find(u), find(v)))
            root[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "u long, v long").where(F.lit(True))).count() == 0
