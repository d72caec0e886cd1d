import collections
import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(30, 90)) for _ in range(4)]
    out = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "b" * 500, "ab" * 300, "abc" * 67, "abc" * 70, prose(300) * 2]
    for _ in range(30):
        t = [prose(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 4))]
        t.insert(rng.randrange(len(t) + 1), rng.choice(passages))
        out.append(" ".join(t))
    for _ in range(20):  # copies with edits
        words = rng.choice(out[-10:]).split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    exact = "".join(rng.choice("xyz") for _ in range(200))
    return [*out, "1" + exact + "2", "3" + exact + "4", exact[1:] + "5", "6" + exact[:-1]]


def got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("runs, part", [(4096, 1 << 20), (1, 1 << 20), (2, 1 << 20), (4096, 150)])
def test_equals_brute_force(spark, texts, monkeypatch, runs, part):
    """Buckets refined whole, split by content, both; and texts worked on in overlapping parts."""
    monkeypatch.setattr(repeats, "BUCKET_RUNS", runs)
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "TOGETHER_BYTES", 1000 if runs == 4096 else 4 << 20)
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)], "doc_id long, text string, row int, key string").repartition(5)
    assert got(repeats.cut(docs)) == dict(enumerate(brute(texts)))


def test_repeated_rows_and_empty_tables(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("qwerty ") for _ in range(300))
    rows = [(1, long), (1, long), (None, "short"), (2, "other")]
    out = sorted(map(tuple, repeats.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    nothing = hashlib.sha256(b"").hexdigest()
    assert [r[:4] for r in out] == [(1, 300, 300, 1), (1, 300, 300, 1), (2, 5, 0, 0), (None, 5, 0, 0)] and out[0][4] == nothing
    assert repeats.cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = brute([r.text for r in rows])
    assert got(repeats.cut(docs)) == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_refinement_equals_brute_force():
    rng = random.Random(8)
    for alphabet, copies in (("ab", 3), ("a", 2), ("abcdefgh", 6)):
        base = "".join(rng.choice(alphabet) for _ in range(900))
        segments = []
        for _ in range(copies):
            k = rng.randrange(600)
            segments.append((base[k : k + rng.randrange(150, 500)] + rng.choice(["", "x", "ba"]) + base[:120]).encode())
        joined, ends = b"".join(segments), np.cumsum([len(x) for x in segments])
        starts = [p for a, e in zip(np.append(0, ends), ends, strict=False) for p in range(a, e - 199)]
        seen = collections.Counter(joined[p : p + 200] for p in starts)
        got = repeats.refined(np.frombuffer(joined, np.uint8), ends)
        assert got.tolist() == [p for p in starts if seen[joined[p : p + 200]] > 1]
    assert len(repeats.refined(np.zeros(0, np.uint8), np.zeros(0, np.int64))) == 0
