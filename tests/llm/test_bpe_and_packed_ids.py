import hashlib
import io
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packed_ids

TEXTS = [None, "", " \n\t ", "Hello World<|endoftext|>foo's", "ÉÀ x y\x1cz ΣΑΣ 日本1234 é ́a\x85b c a<|startoftext|>", "İstanbul ǅ ﬁ '''s'T 'S 'RE x", "ab" * 5000, "x", "x", "a <| b |> <|endoftext|", "éé ½²"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", None) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, path string")


def test_ids_and_text_equal_the_librarys(spark, docs, library):
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode_operators(spark, docs, library):
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got[3] == library.decode(library.encode(TEXTS[3], add_special_tokens=False).ids, skip_special_tokens=False)
    assert got[0] == got[1] == ""


def test_whole_sample_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    for r in bpe.round_trip_digests(rows).collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()


def test_merge_skips_stale_entries():
    # ab before bc: in "abc" the queued pair bc is stale once ab has been merged
    ranks = {(0 << 20 | 1): (0 << 20 | 3), (1 << 20 | 2): (1 << 20 | 4), (3 << 20 | 2): (2 << 20 | 5)}
    assert bpe.merge_symbols([0, 1, 2], ranks) == [5]
    assert bpe.merge_symbols([1, 2, 0, 1], ranks) == [4, 3]
    assert bpe.merge_symbols([], ranks) == []


def test_cache_keeps_within_its_bound():
    cache = bpe.Cache(len, 3, 5)
    assert [cache[x] for x in ("a", "bb", "ccc", "dddd", "a", "longer than five")] == [1, 2, 3, 4, 1, 16]
    assert len(cache) <= 3 and len(cache.old) <= 3


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
@pytest.mark.parametrize("kind", ["skewed", "wide", "constant"])
def test_files_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"skewed": rng.zipf(1.3, n) % 49408, "wide": rng.integers(0, 2**32, n), "constant": np.full(n, 7)}[kind].astype("<u4")
    parts = np.split(ids, np.sort(rng.integers(0, n + 1, 20)))
    f = io.BytesIO()
    w = packed_ids.Writer(f)
    for i, p in enumerate(parts):
        w.add(i or None, p.tobytes())
    w.close()
    r = packed_ids.Reader(f)
    got = list(r.documents())
    assert [d for d, _ in got] == [None, *range(1, len(parts))]
    assert all(np.array_equal(p, g) for p, (_, g) in zip(parts, got, strict=True))
    assert np.array_equal(r.blocks(0, 1), ids[:256])


def test_written_and_read(spark, library):
    rows = [(5, "b b"), (None, "null id"), (3, None), (9, ""), (5, "a"), (1, "Hello <|endoftext|> world")]
    got = packed_ids.written_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    start = 0
    want = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packed_ids.written_and_read(empty).count() == 0
    assert bpe.round_trip_digests(empty).count() == 0
