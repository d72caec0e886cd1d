import random
from collections import Counter

import corpus_pipeline
import pytest
from tessera.llm import bpe, mixing, pii, quality_rules

from test_minhash import brute

SF = "/root/testdata/sf0.001"


def test_stages_and_run_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.rules(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    unique = {d for d, (_, c) in brute(sorted(texts.items()), 5).items() if d == c}
    redacted = {d: pii.redacted(texts[d]) for d in unique}
    rows = [(d, redacted[d], r.source) for r in docs.collect() if (d := r.doc_id) in unique]
    plan = {r.doc_id: (r["size"], r.taken) for r in mixing.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= unique
    assert all(times[d] * size == taken for d, (size, taken) in plan.items())
    codec = bpe.codec(bpe.default_vocabulary())
    assert all(bytes(r.ids) == codec.encode(redacted[r.doc_id]) and r.n_tokens == len(r.ids) // 4 for r in out)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    assert [len(corpus_pipeline.STAGES)] == [5]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(3, 8))) for _ in range(n))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, mix_size double, component_id string"


def test_defined_results(spark, tmp_path):
    """Nulls, repeated rows, copies, a long text and columns of clashing names."""
    rows = [(i, words(i, 120), "en", "s", 1) for i in range(60)]
    rows += [(7, words(7, 120), "en", "s", 1)] * 2 + [(100, words(7, 120) + " end", "en", "s", 1), (101, None, "en", "s", 1), (102, "", None, None, None), (103, words(103, 120), None, None, None)]
    rows += [(None, words(104, 120), "en", "s", 1), (105, words(105, 30_000), "en", "s", 1), (106, words(106, 119) + " a@b.co", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "r", 1, 2.0, None) for r in rows], COLUMNS).repartition(3)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= {*range(60), None, 103, 105, 106} and 101 not in times and 100 not in times
    assert all(times[i] <= 3 for i in times)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in kept)[7] == 1 and 100 not in {r.doc_id for r in kept}
    assert len({r.n_tokens for r in out if r.doc_id == 105}) == 1 and all(len(r.ids) == 4 * r.n_tokens for r in out)


@pytest.mark.parametrize("rows", [[], [(1, "few words", "en", "s", 1)]])
def test_tables_of_which_nothing_is_left(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "r", 1, 2.0, None) for r in rows], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
