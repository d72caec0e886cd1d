import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.execute(mixing.ORACLE_SQL).fetchall(), key=str)


def by_hand(sizes):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), list(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.remove(s)
    return target


@pytest.fixture(scope="module")
def rows():
    out = [(i, "w " * (1 + i * 7 % 50), ["big", "big", "b", "ä", None, "tiny"][i % 6] if i < 300 else "big") for i in range(900)]
    return [*out, (None, "x y", "tiny"), (None, None, "b"), (7, "w " * 50, "big"), (7, "w " * 50, "big"), (2000, "", "empty"), (2001, None, "empty")]


def test_equals_the_oracle_and_targets_by_hand(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, copies int, target string").repartition(5)
    got = mixing.taken(docs).collect()
    assert sorted(map(tuple, got), key=str) == oracle(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = by_hand(sizes)
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(want[s], 6)) for s in sizes})
    for size in set(sizes.values()):
        mine = [r for r in got if r.source_size == size]
        same = [s for s in sizes if sizes[s] == size]
        assert abs(sum(r.taken for r in mine) - sum(want[s] for s in same)) <= 50 * len(same)
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_mixed_documents(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "doc_id long, text string, source string, epochs int, mix_size string, through double").dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.taken for r in mixing.taken(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}


def test_empty_and_bare_tables(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [tuple(r) for r in mixing.taken(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()] == [(1, 2, 2, 2.0, 2)]


def words(out):
    found = {}
    for r in out.collect():
        found[r.source] = found.get(r.source, 0) + len((r.text or "").split())
    return found


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_equal_rows_are_split_by_number(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "PART_ROWS", 64)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rows = [(None, "a b c d e f g h i j", "one")] * 1000 + [(5, "w " * 7, "two")] * 900 + [(None, f"v{i}", "two") for i in range(300)] + [(None, "w " * 7, "one"), (6, None, "two"), (6, "", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.taken(docs).collect()
    assert sorted(map(tuple, got), key=str) == oracle(rows)
    for size in (10_007, 6_600):
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    sizes = {"one": 10_007, "two": 6_600}
    more = docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1))).withColumn("mix_row", F.lit("c"))
    out = mixing.mix(more)
    assert out.columns == more.columns
    assert {s: n for s, n in words(out).items()} == {s: sum(r.taken for r in got if r.source_size == sizes[s]) for s in sizes}
