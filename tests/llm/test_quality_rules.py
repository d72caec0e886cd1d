import math
import random
import re

import numpy as np
import pytest

from tessera.llm import quality_rules as q


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def base(df):
    return sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect())


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "a", "a b", "a b c", "a a a a a", "é\xa0b #$ c\x85d", "x\n x\nx\n\n", "a b c a b c d e f", "\x0b a\rb \x0c"]
    texts += ["".join(rng.choice("ab c \n#\t") for _ in range(rng.randrange(200))) for _ in range(200)] + ["w " * 40000]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, kept int")
    assert base(q.rules(docs)) == [(i, brute(t)) for i, t in enumerate(texts)]


def test_outliers_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = q.rules(docs).collect()
    assert len(rows) == docs.count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted((r.doc_id, brute(texts[r.doc_id])) for r in rows) == base(q.rules(docs))
    open_rows = [r for r in rows if not r.base_failed and r.doc_id in quality]
    good = [r.kept for r in open_rows if quality[r.doc_id] == 1]
    bad = [r.kept for r in open_rows if quality[r.doc_id] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
    kept = q.reject(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows if r.kept}


def test_empty_tables(spark):
    assert q.rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [tuple(r) for r in q.rules(only).collect()] == [(1, 2, 8, 0, 0, 0, True, False, None)]
    assert q.reject(only).count() == 0


def test_repetition_alone_rejects(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(5))
    line = lambda n: " ".join(word() for _ in range(n))
    plain = ["\n".join(line(8) for _ in range(20)) for _ in range(300)]
    once = lambda n: [line(8) for _ in range(n)]
    both = "\n".join([*[line(2)] * 55, *once(15)])  # 110 of 230 words repeat, 54 of 70 lines are duplicates
    words = " ".join([*[line(9)] * 10, line(105)])  # 90 of 195 words repeat, one line
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*plain, both, words])], "doc_id long, text string, lang string, source string")
    rows = {r.doc_id: r for r in q.rules(docs).collect()}
    assert all(rows[i].kept for i in range(300))
    assert not rows[300].base_failed and rows[300].n_dup_lines == 54 and 40 * 230 <= 100 * rows[300].n_repeat_words <= 50 * 230
    assert not rows[301].base_failed and 40 * 195 <= 100 * rows[301].n_repeat_words <= 50 * 195
    assert not rows[300].kept and not rows[301].kept


def vector(text):
    n, chars, symbols, lines, repeated, _ = brute(text)
    all_lines = len([x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)])
    return [(chars + 250.0) / (n + 50), math.log1p(symbols / (n + 50)), 0.5 * math.sqrt(lines / (all_lines + 5)), 0.5 * math.sqrt(repeated / (n + 50))]


def middle(v):
    bins = sorted(np.floor(v / 0.01))
    return (bins[-(-len(bins) // 2) - 1] + 0.5) * 0.01


def distances(x, centre, cov):
    away = x - centre
    return np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away)


def concentrated(x, centre, cov, scale):
    """Mean and covariance of the closest 75 %, rows of the bin in which they end by the share that is missing."""
    bins = np.floor(np.log1p(distances(x, centre, cov)) / 0.02)
    weight, left = np.zeros(len(x)), 0.75 * len(x)
    for b in np.unique(bins):
        mine = bins == b
        weight[mine] = max(0.0, min(1.0, left / mine.sum()))
        left -= mine.sum()
    centre = np.average(x, axis=0, weights=weight)
    return centre, np.cov(x.T, aweights=weight, ddof=0) * scale + floors()


def floors():
    return np.diag([f * f for f in q.FLOORS.values()])


def estimate(x):
    medians = np.array([middle(c) for c in x.T])
    spread = np.diag([(1.4826 * middle(np.abs(c - m))) ** 2 for c, m in zip(x.T, medians, strict=True)])
    ends = []
    for centre, cov in ((medians, floors()), (medians, spread + floors()), (x.mean(0), np.cov(x.T, ddof=0) + floors())):
        for _ in range(q.MOST_STEPS):
            centre, cov = concentrated(x, centre, cov, 1.0)
        ends.append((np.linalg.slogdet(cov)[1], centre, cov))
    return concentrated(x, *min(ends, key=lambda e: e[0])[1:], 1.486)


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_verdicts_equal_brute_force(spark, monkeypatch, broadcast):
    """Groups of two populations, small groups that fall back to their language, and one that falls back to all."""
    monkeypatch.setattr(q, "BROADCAST_GROUPS", broadcast)
    rng = random.Random(4)

    def text(length, symbols, repeat):
        words = ["".join(rng.choice("abcdeilmnorst") for _ in range(max(1, int(rng.gauss(length, 1))))) for _ in range(rng.randrange(60, 200))]
        words = [w + "#" if rng.random() < symbols else w for w in words]
        lines = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        return "\n".join(lines + lines[: int(repeat * len(lines))])

    rows = []
    for lang, source, n in (("en", "a", 260), ("en", "b", 40), (None, "a", 150), ("xx", "", 20), ("xx", None, 130)):
        for k in range(n):
            kind = rng.random()
            rows.append((len(rows), text(5, 0.01, 0) if kind < 0.6 else text(7, 0.1, 0.05) if kind < 0.9 else text(rng.choice([3, 12]), rng.random(), 0.3), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in q.rules(docs).collect()}
    open_rows = [r for r in rows if not brute(r[1])[5]]
    x = {r[0]: vector(r[1]) for r in open_rows}
    groups = lambda key: {k: np.array([x[r[0]] for r in open_rows if key(r) == k]) for k in {key(r) for r in open_rows}}
    by_source, by_lang, every = groups(lambda r: r[2:]), groups(lambda r: r[2]), np.array(list(x.values()))
    done = {}
    for doc, _, lang, source in open_rows:
        key = (lang, source) if len(by_source[lang, source]) >= 100 else (lang,) if len(by_lang[lang]) >= 100 else ()
        if key not in done:
            done[key] = estimate(by_source[key] if len(key) == 2 else by_lang[lang] if key else every)
        want = distances(np.array([x[doc]]), *done[key])[0]
        assert got[doc].distance == pytest.approx(want, rel=2e-2, abs=1e-6)
        if abs(want - q.CUTOFF) > 0.03 * q.CUTOFF:
            assert got[doc].kept == (want <= q.CUTOFF)
    assert all(not got[r[0]].kept and got[r[0]].distance is None for r in rows if r[0] not in x)
    assert q.CUTOFF == pytest.approx(36, abs=0.2) and q.CONSISTENCY == pytest.approx(1.486, abs=1e-3)
