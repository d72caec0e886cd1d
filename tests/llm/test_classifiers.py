import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import labelled, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"  # few enough rows for a test, labels enough to learn from


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_misspellings_share_n_grams():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdehilmnorst") for _ in range(rng.randrange(2, 9)))
    rows = [(" ".join([*(word() for _ in range(60)), *(["dreadful"] if k % 3 == 0 else [])]), int(k % 3 == 0)) for k in range(240)]
    model = toxicity.train(rows)
    score = lambda t: model.score(model.words(toxicity.words_of(t)))
    assert score("dreadfull") > 0.5 > score("lovely")
    long = " ".join(word() for _ in range(400))
    assert score(f"{long} dreadful {long}") > score(f"{long} {long}")
    assert model.score([]) == 0.0 and toxicity.train([("a", 0)]).score([0.0]) == 0.0


@pytest.mark.parametrize("operator, column, least", [(toxicity, "toxic", 0.95), (quality_classifier, "quality", 0.85)])
def test_held_out_accuracy_and_folds(tables, operator, column, least):
    docs, labels = tables
    rows = operator.scored(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= operator.THRESHOLD) for r in rows)
    known = {r.doc_id: r[column] for r in labels.collect()}
    test = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert sum(r.predicted == known[r.doc_id] for r in rows if r.held_out and r.doc_id in known) >= 0.93 * len(test)
    assert auc >= least
    if operator is toxicity:
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        short = [r.predicted for r in rows if r.held_out and known.get(r.doc_id) == 1 and 50 <= len(toxicity.words_of(texts[r.doc_id])) < 150]
        assert sum(short) >= 0.85 * len(short)
        assert sum(r.predicted for r in rows if r.held_out and known.get(r.doc_id) == 0) <= 0.01 * len(neg)


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "w" * 5000, "x"), (3, "w" * 5000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, toxic int, quality int")
    for operator, score in ((toxicity, 0.0), (quality_classifier, 0.5)):
        out = operator.scored(docs, none).collect()
        assert len(out) == 5 and {r.score for r in out} == {score}
        assert operator.scored(docs.limit(0), none).count() == 0
    assert len(quality_classifier.statistics("")) == len(quality_classifier.statistics("a b\nc"))


def test_prior_estimate_is_near_the_truth():
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(30, 200))) + "."
    bad = lambda: " ".join("###" + rng.choice("ab") for _ in range(rng.randrange(30, 200)))
    model = quality_classifier.train([good() for _ in range(400)], [good() if rng.random() < 0.7 else bad() for _ in range(800)])
    assert 0.5 < model.prior < 0.85
    scores = model.score([quality_classifier.statistics(t) for t in (good(), bad())])
    assert scores[0] > 0.5 > scores[1]


@pytest.mark.parametrize("text", ["a", "ok", "abc", "abcd"])
def test_a_table_of_one_short_word(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.score) for r in toxicity.scored(docs, labels).collect()] == [(1, 0.0)]
    longer, owner = toxicity.grams_of([text, "longer"])
    assert sorted(toxicity.grams_of([text])[0]) == sorted(longer[owner == 0])


def test_scores_equal_a_plain_computation():
    """Both models' scores, word by word and unit by unit."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS).astype(np.float32), -1.5)
    for text in ("", "a", "one Two, three", "ünd " * 7 + "x" * 100, "word " * 5001):
        words = toxicity.words_of(text)
        log_odds = [float(np.mean([model.buckets[b] for b in toxicity.grams_of([w])[0]])) for w in words]
        clean = 1.0
        for i in range(0, len(words), toxicity.SEGMENT):
            bag = log_odds[i : i + toxicity.SEGMENT]
            clean *= 1 - 1 / (1 + math.exp(-(sum(bag) / len(bag) - 1.5)))
        assert model.score(model.words(words)) == pytest.approx(1 - clean, abs=1e-5)
    texts = ["", "One two.\nOne two.", "x" * 6000, "a #b " * 2000]
    rows = [quality_classifier.statistics(t) for t in texts]
    net = quality_classifier.Network(len(rows[0]), rng)
    mean, scale = rng.normal(size=len(rows[0])), rng.random(len(rows[0])) + 0.5
    got = quality_classifier.Model(net, mean, scale, 0.5).score(rows)
    for row, score in zip(rows, got, strict=True):
        x = [(v - m) / s for v, m, s in zip(row, mean, scale, strict=True)]
        hidden = [math.tanh(sum(x[i] * net.p[0][i][k] for i in range(len(x))) + net.p[1][k]) for k in range(quality_classifier.HIDDEN)]
        assert score == pytest.approx(1 / (1 + math.exp(-sum(h * w for h, w in zip(hidden, net.p[2], strict=True)) - net.p[3][0])))


def test_non_negative_risk_falls_and_its_gradient_is_right():
    """Plain risk by the definition; a step follows its numeric gradient, or steps back where it would be negative."""
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(1, 1, (30, 3)), rng.normal(0, 1, (40, 3)), 0.4
    net = quality_classifier.Network(3, rng)

    def parts():
        s = lambda x: 1 / (1 + np.exp(-net(x)))
        return -prior * np.log(s(p)).mean(), -np.log(1 - s(u)).mean() + prior * np.log(1 - s(p)).mean()

    def slope(part, k, at):
        values = []
        for d in (1e-5, -1e-5):
            net.p[k][at] += d
            values.append(sum(parts()[j] for j in part))
            net.p[k][at] -= d
        return (values[0] - values[1]) / 2e-5

    for wanted, part in ((True, (0, 1)), (False, (1,))):
        pull_p, pull_u, positive = quality_classifier.pulls(net(p), net(u), prior)
        assert positive == (parts()[1] >= 0)
        if positive == wanted:
            back = np.concatenate([pull_p, pull_u])
            h = np.tanh(np.concatenate([p, u]) @ net.p[0] + net.p[1])
            sign = 1 if wanted else -1
            assert (h.T @ back)[0] == pytest.approx(sign * slope(part, 2, 0), abs=1e-6)
            assert back.sum() == pytest.approx(sign * slope(part, 3, 0), abs=1e-6)
        prior = 3.0  # more than there can be: the unlabelled risk turns negative


def test_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b" * 50), (3, "c"), (4, "d"), (6, None), (8, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (4, 7), (6, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows = labelled.labelled_texts(docs, labels, "toxic", 10)
    fold = [i for i in (1, 2, 6) if zlib.crc32(str(i).encode()) % 5]
    assert rows == [({1: "a", 2: "b" * 50, 6: ""}[i], int(i == 1)) for i in fold]
    monkeypatch.setattr(labelled, "SAMPLE_BYTES", 10)
    assert sum(len(t) for t, _ in labelled.labelled_texts(docs, labels, "toxic", 10)) <= 10
    assert labelled.web_texts(docs.limit(0), 5) == []
