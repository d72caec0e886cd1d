"""Quality rules (operator 5): counted statistics, fixed base rules, and robust multivariate outliers.

The statistics are counted in whole texts with SQL functions. A document fails the base rules if it has fewer than 50
words or more than half of its words stand in repeated three-word windows. The others form vectors of transformed
statistics; for each language and source a minimum-covariance-determinant estimate is made by concentration steps:
distances from the current estimate, the COVERAGE part of the group with the smallest distances, its mean and
covariance, and so on, until the determinant stops falling. Three deterministic starts (medians with least scales,
medians with median absolute deviations, all rows' mean and covariance) are led to their ends side by side, and the
estimate of least determinant is kept. A document is kept if its squared Mahalanobis distance stays within a quantile
of the chi-square distribution. Groups of fewer than LEAST_ROWS use the estimate of their language, and such languages
that of all documents.

A concentration step is one aggregation to (group, start, distance bin) with counts and moments, combined before its
shuffle, so neither a hot source nor the number of documents reaches a single task; the bins of a group, not its rows,
are then summed up to the covered part. The bin in which it ends counts by the share that is still missing, so exactly
COVERAGE of a group is covered, also where distances tie. Only DataFrame functions are used.

Defined results: a null or empty text has zeros and fails the base rules; null languages and sources are groups of
their own; repeated rows repeat their results; missing lang or source columns count as null; where no document passes
the base rules none is kept; other columns are ignored by rules() and kept by reject().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, columns_or_null, materialise, release

MIN_WORDS = 50
#: Part of a group that an estimate covers.
COVERAGE = 0.75
#: Steps after which a start is left as it is; the determinant settles well before.
MOST_STEPS = 20
LEAST_ROWS = 100
#: Share of normally distributed documents that the rules may reject.
TAIL = 3e-7
#: Least standard deviation of each transformed statistic: most documents have no symbols and no repetition at all.
#: x3 stays below 0.5 and x4, past the base rules, below 0.36; their floors let either reject a document by itself.
FLOORS = {"x1": 0.25, "x2": 0.04, "x3": 0.05, "x4": 0.04}
X = tuple(FLOORS)
STARTS = 3
#: Prior counts by which the ratios of short texts are drawn to common values.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES = 50.0, 5.0, 5.0
WHITE = " \t\n\x0b\f\r"
#: Estimates up to so many groups are broadcast; more are joined by key.
BROADCAST_GROUPS = 20_000


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


#: Squared distance up to which documents are kept.
CUTOFF = chi_square_quantile(1.0 - TAIL, len(X))
#: What the covariance of the covered part is multiplied by to be that of normal documents.
CONSISTENCY = COVERAGE / chi_square(chi_square_quantile(COVERAGE, len(X)), len(X) + 2)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def statistics(documents: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, lang, source and the counted statistics, and the rows themselves as a struct if wanted. No shuffle."""
    wanted = {"doc_id": "long", "text": "string", "lang": "string", "source": "string"}
    if keep_rows:
        row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
        have = set(documents.columns)
        d = documents.select(row, *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])
    else:
        d = columns_or_null(documents, wanted)
    d = d.withColumn("w", words_of(F.col("text")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    d = d.withColumn("h", F.when(F.col("n_words") >= 3, windows))
    # Only texts in which a window repeats sort their windows; equal ones then stand side by side.
    d = d.withColumn("p", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, j: F.get("p", k)["h"] == F.get("p", j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    d = d.withColumn("at", F.when(F.col("p").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get("p", k)["i"]))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n")), lambda acc: acc["n"])
    d = d.withColumn("lines", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    return d.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        *(["row"] if keep_rows else []),
    )


def _vectors(stats: DataFrame) -> DataFrame:
    n = F.col("n_words") + PRIOR_WORDS
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.withColumn("base_failed", failed)
        .withColumn("x1", (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n)
        .withColumn("x2", F.log1p(F.col("n_symbols") / n))
        .withColumn("x3", F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + PRIOR_LINES)) * 0.5)
        .withColumn("x4", F.sqrt(F.col("n_repeat_words") / n) * 0.5)
        .withColumn("by_source", F.to_json(F.array("lang", "source")))
        .withColumn("by_lang", F.to_json(F.array("lang")))
    )


def _with_estimates(rows: DataFrame, estimates: DataFrame, key: str) -> DataFrame:
    """Estimates are a row for each group: broadcast after counting them, joined by key beyond BROADCAST_GROUPS."""
    return rows.join(_grouped(estimates), key)


def _bin(v: Column, width: float) -> Column:
    return F.floor(v / width).cast("long")


def _medians(rows: DataFrame, prefix: str) -> DataFrame:
    """g and <prefix><x>: the medians of each group's columns, as centres of bins."""
    width = 0.01
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(x).alias("v")) for x in X])).alias("e")).select("g", "e.x", _bin(F.col("e.v"), width).alias("bin"))
    counted = long.groupBy("g", "x", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "x")
    up_to = counted.withColumn("below", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    middle = up_to.where("2 * below >= all").groupBy("g", "x").agg(F.min("bin").alias("bin"))
    return middle.groupBy("g").agg(*[F.max(F.when(F.col("x") == x, (F.col("bin") + 0.5) * width)).alias(f"{prefix}{x}") for x in X])


def _distance(at: dict[str, Column] | None = None) -> Column:
    """Squared distance by the triangular factor columns: forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(X):
        v = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            v = v - F.col(f"c{i}{j}") * z[j]
        z.append(v / F.col(f"c{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """Cholesky factor (columns c<row><column>) of each group's covariance, floored on its diagonal."""
    out = moments
    for i, x in enumerate(X):
        for j, y in enumerate(X[: i + 1]):
            v = F.col(f"v{i}{j}") * scale
            if i == j:
                v = v + FLOORS[x] ** 2
            for k in range(j):
                v = v - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"c{j}{j}"))
    log_det = sum((2.0 * F.log(f"c{i}{i}") for i in range(1, len(X))), 2.0 * F.log("c00"))
    return out.select("g", "start", "n_rows", log_det.alias("log_det"), *[f"m_{x}" for x in X], *[f"c{i}{j}" for i in range(len(X)) for j in range(i + 1)])


PAIRS = [(i, j) for i in range(len(X)) for j in range(i + 1)]
SUMS = [*[f"s_{x}" for x in X], *[f"q{i}{j}" for i, j in PAIRS]]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Count and sums of the columns and their products."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s_{x}") for x in X], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS])


def _moments(sums: DataFrame) -> DataFrame:
    """Means and covariances from (possibly weighted) counts and sums."""
    mean = lambda x: F.col(f"s_{x}") / F.col("n")
    return sums.select("g", "start", "n_rows", *[mean(x).alias(f"m_{x}") for x in X], *[(F.col(f"q{i}{j}") / F.col("n") - mean(X[i]) * mean(X[j])).alias(f"v{i}{j}") for i, j in PAIRS])


def _starts(fit: DataFrame) -> DataFrame:
    """The first estimates of every group: see the module."""
    centres = materialise(_medians(fit, "m_"), "estimates")
    away = _with_estimates(fit, centres, "g").select("g", *[F.abs(F.col(x) - F.col(f"m_{x}")).alias(x) for x in X])
    spreads = centres.join(_medians(away, "d_"), "g")
    diagonal = lambda of: [(of(X[i]) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in PAIRS]
    none = F.lit(0).cast("long").alias("n_rows")
    least = centres.select("g", F.lit(0).alias("start"), none, *[f"m_{x}" for x in X], *diagonal(lambda x: F.lit(0.0)))
    spread = spreads.select("g", F.lit(1).alias("start"), none, *[f"m_{x}" for x in X], *diagonal(lambda x: (F.col(f"d_{x}") * 1.4826) ** 2))
    every = _moments(_summed(fit, "g").withColumn("n_rows", F.col("n")).withColumn("start", F.lit(2)))
    return materialise(_factor(least.unionByName(spread).unionByName(every), 1.0), "estimates")


def _concentrate(rows: DataFrame, estimates: DataFrame, scale: float) -> DataFrame:
    """One step: the estimates of the closest part of each group, from each start."""
    by_bin = _summed(_with_estimates(rows, estimates, "g").withColumn("bin", _bin(F.log1p(_distance()), 0.02)), "g", "start", "bin")
    w = Window.partitionBy("g", "start")
    held = by_bin.withColumn("before", F.sum("n").over(w.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    share = F.least(F.lit(1.0), (COVERAGE * F.col("all") - F.col("before")) / F.col("n"))
    held = held.withColumn("share", share).where("share > 0")
    total = held.groupBy("g", "start").agg(F.first("all").alias("n_rows"), *[F.sum(F.col(c) * F.col("share")).alias(c) for c in ("n", *SUMS)])
    return materialise(_factor(_moments(total), scale), "estimates")


def estimates(vectors: DataFrame) -> DataFrame:
    """g, n_rows, centre and factor of every source of a language, every language, and all documents."""
    fit = vectors.where("not base_failed").select(F.explode(F.array("by_source", "by_lang", F.lit("*"))).alias("g"), *X)
    now = _starts(fit)
    for step in range(MOST_STEPS):
        after = _concentrate(fit, now, 1.0)
        fell = now.select("g", "start", F.col("log_det").alias("was")).join(after.select("g", "start", "log_det"), ["g", "start"]).agg(F.max(F.col("was") - F.col("log_det"))).first()[0]
        release(now)
        now = after
        if step and (fell is None or fell < 1e-3):  # the first step leaves the start's own scale
            break
    best = materialise(now.groupBy("g").agg(F.min(F.struct("log_det", "start")).alias("b")).select("g", "b.start"), "estimates")
    last = _concentrate(fit, now.join(_grouped(best), ["g", "start"], "left_semi"), CONSISTENCY)
    release(now, best)
    return last


def _grouped(estimates: DataFrame) -> DataFrame:
    return F.broadcast(estimates) if estimates.count() <= BROADCAST_GROUPS else estimates


def _chosen(stats: DataFrame) -> DataFrame:
    """by_source with the estimate that its documents are held against."""
    found = estimates(stats)
    numbers = [c for c in found.columns if c not in ("g", "start", "n_rows", "log_det")]
    level = lambda name, rows: rows.select(F.col("g").alias(name), F.struct(*numbers).alias(f"e_{name}"))
    enough = found.where(F.col("n_rows") >= LEAST_ROWS)
    groups = stats.select("by_source", "by_lang", F.lit("*").alias("by_all")).distinct()
    chosen = groups.join(level("by_source", enough), "by_source", "left").join(level("by_lang", enough), "by_lang", "left").join(level("by_all", found.where("g = '*'")), "by_all", "left")
    chosen = materialise(chosen.select("by_source", F.coalesce("e_by_source", "e_by_lang", "e_by_all").alias("e")).select("by_source", "e.*"), "chosen")
    release(found)
    return chosen


def _judged(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds distance and kept. Where no document passes the base rules there are no estimates, and nothing to keep."""
    distance = F.when(~F.col("base_failed"), _distance())
    judged = _with_estimates(vectors, chosen, "by_source").withColumn("distance", distance)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)))


def rules(documents: DataFrame) -> DataFrame:
    """Statistics of every document, base_failed, distance (squared; null if base_failed) and kept."""
    stats = materialise(_vectors(statistics(documents)), "statistics")
    return _judged(stats, _chosen(stats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def reject(documents: DataFrame) -> DataFrame:
    """documents that the rules keep; all columns stay.

    Texts are counted once: the rows are written next to their statistics, so null and repeated doc_ids need no care,
    and the estimates read the statistics alone.
    """
    stats = materialise(_vectors(statistics(documents, keep_rows=True)), "statistics")
    return _judged(stats.select("row", "by_source", "base_failed", *X), _chosen(stats)).where("kept").select("row.*")
