"""Idempotent aggregation over dynamic metric maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import coerce_float
from .events import first_wins, not_value

KEY = ["task_id", "node_id", "batch_uid"]


def recorded(rows: DataFrame, order: list[str], on_retry: str = "first") -> DataFrame:
    """Metrics rows as a unique key would leave them: the first write of each batch.

    on_retry="latest_success" keeps a batch's last row that did not fail, where there is one.
    """
    if on_retry == "latest_success":
        rest = [c for c in rows.columns if c not in KEY]
        good = ~F.coalesce(F.col("failed"), F.lit(False))
        out = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(good.alias("_good"), *order)).alias("_row"))
        return out.select(*[F.col(c) if c in KEY else F.col(f"_row.{c}").alias(c) for c in rows.columns])
    return first_wins(rows, KEY, order)


def aggregate(rows: DataFrame, mode: str = "sum", exact_scale: int | None = None) -> DataFrame:
    """rows (task_id, node_id, failed, metrics map<string,string>) -> task_id, node_id, key, value.

    Failed rows are left out, final ones count; values that are no numbers are skipped. Any mode but "mean" is a sum;
    a mean is over the rows that have the key. With exact_scale sums are decimal, so the order of rows plays no part; a number of 10^(28 - exact_scale) or more is
    then an error, never a silent loss.
    """
    pairs = rows.where(not_value("failed", True)).select("task_id", "node_id", F.explode("metrics").alias("key", "text"))
    numbers = pairs.select("task_id", "node_id", "key", coerce_float("text").alias("v")).where("v is not null")
    v = F.col("v") if exact_scale is None else F.col("v").cast(f"decimal(28,{exact_scale})")
    out = numbers.groupBy("task_id", "node_id", "key").agg(F.sum(v).cast("double").alias("total"), F.count("*").alias("n"))
    return out.select("task_id", "node_id", "key", (F.col("total") / F.col("n") if mode == "mean" else F.col("total")).alias("value"))


def as_maps(values: DataFrame) -> DataFrame:
    """One map of statistics for each node."""
    return values.groupBy("task_id", "node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("stats"))
