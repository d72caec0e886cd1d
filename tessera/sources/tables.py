"""Scans of stored tables and the message schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One envelope for commands, status events, signals, queries and replies.
ENVELOPE = "v int, msg_type string, role string, corr_id string, dedup_id string, task_id string, node_id string, step_type string, attempt_epoch int, ts_ms long, payload string, target_worker_id string"

# Fixed values of the envelope's enumerations.
MESSAGE_TYPES = ("command", "event", "signal", "query", "reply")
RUN_STATES = ("queued", "running", "deferred", "cancelling", "finished", "failed")


def scan(spark: SparkSession, sf_dir: str, name: str, predicate: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table's rows by predicate and columns; both reach the Parquet scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if predicate is not None:
        df = df.where(predicate)
    return df.select(*columns) if columns else df


def lookup(df: DataFrame, **equal) -> DataFrame:
    """At most one row that has the given values."""
    for k, v in equal.items():
        df = df.where(F.col(k) == F.lit(v))
    return df.limit(1)


def parse_envelopes(values: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts to envelope columns; malformed texts give rows of nulls, which the router drops."""
    return values.select(F.from_json(column, ENVELOPE).alias("e")).select("e.*")


def routed(envelopes: DataFrame, msg_type: str, role: str | None = None, step_type: str | None = None, worker_id: str | None = None) -> DataFrame:
    """Envelopes of a type (and role and step) that are addressed to nobody in particular, or to this worker."""
    out = envelopes.where(F.col("msg_type") == msg_type)
    if role:
        out = out.where(F.col("role") == role)
    if step_type:
        out = out.where(F.col("step_type") == step_type)
    if worker_id:
        out = out.where(F.col("target_worker_id").isNull() | (F.col("target_worker_id") == worker_id))
    return out


def count_where(df: DataFrame, predicate: Column | str, keys: list[str] | None = None) -> DataFrame:
    """Number of rows that meet a predicate, as n, in all or by keys (0 for keys whose rows do not)."""
    met = F.count_if(F.expr(predicate) if isinstance(predicate, str) else predicate).alias("n")
    return df.groupBy(*keys).agg(met) if keys else df.agg(met)


def is_absent(field: str, present: str) -> Column:
    """Whether a document lacks a field; present holds the names of the fields it has, since a null is a value."""
    return ~F.coalesce(F.array_contains(present, F.lit(field)), F.lit(False))


def signals_for(envelopes: DataFrame, worker_id: Column | str, signal: str = "CANCEL") -> DataFrame:
    """Signals of a kind that are addressed to nobody in particular or to the worker in the row."""
    me = F.col(worker_id) if isinstance(worker_id, str) else worker_id
    addressed = F.col("target_worker_id").isNull() | (F.col("target_worker_id") == me)
    return envelopes.where(addressed & (F.get_json_object("payload", "$.sig") == signal))


def to_envelopes(rows: DataFrame) -> DataFrame:
    """Envelope columns to one JSON text each (column value); fields without a value are left out."""
    names = [f.split()[0] for f in ENVELOPE.split(", ")]
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in names if c in rows.columns])).alias("value"))


def json_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Status events from text files of JSON lines in a folder, as a stream: the source where there is no broker."""
    return parse_envelopes(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def kafka_options(servers: str, topics: str, group: str | None = None, start: str = "latest") -> dict[str, str]:
    """Reader options: a topic pattern, a consumer group (Spark keeps offsets in the checkpoint, not in the group), the start."""
    out = {"kafka.bootstrap.servers": servers, "subscribePattern": topics, "startingOffsets": start}
    return out | ({"kafka.group.id": group} if group else {})


def kafka_events(spark: SparkSession, servers: str, topics: str, group: str | None = None, start: str = "latest") -> DataFrame:
    """Status events from Kafka, from the latest offsets on. Needs Spark's Kafka package, so no test runs it here."""
    raw = spark.readStream.format("kafka").options(**kafka_options(servers, topics, group, start)).load()
    return parse_envelopes(raw.select(F.col("value").cast("string").alias("value")))


def kafka_rows(outbox: DataFrame) -> DataFrame:
    """Outbox rows as Kafka's writer takes them: topic, key and value; its producer is idempotent by default."""
    return outbox.select("topic", F.col("key").cast("binary").alias("key"), F.col("envelope").cast("binary").alias("value"))


def kafka_sink(outbox: DataFrame, servers: str) -> None:
    """Write outbox rows to Kafka. Needs Spark's Kafka package, so no test runs it here."""
    kafka_rows(outbox).write.format("kafka").option("kafka.bootstrap.servers", servers).save()
