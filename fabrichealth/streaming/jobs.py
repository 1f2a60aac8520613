"""Structured Streaming jobs: ordered replay, windowed aggregation, and the operators of ``stateful`` as streams.

Streams run in event time, which starts after 1970: Spark's first watermark is that moment. ``end_of_data`` appends a marker that moves the watermark past the last row, so that a stream
which ends also closes its last windows; what comes later than the watermark is dropped and counted (``late_rows``).
State lives in RocksDB and in the checkpoint folder, so a restart continues where the last batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabrichealth.config import Thresholds
from fabrichealth.operators import alerting, rules
from fabrichealth.operators.folds import VERDICT_SCHEMA, _heads
from fabrichealth.streaming import stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and keyed state need the RocksDB store; other stores that were set are replaced."""
    spark.conf.set(PROVIDER, ROCKSDB)


def replay(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as a stream, a few files a trigger, in order of their time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def end_of_data(spark: SparkSession, path: str, schema, time: str, at_us: int) -> None:
    """Append a row to a replayed folder that holds nothing but a time: the watermark follows it, no result does."""
    kinds = {f.name: f.dataType for f in (spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema)}
    row = spark.range(1).select(*[(F.timestamp_micros(F.lit(at_us)) if name == time else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])
    row.coalesce(1).write.mode("append").parquet(path)


def windowed(events: DataFrame, time: str = "event_time", length: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """Counts and latency of each node and event-time window, each given once, when the watermark has passed its end."""
    return events.withWatermark(time, late).groupBy("node_id", F.window(time, length).alias("window")).agg(F.count("*").alias("n_events"), F.coalesce(F.sum("latency_ns"), F.lit(0)).alias("latency_total"), F.coalesce(F.max("latency_ns"), F.lit(0)).alias("latency_max"))


def verdict_stream(windows: DataFrame, t: Thresholds, weights: DataFrame | None = None, length_us: int = 3_000_000, origin_us: int = 0, late: str = "0 seconds", start: int | None = None, idle_windows: int | None = None) -> DataFrame:
    """Verdicts of a stream of window rows with window_end, the fold columns and the rule columns.

    Windows without a row are evaluated as empty ones when the watermark passes their end. ``weights`` is a static table
    as for the batch fold. ``idle_windows`` bounds the state: a node that is healthy and silent for so long is forgotten.
    """
    use_rocksdb(windows.sparkSession)
    rows = windows.withWatermark("window_end", late)
    if weights is not None:
        own = _heads(weights, None).select("node_id", F.get_json_object("head", "$[0]").alias("_weights"))
        rows = rows.join(own, "node_id", "left")
    step = stateful.Verdicts(t, rules.order(), length_us, origin_us, start, idle_windows)
    return rows.groupBy("node_id").transformWithState(step, VERDICT_SCHEMA, "Append", "EventTime")


def timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with event_us and event_time, on which the watermark runs."""
    return rows.withWatermark("event_time", late)


def bounded_lookups(rows: DataFrame, capacity: int, fresh_us: int | None = None, evict_us: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Lookups in a node's bounded map, and what leaves it, of a stream rows(node_id, event_us, event_time, event_id, item, value, put)."""
    use_rocksdb(rows.sparkSession)
    asked = timed(rows.select("node_id", "event_us", "event_time", "event_id", "item", "value", "put"), late)
    return asked.groupBy("node_id").transformWithState(stateful.BoundedMap(capacity, fresh_us, evict_us), stateful.BOUNDED_SCHEMA, "Append", "EventTime")


def as_of_stream(left: DataFrame, right: DataFrame, keys: list[str], max_age_us: int, late: str = "0 seconds") -> DataFrame:
    """Streams left and right(keys, event_us, event_time, event_id): every left row with the latest right row at or before it.

    One stream of both sides keeps one watermark, so neither side can run ahead of the other's rows.
    """
    use_rocksdb(left.sparkSession)
    side = lambda df, name: df.select(*keys, "event_us", "event_time", "event_id", F.lit(name).alias("side"))
    both = timed(side(left, "left").unionByName(side(right, "right")), late)
    kinds = dict(left.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", event_id long, event_us long, matched_id long, matched_us long"
    return both.groupBy(*keys).transformWithState(stateful.AsOf(tuple(keys), max_age_us), schema, "Append", "EventTime")


def notification_stream(alerts: DataFrame, late: str = "0 seconds", **settings) -> DataFrame:
    """Notifications of a stream alerts(node_id, alertname, severity, event_us, event_time): (group, at_us, kind), sent by timers."""
    use_rocksdb(alerts.sparkSession)
    keys = alerting.GROUP
    rows = timed(alerts.select(*keys, "event_us", "event_time"), late)
    make = lambda named: alerting.Notifier(named["severity"], **settings)
    return rows.groupBy(*keys).transformWithState(stateful.Groups(tuple(keys), make), alerting.NOTIFICATION_SCHEMA, "Append", "EventTime")


def to_tables(df: DataFrame, path: str, checkpoint: str, handlers=()):
    """Run to the end of the available input, write each batch to its own ``epoch`` folder, and give it to the handlers.

    A batch that is run again after a failure replaces its folder. Handlers may see such a batch twice.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.persist()
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for handler in handlers:
            handler(rows, epoch)
        rows.unpersist()

    return df.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Rows that the watermark was past, over the batches of a query that Spark remembers."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
