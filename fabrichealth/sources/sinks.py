"""Payloads for metric exposition, health, status, coverage and alerts, and a state table written on change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.operators.sketches import recent

c = F.col


def exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of metrics(name, labels map, value)."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(pairs == "", F.lit("")).otherwise(F.concat(F.lit("{"), pairs, F.lit("}"))), F.lit(" "), c("value").cast("string")).alias("line"))


def health_json(history: DataFrame) -> DataFrame:
    """(node_id, body): state, uptime and last window of each node."""
    now = history.groupBy("node_id").agg(F.max_by("state", "window_seq").alias("state"), F.count("*").alias("uptime_windows"), F.max("window_seq").alias("last_window"))
    return now.select("node_id", F.to_json(F.struct("state", "uptime_windows", "last_window")).alias("body"))


def status_json(history: DataFrame, alerts: DataFrame, n: int = 100) -> DataFrame:
    """(node_id, body): the last window's figures and the last ``n`` alerts."""
    now = history.groupBy("node_id").agg(F.max_by(F.struct("state", "window_seq"), "window_seq").alias("now"))
    last = recent(alerts, "node_id", [F.desc("window_seq"), F.asc("kind")], n).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("rank", "window_seq", "kind", "severity"))).alias("alerts"))
    return now.join(last, "node_id", "left").select("node_id", F.to_json(F.struct("now", F.coalesce("alerts", F.array()).alias("alerts"))).alias("body"))


def coverage_json(covered: DataFrame) -> DataFrame:
    rows = covered.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("capability", "backend", "quality"))).alias("rows"))
    return rows.select("node_id", F.to_json("rows").alias("body"))


def changed(rows: DataFrame, columns: list[str], order: str) -> Column:
    """Whether any of the columns differs from the node's previous row: what a durable state table is written on."""
    from pyspark.sql import Window as W

    before = W.partitionBy("node_id").orderBy(order)
    out = F.lag(F.lit(1)).over(before).isNull()
    for name in columns:
        out = out | ~F.lag(name).over(before).eqNullSafe(c(name))
    return out
