"""As-of joins, pairings and enrichment joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], max_age: int | None = None) -> DataFrame:
    """Add the ``columns`` of the latest ``right`` row at or before each ``left`` row of the same keys.

    One union and one window by the keys, so no pair of rows is ever formed; ``max_age`` leaves older ones out.
    """
    packed = F.struct(F.col(right_time).alias("_at"), *[F.col(x) for x in columns]).alias("_r")
    one = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed, F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_l"))
    two = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_r"), F.struct("*").alias("_l"))
    order = W.partitionBy(*keys).orderBy("_t", "_side")
    last = F.last("_r", ignorenulls=True).over(order)
    rows = one.unionByName(two).withColumn("_last", last).filter("_side = 1")
    if max_age is not None:
        rows = rows.withColumn("_last", F.when(F.col("_t") - F.col("_last._at") <= max_age, F.col("_last")))
    return rows.select("_l.*", F.col("_last._at").alias("matched_at"), *[F.col(f"_last.{x}").alias(x) for x in columns])


def pair_calls(events: DataFrame, keys: list[str], order: list[str], is_return: Column, time: str) -> DataFrame:
    """Returns with the entry right before them on the same thread: an entry serves one return."""
    frame = W.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("_return", is_return)
    rows = rows.withColumns({"_prev": F.lag("_return").over(frame), "entered_at": F.lag(time).over(frame)})
    return rows.filter(F.col("_return") & (F.col("_prev") == F.lit(False))).withColumn("took", F.col(time) - F.col("entered_at")).drop("_return", "_prev")


def latest_owner(rows: DataFrame, keys: list[str], owner: str, order: list[str]) -> DataFrame:
    """The last writer of each key."""
    return rows.groupBy(*keys).agg(F.max_by(owner, F.struct(*order)).alias(owner))


def blast_radius(owners: DataFrame, processes: DataFrame) -> DataFrame:
    """(node_id, processes, jobs, pods, summary) of the distinct owners that are known processes."""
    known = owners.select("node_id", "pid").distinct().join(processes, ["node_id", "pid"])
    rolled = known.groupBy("node_id").agg(F.count("*").alias("processes"), F.sort_array(F.collect_set("job_id")).alias("jobs"), F.sort_array(F.collect_set("pod")).alias("pods"), F.sort_array(F.collect_set("comm")).alias("names"))
    named = lambda label, col: F.when(F.size(col) > 0, F.concat(F.lit(label), F.array_join(col, ",")))
    return rolled.withColumn("summary", F.concat_ws("; ", named("jobs ", "jobs"), named("pods ", "pods"), named("processes ", "names")))


def overlay(nodes: DataFrame, profiles: DataFrame, defaults: dict, broadcast_limit: int = 10_000) -> DataFrame:
    """Settings of each node: its fabric's profile where it has a value, else the default."""
    small = F.broadcast(profiles) if profiles.count() <= broadcast_limit else profiles
    renamed = small.select("fabric", *[F.col(k).alias(f"_{k}") for k in defaults if k in profiles.columns])
    joined = nodes.join(renamed, "fabric", "left")
    return joined.select(*nodes.columns, *[(F.coalesce(f"_{k}", F.lit(v)) if k in profiles.columns else F.lit(v)).alias(k) for k, v in defaults.items()])


def inhibit(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Drop degraded alerts where a critical one with equal keys fires."""
    critical = alerts.filter("severity = 'CRITICAL'").select(*keys).distinct()
    return alerts.filter("severity = 'DEGRADED'").join(critical, keys, "left_anti").unionByName(alerts.filter("severity <> 'DEGRADED'"))
