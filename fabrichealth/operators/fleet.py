"""Fleet queries over health history, port deltas and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.functions import exprs as X

c = F.col


def latest(history: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row's columns of each key, combined before the shuffle."""
    return history.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_v")).select(*keys, "_v.*")


def state_counts(history: DataFrame) -> DataFrame:
    """One row with the nodes in each state; 0 where there is none."""
    now = latest(history, ["node_id"], "window_seq", ["state"])
    return now.agg(*[F.count_if(c("state") == s).alias(s.lower()) for s in ("HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING")])


def worst_score(history: DataFrame) -> DataFrame:
    now = latest(history, ["node_id"], "window_seq", ["effective"])
    return now.agg(F.coalesce(F.max(X.milliunits(c("effective"))) / 1000, F.lit(0.0)).alias("worst_score"))


def transitions(history: DataFrame) -> DataFrame:
    """Changes of state; every node starts healthy."""
    before = F.coalesce(F.lag("state").over(W.partitionBy("node_id").orderBy("window_seq")), F.lit("HEALTHY"))
    return history.withColumn("from_state", before).filter(c("from_state") != c("state")).select("node_id", "window_seq", "from_state", c("state").alias("to_state"))


def timeline(history: DataFrame) -> DataFrame:
    """Stretches of one state: node, state, first and last window, and length."""
    order = W.partitionBy("node_id").orderBy("window_seq")
    changed = F.when(F.lag("state").over(order) == c("state"), 0).otherwise(1)
    islands = history.withColumn("_changed", changed).withColumn("stretch", F.sum("_changed").over(order))
    return islands.groupBy("node_id", "stretch", "state").agg(F.min("window_seq").alias("first_window"), F.max("window_seq").alias("last_window"), F.count("*").alias("windows"))


def recent_alerts(alerts: DataFrame, now: DataFrame, span: int, keys: list[str]) -> DataFrame:
    """Alerts of the last ``span`` windows up to that of the one row ``now(now)`` by keys; without keys one row, 0 when there is none."""
    dated = alerts.join(F.broadcast(now), (c("window_seq") > c("now") - span) & (c("window_seq") <= c("now")))
    return dated.groupBy(*keys).agg(F.count("*").alias("alerts"))


def increase(series: DataFrame, value: str, span: int) -> Column:
    """Sum of a window figure over the last ``span`` windows of the node."""
    return F.sum(value).over(W.partitionBy("node_id").orderBy("window_seq").rangeBetween(-(span - 1), 0))


def resample(series: DataFrame, value: Column, step: int) -> DataFrame:
    """The last value of each ``step`` windows."""
    return series.groupBy("node_id", F.floor(c("window_seq") / step).alias("step")).agg(F.max_by(value, "window_seq").alias("value"))


def node_table(history: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per node: state, score, errors and NAPI use of its last window."""
    a = latest(history, ["node_id"], "window_seq", ["state", "effective"])
    b = latest(windows.select("node_id", "window_seq", X.all_errors().alias("errors"), X.napi_utilisation().alias("napi_pct")), ["node_id"], "window_seq", ["errors", "napi_pct"])
    return a.join(b, "node_id", "full_outer").select("node_id", "state", X.milliunits(c("effective")).alias("score"), "errors", "napi_pct")


def unreachable(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Every inventory node with its last state, or ``unreachable``."""
    now = latest(history, ["node_id"], "window_seq", ["state"])
    return targets.join(now, "node_id", "left").withColumn("state", F.coalesce("state", F.lit("unreachable")))


#: The counters in a link's error total, which differ from those of the rules.
LINK_ERRORS = ("symbol_errors", "rcv_errors", "xmit_discards", "remote_physical_errors", "integrity_errors", "buffer_overruns", "rxe_seq_error", "rxe_retry_exceeded")


def link_errors(ports: DataFrame) -> DataFrame:
    return ports.select("node_id", "port", "window_seq", sum((c(x) for x in LINK_ERRORS[1:]), c(LINK_ERRORS[0])).alias("errors"))


def link_series(ports: DataFrame, columns: list[str]) -> DataFrame:
    """Long rows (node, port, window, series, value)."""
    return ports.unpivot(["node_id", "port", "window_seq"], columns, "series", "value")


def link_throughput(ports: DataFrame) -> DataFrame:
    return ports.select("node_id", "port", "window_seq", (c("rcv_data") * 4).alias("rx_bytes"), (c("xmit_data") * 4).alias("tx_bytes"), X.traffic_bytes().alias("bytes"), X.traffic_packets().alias("packets"))


def metrics_long(windows: DataFrame, gauges: dict[str, Column]) -> DataFrame:
    """Metric rows (node_id, window_seq, name, value)."""
    return windows.select("node_id", "window_seq", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in gauges.items()])))
