"""Scenario replay: recorded events with checkpoints through windows, rules and verdict, against the expected states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.config import Thresholds
from fabrichealth.operators import folds, rules, windows
from fabrichealth.schemas import COUNTER_KINDS

c = F.col
#: Fixed value: evaluations of the same events at a checkpoint, so that smoothing and dwell times are passed.
REPEATS = 7


def checkpoints(expectations: DataFrame) -> DataFrame:
    """scenario, after_event_index, expected_state and the number of each checkpoint, in order of the events."""
    place = F.row_number().over(W.partitionBy("scenario").orderBy("after_event_index"))
    return expectations.select("scenario", "after_event_index", "expected_state", (place - 1).cast("long").alias("checkpoint"))


def checkpoint_events(events: DataFrame, points: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Telemetry of ``events(scenario, position, kind, ...)``: at each checkpoint windows that all hold the events up to it.

    A node stands for a scenario. Order within a node is by window and position, so counters go on from window to window.
    """
    held = events.join(points.select("scenario", "after_event_index", "checkpoint"), "scenario").filter("position <= after_event_index")
    turns = held.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seq = c("checkpoint") * repeats + c("_turn")
    index = F.array_position(F.array(*[F.lit(k) for k in COUNTER_KINDS]), c("counter_kind")) - 1
    zero = lambda name: F.coalesce(c(name).cast("long"), F.lit(0)).alias(name)
    return turns.select(
        "scenario", F.xxhash64("scenario").alias("node_id"), seq.alias("window_seq"), seq.alias("ts_us"), c("position").cast("long").alias("event_id"), "kind", "cpu", F.coalesce("is_error", F.lit(False)).alias("is_error"),
        *[zero(x) for x in ("latency_ns", "bytes_req", "bytes_alloc", "work_done", "budget", "len")], F.coalesce("port_num", F.lit(0)).alias("port"), index.cast("int").alias("counter"), c("counter_value").cast("long").alias("reading"),
    )


def replayed(events: DataFrame, expectations: DataFrame, t: Thresholds = Thresholds(), weights=None, repeats: int = REPEATS) -> DataFrame:
    """scenario, after_event_index, expected_state, state and agrees: the state in the last window of each checkpoint."""
    points = checkpoints(expectations)
    told = checkpoint_events(events, points, repeats)
    seen = folds.verdicts(rules.fold_input(windows.health_windows(told, t.num_cpus, derive_cq=False, stall_ns=t.stall_ns), t), t, weights)
    last = points.select("*", F.xxhash64("scenario").alias("node_id"), ((c("checkpoint") + 1) * repeats - 1).alias("window_seq"))
    joined = last.join(seen.select("node_id", "window_seq", "state"), ["node_id", "window_seq"], "left")
    return joined.select("scenario", "after_event_index", "expected_state", "state", c("expected_state").eqNullSafe(c("state")).alias("agrees"))
