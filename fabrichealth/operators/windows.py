"""Window aggregates: counter deltas, one row per node and window, the dense spine, snapshot deltas.

Every step keys on the node first. Aggregates combine before the shuffle; deltas order within one counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.schemas import DELTAS
from fabrichealth.sources.store import settle

#: What an empty window holds: every figure 0.
SUMS = (
    "n_events", "slab_allocs", "slab_frees", "slab_latency_total", "slab_latency_max", "slab_bytes_req", "slab_bytes_alloc", "irq_total",
    "napi_polls", "napi_work", "napi_budget", "rx_packets", "rx_bytes", "completions", "completion_errors", "completion_latency_total",
    "completion_latency_max", "cq_completions", "cq_latency_total", "cq_latency_max", "cq_stalls",
)


def saturating_delta(value: Column, previous: Column) -> Column:
    """The rise since the previous reading; 0 for a first reading and for a reset."""
    return F.greatest(F.coalesce(value - previous, F.lit(0)), F.lit(0)).cast("long")


def counter_deltas(readings: DataFrame, keys=("node_id", "port", "counter"), order=("ts_us", "event_id"), value="reading") -> DataFrame:
    """Add delta to absolute counter readings; the previous reading may lie in any earlier window."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return readings.withColumn("delta", saturating_delta(F.col(value), before))


def array_delta(now: Column, before: Column) -> Column:
    """Per-CPU rise between two snapshots; entries without a predecessor give 0."""
    return F.zip_with(now, before, lambda a, b: F.when(b.isNull(), 0).otherwise(F.greatest(a - b, F.lit(0))).cast("long"))


def _kind(name: str, value="latency_ns") -> Column:
    return F.when(F.col("kind") == name, F.col(value) if isinstance(value, str) else value)


def window_aggregates(events: DataFrame, num_cpus: int = 4, derive_cq: bool = True, stall_ns: int = 50_000) -> DataFrame:
    """One row per (node_id, window_seq) with at least one event; a single pass and a single shuffle for all kinds.

    ``derive_cq`` fills the completion-queue statistics from completion events; without it they are 0.
    """
    return events.groupBy("node_id", "window_seq").agg(*_figures(events, num_cpus, derive_cq, stall_ns))


def _figures(events: DataFrame, num_cpus: int, derive_cq: bool, stall_ns: int) -> list[Column]:
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    cq = (lambda c: n(c)) if derive_cq else (lambda c: F.lit(0).cast("long"))
    has = set(events.columns)
    length = "len" if "len" in has else F.lit(0)
    return [
        F.count("*").alias("n_events"),
        F.min("ts_us").alias("window_start_us"),
        F.max("ts_us").alias("window_end_us"),
        count("SlabAlloc").alias("slab_allocs"),
        count("SlabFree").alias("slab_frees"),
        n(F.sum(_kind("SlabAlloc"))).alias("slab_latency_total"),
        n(F.max(_kind("SlabAlloc"))).alias("slab_latency_max"),
        n(F.sum(_kind("SlabAlloc", "bytes_req"))).alias("slab_bytes_req"),
        n(F.sum(_kind("SlabAlloc", "bytes_alloc"))).alias("slab_bytes_alloc"),
        count("IrqEntry").alias("irq_total"),
        F.array(*[F.count_if((F.col("kind") == "IrqEntry") & (F.col("cpu") == c)) for c in range(num_cpus)]).alias("irq_per_cpu"),
        count("NapiPoll").alias("napi_polls"),
        n(F.sum(_kind("NapiPoll", "work_done"))).alias("napi_work"),
        n(F.sum(_kind("NapiPoll", "budget"))).alias("napi_budget"),
        count("NetifReceive").alias("rx_packets"),
        n(F.sum(_kind("NetifReceive", length))).alias("rx_bytes"),
        count("CqCompletion").alias("completions"),
        F.count_if((F.col("kind") == "CqCompletion") & F.col("is_error")).alias("completion_errors"),
        n(F.sum(_kind("CqCompletion"))).alias("completion_latency_total"),
        n(F.max(_kind("CqCompletion"))).alias("completion_latency_max"),
        cq(count("CqCompletion")).alias("cq_completions"),
        cq(F.sum(_kind("CqCompletion"))).alias("cq_latency_total"),
        cq(F.max(_kind("CqCompletion"))).alias("cq_latency_max"),
        cq(F.count_if((F.col("kind") == "CqCompletion") & (F.col("latency_ns") > stall_ns))).alias("cq_stalls"),
    ]


def _delta_sums() -> list[Column]:
    return [F.coalesce(F.sum(F.when(F.col("counter") == i, F.col("delta"))), F.lit(0)).cast("long").alias(name) for i, name in enumerate(DELTAS)]


def window_counters(events: DataFrame) -> DataFrame:
    """The 17 counter deltas of each node and window, summed over ports."""
    return counter_deltas(events.filter(F.col("kind") == "HardwareCounter")).groupBy("node_id", "window_seq").agg(*_delta_sums())


#: The event columns that window aggregates read.
EVENT_COLUMNS = ("node_id", "window_seq", "ts_us", "kind", "cpu", "latency_ns", "bytes_req", "bytes_alloc", "work_done", "budget", "len", "is_error")


def windows_with_events(events: DataFrame, num_cpus: int = 4, derive_cq: bool = True, stall_ns: int = 50_000) -> DataFrame:
    """All figures and counter deltas of the windows that have events, in one aggregation.

    Only counter readings are sorted for their deltas; they meet the other events, which are not, before the sums.
    """
    columns = [c for c in EVENT_COLUMNS if c in events.columns]
    none = {"counter": F.lit(None).cast("int"), "delta": F.lit(None).cast("long")}
    others = events.filter(F.col("kind") != "HardwareCounter").select(*columns).withColumns(none)
    counters = counter_deltas(events.filter(F.col("kind") == "HardwareCounter")).select(*columns, F.col("counter").cast("int").alias("counter"), "delta")
    return others.unionByName(counters).groupBy("node_id", "window_seq").agg(*_figures(events, num_cpus, derive_cq, stall_ns), *_delta_sums())


def port_counters(events: DataFrame) -> DataFrame:
    """The 17 counter deltas of each port and window: what a link query reads."""
    deltas = counter_deltas(events.filter(F.col("kind") == "HardwareCounter"))
    return deltas.groupBy("node_id", "port", "window_seq").agg(*[F.coalesce(F.sum(F.when(F.col("counter") == i, F.col("delta"))), F.lit(0)).cast("long").alias(name) for i, name in enumerate(DELTAS)])


#: Windows that are made of one row at a time: no array as long as a history is ever held.
SPINE_BLOCK = 4096


def spine(windows: DataFrame) -> DataFrame:
    """Every window from the first to the last of the fleet, for every node: also empty ones are evaluated."""
    ends = windows.agg(F.struct(F.min("window_seq").alias("low"), F.max("window_seq").alias("high"))).scalar()
    low, high = F.col("_ends.low"), F.col("_ends.high")
    block = lambda x: F.floor(x / SPINE_BLOCK)
    blocks = windows.select("node_id").distinct().withColumn("_ends", ends).select("node_id", "_ends", F.explode(F.sequence(block(low), block(high))).alias("_block"))
    return blocks.select("node_id", F.explode(F.sequence(F.greatest(low, F.col("_block") * SPINE_BLOCK), F.least(high, (F.col("_block") + 1) * SPINE_BLOCK - 1))).alias("window_seq"))


def health_windows(events: DataFrame, num_cpus: int = 4, derive_cq: bool = True, stall_ns: int = 50_000) -> DataFrame:
    """The dense window table: all aggregates and counter deltas, 0 where a window is empty.

    The aggregates are settled, since the spine and the table itself both read them; the events are read once.
    """
    aggregates = settle(windows_with_events(events, num_cpus, derive_cq, stall_ns), "windows")
    joined = spine(aggregates).join(aggregates, ["node_id", "window_seq"], "left")
    zeros = F.array(*[F.lit(0).cast("long")] * num_cpus)
    return joined.fillna(0, [*SUMS, *DELTAS]).withColumn("irq_per_cpu", F.coalesce("irq_per_cpu", zeros))


def snapshot_windows(snapshots: DataFrame) -> DataFrame:
    """Window columns from cumulative per-CPU snapshots: summed over CPUs, then the rise since the node's last snapshot.

    The first snapshot of a node is its baseline and gives no row. ``latency_max`` is a maximum over CPUs.
    """
    sums = ("irq_count", "napi_polls", "napi_work", "napi_budget", "slab_allocs", "cq_completions", "cq_latency_total", "cq_stalls")
    whole = snapshots.groupBy("node_id", "snapshot").agg(*[F.sum(c).alias(c) for c in sums], F.max("latency_max").alias("latency_max"))
    order = W.partitionBy("node_id").orderBy("snapshot")
    rise = whole.withColumns({c: saturating_delta(F.col(c), F.lag(c).over(order)) for c in sums} | {"_first": F.row_number().over(order) == 1})
    return rise.filter(~F.col("_first")).drop("_first")


def proc_windows(interrupts: DataFrame, slab: DataFrame, softnet: DataFrame) -> DataFrame:
    """Window columns from parsed /proc snapshots, for nodes without kernel statistics: (node_id, window_seq, ...).

    Interrupts and softnet rows count up and give their rise since the node's last snapshot; a first snapshot is the
    baseline and gives no row. Slab objects are levels: active ones stand for allocations, the rest for frees. Polls and
    their budget are packets processed, work is the time squeeze.
    """
    irq = interrupts.groupBy("node_id", "snapshot").agg(F.sum("count").alias("irq_total"))
    net = softnet.groupBy("node_id", "snapshot").agg(F.sum("processed").cast("long").alias("_polls"), F.sum("time_squeeze").cast("long").alias("_work"))
    order = W.partitionBy("node_id").orderBy("snapshot")
    rise = lambda name: saturating_delta(F.col(name), F.lag(name).over(order))
    whole = irq.join(net, ["node_id", "snapshot"]).join(slab, ["node_id", "snapshot"])
    rows = whole.withColumns({"irq_total": rise("irq_total"), "napi_polls": rise("_polls"), "napi_work": rise("_work"), "_first": F.row_number().over(order) == 1}).filter(~F.col("_first"))
    return rows.select("node_id", F.col("snapshot").alias("window_seq"), "irq_total", F.col("active_objects").alias("slab_allocs"), F.greatest(F.col("objects") - F.col("active_objects"), F.lit(0)).alias("slab_frees"), "napi_polls", "napi_work", F.col("napi_polls").alias("napi_budget"))


def prefer_snapshot(windows: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Windows whose columns come from a snapshot where there is one."""
    renamed = snapshots.select("node_id", "window_seq", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = windows.join(renamed, ["node_id", "window_seq"], "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def streak(windows: DataFrame, holds: Column, order: str = "window_seq", key: str = "node_id") -> Column:
    """How many rows in a row, up to this one, the condition holds."""
    frame = W.partitionBy(key).orderBy(order)
    last = F.max(F.when(~holds, F.col("_row"))).over(frame)
    return F.col("_row") - F.coalesce(last, F.lit(0))


def with_streak(windows: DataFrame, name: str, holds: Column, order: str = "window_seq", key: str = "node_id") -> DataFrame:
    numbered = windows.withColumn("_row", F.row_number().over(W.partitionBy(key).orderBy(order))).withColumn("_holds", F.coalesce(holds, F.lit(False)))
    return numbered.withColumn(name, streak(numbered, F.col("_holds"), order, key).cast("long")).drop("_row", "_holds")
