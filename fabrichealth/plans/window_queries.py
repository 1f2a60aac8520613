"""Queries of scans, windows, expressions, stateless rules and frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.functions import exprs as X
from fabrichealth.operators import fleet, rules, windows
from fabrichealth.plans.base import ALL, BYTES, DOMINANT, HARD, P99, PKTS, SCORE, SIGNAL, SLABAVG, SOFT, TOTAL, TRAFFIC, events, ports, query, r6, readings, ruled, wins
from fabrichealth.schemas import COUNTER_FILES, COUNTER_KINDS, DELTAS
from fabrichealth.sources import landed
from fabrichealth.sources.adapter import counter_kind

c = F.col
K = ["node_id", "window_seq"]


def one(name, column, sql_expr, label, source=wins, views="wi", table="wi", where=None):
    """A query that projects one expression of the window table."""

    @query(name, f"select node_id, window_seq, {sql_expr} as {label} from {table}" + (f" where {where}" if where else ""), views)
    def run(spark, sf_dir):
        rows = source(spark, sf_dir).select(*K, column().alias(label))
        return rows.filter(F.expr(where)) if where else rows

    return run


_agg = {
    "agg_1_slab": ["slab_allocs", "slab_frees", "slab_latency_total", "slab_latency_max", "slab_bytes_req", "slab_bytes_alloc"],
    "agg_3_napi": ["napi_polls", "napi_work", "napi_budget"],
    "agg_4_netif": ["rx_packets", "rx_bytes"],
    "agg_5_completions": ["completions", "completion_errors", "completion_latency_total", "completion_latency_max"],
    "agg_6_counter_deltas": list(DELTAS),
    "agg_9_cq_stats": ["cq_completions", "cq_latency_total", "cq_latency_max", "cq_stalls"],
    "str_2_spine": ["n_events"],
    "str_4_window_reset": ["n_events", "completions", "symbol_errors"],
}
for _name, _columns in _agg.items():
    query(_name, f"select node_id, window_seq, {', '.join(f'cast({x} as bigint) as {x}' for x in _columns)} from wi")(lambda spark, sf_dir, cols=_columns: wins(spark, sf_dir).select(*K, *cols))


@query("agg_2_irq_per_cpu", "select node_id, window_seq, irq_total, irq0, irq1, irq2, irq3 from wi")
def _(spark, sf_dir):
    return wins(spark, sf_dir).select(*K, "irq_total", *[c("irq_per_cpu")[i].alias(f"irq{i}") for i in range(4)])


@query("agg_7_window_bounds", "select node_id, window_seq, window_start_us, window_end_us from wi where n_events > 0")
def _(spark, sf_dir):
    return windows.window_aggregates(events(spark, sf_dir)).select(*K, "window_start_us", "window_end_us")


@query("agg_8_cross_cpu", "select node_id, window_seq, cast(sum(n) as bigint) as n, cast(sum(total) as bigint) as total, max(most) as most from (select node_id, window_seq, cpu, count(*) as n, sum(latency_ns) as total, max(latency_ns) as most from ev group by all) group by all", "ev")
def _(spark, sf_dir):
    per_cpu = events(spark, sf_dir).groupBy(*K, "cpu").agg(F.count("*").alias("n"), F.sum("latency_ns").alias("total"), F.max("latency_ns").alias("most"))
    return per_cpu.groupBy(*K).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


@query("agg_10_per_cpu", "select node_id, window_seq, cpu, kind, count(*) as n, cast(sum(latency_ns) as bigint) as total from ev where kind in ('IrqEntry', 'NapiPoll', 'SlabAlloc') group by all", "ev")
def _(spark, sf_dir):
    return events(spark, sf_dir).filter(c("kind").isin("IrqEntry", "NapiPoll", "SlabAlloc")).groupBy(*K, "cpu", "kind").agg(F.count("*").alias("n"), F.sum("latency_ns").alias("total"))


def snapshots(spark, sf_dir):
    """Cumulative per-CPU figures of every event window, as a kernel map would hold them."""
    ev = events(spark, sf_dir)
    per = ev.groupBy("node_id", "cpu", c("window_seq").alias("snapshot")).agg(
        F.count_if(c("kind") == "IrqEntry").alias("irq_count"), F.count_if(c("kind") == "NapiPoll").alias("napi_polls"),
        F.coalesce(F.sum(F.when(c("kind") == "NapiPoll", c("work_done"))), F.lit(0)).alias("napi_work"), F.coalesce(F.sum(F.when(c("kind") == "NapiPoll", c("budget"))), F.lit(0)).alias("napi_budget"),
        F.count_if(c("kind") == "SlabAlloc").alias("slab_allocs"), F.count_if(c("kind") == "CqCompletion").alias("cq_completions"),
        F.coalesce(F.sum(F.when(c("kind") == "CqCompletion", c("latency_ns"))), F.lit(0)).alias("cq_latency_total"), F.count_if((c("kind") == "CqCompletion") & (c("latency_ns") > 50_000)).alias("cq_stalls"),
        F.coalesce(F.max(F.when(c("kind") == "CqCompletion", c("latency_ns"))), F.lit(0)).alias("latency_max"),
    )
    spine = windows.spine(per.select("node_id", c("snapshot").alias("window_seq"))).withColumnRenamed("window_seq", "snapshot").crossJoin(F.broadcast(spark.range(4).select(c("id").cast("int").alias("cpu"))))
    names = [x for x in per.columns if x not in ("node_id", "cpu", "snapshot")]
    dense = spine.join(per, ["node_id", "cpu", "snapshot"], "left").fillna(0, names)
    order = W.partitionBy("node_id", "cpu").orderBy("snapshot")
    return dense.withColumns({x: F.sum(x).over(order) for x in names if x != "latency_max"})


@query("src_10_snapshot_delta", "select node_id, window_seq as snapshot, irq_total as irq_count, napi_polls, slab_allocs, cq_completions, cq_latency_total, cq_stalls, cq_latency_max as latency_max from wi where window_seq > (select min(window_seq) from wi)")
def _(spark, sf_dir):
    return windows.snapshot_windows(snapshots(spark, sf_dir)).select("node_id", "snapshot", "irq_count", "napi_polls", "slab_allocs", "cq_completions", "cq_latency_total", "cq_stalls", "latency_max")


_cq3 = ("cq_completions", "cq_latency_total", "cq_stalls")


@query("agg_11_prefer_snapshot", ", k as (select *, lag(window_seq) over w as before, " + ", ".join(f"sum({x}) over w0 as s_{x}" for x in _cq3) + " from wi window w as (partition by node_id order by window_seq), w0 as (partition by node_id order by window_seq)), s as (select node_id, window_seq, " + ", ".join(f"s_{x} - lag(s_{x}) over v as d_{x}" for x in _cq3) + ", lag(window_seq) over v as prev from k where window_seq % 3 <> 0 window v as (partition by node_id order by window_seq)) select wi.node_id, wi.window_seq, " + ", ".join(f"cast(case when s.prev is null then 0 else d_{x} end as bigint) as {x}" for x in _cq3) + " from wi left join s using (node_id, window_seq)")
def _(spark, sf_dir):
    """Events alone tell nothing of the completion queues; kernel snapshots do, where there are any: not every third window."""
    base = windows.health_windows(events(spark, sf_dir), derive_cq=False)
    snap = windows.snapshot_windows(snapshots(spark, sf_dir).filter("snapshot % 3 <> 0")).withColumnRenamed("snapshot", "window_seq")
    return windows.prefer_snapshot(base, snap, list(_cq3)).select(*K, *_cq3)


def proc_text(spark, sf_dir):
    """/proc snapshots of each node and window as text: interrupts and softnet count up, slab objects are levels."""
    order = W.partitionBy("node_id").orderBy("window_seq")
    rows = wins(spark, sf_dir).withColumns({f"_irq{i}": F.sum(c("irq_per_cpu")[i]).over(order) for i in range(4)} | {"_polled": F.sum("n_events").over(order), "_squeezed": F.sum("irq_total").over(order)})
    at = ["node_id", c("window_seq").alias("snapshot")]
    irq = F.concat(F.lit("      CPU0 CPU1 CPU2 CPU3\n 24: "), F.concat_ws("  ", *[c(f"_irq{i}").cast("string") for i in range(4)]), F.lit(" PCI-MSI mlx5\n"))
    slab = F.concat(F.lit("slabinfo - version: 2.1\n# name <active_objs>\nkmalloc "), c("slab_allocs").cast("string"), F.lit(" "), (c("slab_allocs") + c("slab_frees")).cast("string"), F.lit(" 64 64 1 : tunables 0 0 0 : slabdata 1 9 0\n"))
    softnet = F.concat_ws(" ", F.hex("_polled"), F.lit("0"), F.hex("_squeezed"))
    return [rows.select(*at, text.alias("text")) for text in (irq, slab, softnet)]


@query("agg_12_proc_windows", "select node_id, window_seq, irq_total, slab_allocs, slab_frees, n_events as napi_polls, irq_total as napi_work, n_events as napi_budget from wi where window_seq > (select min(window_seq) from wi)")
def _(spark, sf_dir):
    irq, slab, softnet = proc_text(spark, sf_dir)
    return windows.proc_windows(landed.interrupts(irq), landed.slabinfo(slab), landed.softnet(softnet))


@query("agg_13_label_counts", "select kind, is_error, count(*) as n, cast(sum(latency_ns) as bigint) as total from ev group by all", "ev")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy("kind", "is_error").agg(F.count("*").alias("n"), F.sum("latency_ns").alias("total"))


def devices(spark, sf_dir):
    """Suppliers as devices: node, a driver by part of the key, and a link layer."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select((c("s_suppkey") % 8).alias("node_id"), c("s_suppkey").alias("device"), F.when(c("s_suppkey") % 5 == 0, "rxe0").when(c("s_suppkey") % 3 == 0, "mlx5_0").otherwise("eth0").alias("name"), F.when(c("s_suppkey") % 2 == 0, "InfiniBand").otherwise("Ethernet").alias("link_layer"))


DEV = "dv as (select s_suppkey % 8 as node_id, s_suppkey as device, case when s_suppkey % 5 = 0 then 'rxe0' when s_suppkey % 3 = 0 then 'mlx5_0' else 'eth0' end as name, case when s_suppkey % 2 = 0 then 'InfiniBand' else 'Ethernet' end as link_layer from supplier)"
FABRIC = "case when name like 'rxe%' then 'SoftRoCE' when link_layer = 'InfiniBand' then 'InfiniBand' else 'RoCEv2' end"


@query("sca_21_fabric_class", f"with {DEV} select node_id, device, {FABRIC} as fabric from dv", "")
def _(spark, sf_dir):
    return devices(spark, sf_dir).select("node_id", "device", landed.fabric_class(c("name"), c("link_layer")).alias("fabric"))


@query("sca_20_device_class", f"with {DEV} select node_id, device, case when name like 'rxe%' then 'SoftRoCE' when name like 'mlx%' then 'HardwareIB' else 'Unknown' end as class from dv", "")
def _(spark, sf_dir):
    return devices(spark, sf_dir).select("node_id", "device", landed.device_class(c("name")).alias("class"))


@query("agg_14_dominant_fabric", f"with {DEV}, f as (select node_id, {FABRIC} as fabric from dv) select node_id, case min(case fabric when 'SoftRoCE' then 0 when 'RoCEv2' then 1 else 2 end) when 0 then 'SoftRoCE' when 1 then 'RoCEv2' else 'InfiniBand' end as fabric from f group by all", "")
def _(spark, sf_dir):
    return landed.dominant(devices(spark, sf_dir).select("node_id", landed.fabric_class(c("name"), c("link_layer")).alias("fabric")), "fabric", ["SoftRoCE", "RoCEv2", "InfiniBand"])


@query("agg_15_dominant_device", f"with {DEV} select node_id, case min(case when name like 'mlx%' then 0 when name like 'rxe%' then 1 else 2 end) when 0 then 'HardwareIB' when 1 then 'SoftRoCE' else 'Unknown' end as class from dv group by all", "")
def _(spark, sf_dir):
    return landed.dominant(devices(spark, sf_dir).select("node_id", landed.device_class(c("name")).alias("class")), "class", ["HardwareIB", "SoftRoCE"])


@query("agg_16_counter_sets", "select node_id, port, string_agg(distinct cast(counter as varchar), ',' order by cast(counter as varchar)) as counters from rd group by all", "rd")
def _(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("node_id", "port").agg(F.array_join(F.sort_array(F.collect_set(c("counter").cast("string"))), ",").alias("counters"))


_zero_streak = "w as (select *, row_number() over (partition by node_id order by window_seq) as rn from wi), s as (select node_id, window_seq, n_events, rn - coalesce(max(case when n_events > 1 then rn end) over (partition by node_id order by window_seq), 0) as streak from w)"


@query("agg_18_quiet_streak", f", {_zero_streak} select node_id, window_seq, n_events, streak, streak >= 3 as warn from s", "wi")
def _(spark, sf_dir):
    return windows.with_streak(wins(spark, sf_dir), "streak", c("n_events") <= 1).select(*K, "n_events", "streak", (c("streak") >= 3).alias("warn"))


@query("win_8_zero_streak", ", w as (select *, row_number() over (partition by node_id order by window_seq) as rn from wi) select node_id, window_seq, rn - coalesce(max(case when napi_polls > 0 then rn end) over (partition by node_id order by window_seq), 0) as streak from w", "wi")
def _(spark, sf_dir):
    return windows.with_streak(wins(spark, sf_dir), "streak", c("napi_polls") == 0).select(*K, "streak")


@query("win_1_counter_delta", "select event_id, node_id, port, counter, reading, delta from rd", "rd")
def _(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", "node_id", "port", "counter", "reading", "delta")


@query("join_1_previous_reading", "select event_id, lag(reading) over (partition by node_id, port, counter order by ts_us, event_id) as previous from ev where kind = 'HardwareCounter'", "ev")
def _(spark, sf_dir):
    order = W.partitionBy("node_id", "port", "counter").orderBy("ts_us", "event_id")
    return events(spark, sf_dir).filter("kind = 'HardwareCounter'").select("event_id", F.lag("reading").over(order).alias("previous"))


@query("win_2_array_delta", "select node_id, window_seq, " + ", ".join(f"greatest(irq{i} - coalesce(lag(irq{i}) over (partition by node_id order by window_seq), irq{i}), 0) as d{i}" for i in range(4)) + " from wi")
def _(spark, sf_dir):
    rows = wins(spark, sf_dir).withColumn("_p", F.lag("irq_per_cpu").over(W.partitionBy("node_id").orderBy("window_seq")))
    d = windows.array_delta(c("irq_per_cpu"), F.coalesce("_p", "irq_per_cpu"))
    return rows.select(*K, *[d[i].alias(f"d{i}") for i in range(4)])


_rise = f", t as (select node_id, window_seq, {TOTAL} as total from wi), r as (select *, coalesce(total > lag(total) over (partition by node_id order by window_seq), false) as rises, row_number() over (partition by node_id order by window_seq) as rn from t), s as (select *, rn - coalesce(max(case when not rises then rn end) over (partition by node_id order by window_seq), 0) as streak from r) "
query("win_3_rising_streak", _rise + "select node_id, window_seq, streak as error_streak from s", "wi")(lambda spark, sf_dir: rules.with_trend(wins(spark, sf_dir), SCALED).select(*K, "error_streak"))
query("rule_5_rising_error_trend", _rise + "select node_id, window_seq, case when streak >= 6 then 'CRITICAL' else 'DEGRADED' end as severity from s where streak >= 3 and total > 0", "wi")(lambda spark, sf_dir: ruled(spark, sf_dir).filter("rising_error_trend is not null").select(*K, c("rising_error_trend").alias("severity")))


@query("win_4_burst_count", f", s as (select node_id, window_seq, cast({SCORE} >= 0.40 as integer) as spike from wi) select node_id, window_seq, cast(sum(spike) over (partition by node_id order by window_seq rows between 29 preceding and current row) as bigint) as bursts from s", "wi")
def _(spark, sf_dir):
    spike = (X.composite_score(4) >= 0.40).cast("int")
    return wins(spark, sf_dir).withColumn("s", spike).select(*K, F.sum("s").over(W.partitionBy("node_id").orderBy("window_seq").rowsBetween(-29, 0)).alias("bursts"))


@query("win_6_history", "select node_id, window_seq, n_events as current, round(avg(n_events) over (partition by node_id order by window_seq rows between 59 preceding and current row), 6) as mean, count(*) over (partition by node_id order by window_seq rows between 59 preceding and current row) as points from wi")
def _(spark, sf_dir):
    frame = W.partitionBy("node_id").orderBy("window_seq").rowsBetween(-59, 0)
    return wins(spark, sf_dir).select(*K, c("n_events").alias("current"), r6(F.avg("n_events").over(frame)).alias("mean"), F.size(F.collect_list("n_events").over(frame)).cast("long").alias("points"))


@query("win_7_sticky_bytes", f"select node_id, window_seq, max(cast({BYTES} > 0 as integer)) over (partition by node_id order by window_seq) as in_bytes from wi")
def _(spark, sf_dir):
    return wins(spark, sf_dir).select(*K, F.max((X.traffic_bytes() > 0).cast("int")).over(W.partitionBy("node_id").orderBy("window_seq")).alias("in_bytes"))


@query("win_11_latest_owner", ", o as (select *, row_number() over (partition by node_id, qp order by ts_us desc, event_id desc) as rn from ev where kind = 'CqCompletion') select node_id, qp, event_id as owner from o where rn = 1", "ev")
def _(spark, sf_dir):
    from fabrichealth.operators.joins import latest_owner

    rows = events(spark, sf_dir).filter("kind = 'CqCompletion'").withColumn("owner", c("event_id"))
    return latest_owner(rows, ["node_id", "qp"], "owner", ["ts_us", "event_id"])


one("flt_4_has_traffic", X.has_traffic, TRAFFIC, "has_traffic")
one("flt_5_link_signal", X.has_link_signal, SIGNAL, "has_signal")
query("flt_1_kind_dispatch", "select kind, count(*) as n from ev group by all", "ev")(lambda spark, sf_dir: events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")))
query("flt_2_sample_guards", "select node_id, window_seq, irq_total >= 2 as irq, completions >= 1 as cq, slab_allocs >= 1 as slab, napi_polls >= 1 as napi from wi")(lambda spark, sf_dir: wins(spark, sf_dir).select(*K, (c("irq_total") >= 2).alias("irq"), (c("completions") >= 1).alias("cq"), (c("slab_allocs") >= 1).alias("slab"), (c("napi_polls") >= 1).alias("napi")))
query("flt_3_cpu_range", "select node_id, window_seq, irq_total, irq0 + irq1 as in_range from wi")(lambda spark, sf_dir: windows.health_windows(events(spark, sf_dir), num_cpus=2).select(*K, "irq_total", (c("irq_per_cpu")[0] + c("irq_per_cpu")[1]).alias("in_range")))
query("flt_8_label_matcher", "select event_id, kind from ev where regexp_full_match(kind, 'Irq.*|.*Poll') and port = 1", "ev")(lambda spark, sf_dir: events(spark, sf_dir).filter(c("kind").rlike("^(?:Irq.*|.*Poll)$") & (c("port") == 1)).select("event_id", "kind"))
query("prj_1_names", "select event_id, case counter " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(COUNTER_KINDS)) + " end as counter_kind from ev", "ev")(lambda spark, sf_dir: events(spark, sf_dir).select("event_id", counter_kind(c("counter")).alias("counter_kind")))
query("sca_1_saturating", "select node_id, window_seq, greatest(completions - irq_total, 0) as rest from wi")(lambda spark, sf_dir: wins(spark, sf_dir).select(*K, windows.saturating_delta(c("completions"), c("irq_total")).alias("rest")))
query("sca_2_averages", f"select node_id, window_seq, {SLABAVG} as slab_avg, case when completions > 0 then completion_latency_total // completions else 0 end as rdma_avg, round(case when cq_completions > 0 then cq_latency_total / cq_completions else 0 end, 6) as cq_avg from wi")(
    lambda spark, sf_dir: wins(spark, sf_dir).select(*K, X.whole_average("slab_latency_total", "slab_allocs").alias("slab_avg"), X.whole_average("completion_latency_total", "completions").alias("rdma_avg"), r6(X.average("cq_latency_total", "cq_completions")).alias("cq_avg"))
)
one("sca_3_error_rate", lambda: r6(X.error_rate()), "round(case when completions > 0 then completion_errors / completions else 0 end, 6)", "rate")
one("sca_4_estimated_p99", lambda: r6(X.estimated_p99()), f"round({P99}, 6)", "p99")
query("sca_5_error_sums", f"select node_id, window_seq, {HARD} as hard, {SOFT} as soft, {TOTAL} as total, {ALL} as every from wi")(lambda spark, sf_dir: wins(spark, sf_dir).select(*K, X.hard_errors().alias("hard"), X.soft_errors().alias("soft"), X.total_errors().alias("total"), X.all_errors().alias("every")))
query("sca_6_throughput", f"select node_id, window_seq, {BYTES} as bytes, {PKTS} as packets from wi")(lambda spark, sf_dir: wins(spark, sf_dir).select(*K, X.traffic_bytes().alias("bytes"), X.traffic_packets().alias("packets")))
one("sca_7_dominant_pct", lambda: r6(X.dominant_cpu_pct()), f"round({DOMINANT}, 6)", "pct")
one("sca_8_dominant_cpu", lambda: X.dominant_cpu().cast("long"), "cast(case when irq3 = greatest(irq0, irq1, irq2, irq3) then 3 when irq2 = greatest(irq0, irq1, irq2, irq3) then 2 when irq1 = greatest(irq0, irq1, irq2, irq3) then 1 else 0 end as bigint)", "cpu")
one("sca_9_imbalance", lambda: r6(X.irq_imbalance_pct(4)), f"round(least(greatest(({DOMINANT} - 25) / 75 * 100, 0), 100), 6)", "pct")
one("sca_10_napi", lambda: r6(X.napi_utilisation()), "round(case when napi_budget > 0 then napi_work / napi_budget * 100 else 0 end, 6)", "pct")
query("sca_11_irq_threshold", "select n, greatest(70.0, 100.0 / n + 45.0) as threshold from (select distinct cast(port + cpu as integer) as n from ev)", "ev")(lambda spark, sf_dir: events(spark, sf_dir).select((c("port") + c("cpu")).alias("n")).distinct().select("n", X.irq_threshold_of(c("n")).alias("threshold")))
one("sca_12_math", lambda: r6(F.tanh(F.log(1 + c("completion_latency_total")) / 20) + F.sqrt(c("napi_work")) + F.pow(c("irq_total"), 2)), "round(tanh(ln(1 + completion_latency_total) / 20) + sqrt(napi_work) + pow(irq_total, 2), 6)", "x")
one("sca_13_quality_weight", lambda: r6(X.effective_weight(F.when(c("irq_total") > 2, "High").when(c("irq_total") > 1, "Medium").when(c("irq_total") > 0, "Low").otherwise("Absent"), c("completions") / 3)), "round(case when irq_total > 2 then 1.0 when irq_total > 1 then 0.7 when irq_total > 0 then 0.4 else 0.0 end * least(greatest(completions / 3, 0), 1), 6)", "weight")
one("sca_16_error_summary", X.error_summary, "concat_ws(', ', " + ", ".join(f"case when {n} > 0 then '{s}+' || cast({n} as bigint) end" for s, n in X.ERROR_PARTS) + ")", "summary")
one("sca_26_fragmentation", lambda: r6(landed.fragmentation_pct("slab_bytes_req", "slab_bytes_alloc")), "round(case when slab_bytes_alloc > 0 then (1 - slab_bytes_req / slab_bytes_alloc) * 100 else 0 end, 6)", "pct")
_cpu = "(case when irq3 = greatest(irq0, irq1, irq2, irq3) then 3 when irq2 = greatest(irq0, irq1, irq2, irq3) then 2 when irq1 = greatest(irq0, irq1, irq2, irq3) then 1 else 0 end)"
_mean = "(completion_latency_total // completions)"
_told = {
    "interrupt_affinity_skew": (f"irq_total >= 2 and {DOMINANT} >= 70", f"{DOMINANT} >= 90", f"format('Interrupt affinity skew: CPU {{}} handling {{:.1f}}% of interrupts', {_cpu}, cast({DOMINANT} as double))"),
    "rdma_latency_spike": (f"completions >= 1 and {_mean} >= 50000", f"{_mean} >= 100000", f"format('RDMA latency spike: {{}}ns ({{:.1f}}x baseline)', {_mean}, {_mean} / 10000)"),
    "slab_pressure_correlation": (f"slab_allocs >= 2 and {TOTAL} > 0", f"{TOTAL} > 100", f"format('Slab pressure correlated with IB errors: {{}} allocs/window, {{}} IB errors', slab_allocs, {TOTAL})"),
    "rising_error_trend": (f"streak >= 3 and {TOTAL} > 0", "streak >= 6", f"format('IB errors rising for {{}} consecutive windows (current delta: {{}})', streak, {TOTAL})"),
    "napi_saturation": ("napi_polls >= 1 and napi_work / napi_budget * 100 >= 85", "napi_work / napi_budget * 100 >= 95", "format('NAPI saturation: {:.0f}% budget utilization ({:.0f}/{:.0f} per poll)', napi_work / napi_budget * 100, napi_work / napi_polls, napi_budget / napi_polls)"),
    "pcie_bottleneck": (f"cq_stalls >= 1 and slab_allocs >= 1 and {ALL} = 0", "false", "format('PCIe bottleneck suspected: {} CQ stalls + {} slab allocs, no IB errors — not a cable fault', cq_stalls, slab_allocs)"),
}
_streaks = f", rt as (select *, coalesce({TOTAL} > lag({TOTAL}) over (partition by node_id order by window_seq), false) as rises, row_number() over (partition by node_id order by window_seq) as rn from wi), rs as (select *, rn - coalesce(max(case when not rises then rn end) over (partition by node_id order by window_seq), 0) as streak from rt) "


@query("sca_25_message", _streaks + " union all ".join(f"select node_id, window_seq, '{rule}' as rule, case when {critical} then 'CRITICAL' else 'DEGRADED' end as severity, {text} as message from rs where {fires}" for rule, (fires, critical, text) in _told.items()))
def _(spark, sf_dir):
    return rules.alerts(wins(spark, sf_dir), SCALED)


query("sca_27_time", "select event_id, cast(ts_us // 86400000000 as bigint) as days, cast((ts_us % 86400000000) // 3600000000 as bigint) as hours from ev", "ev")(lambda spark, sf_dir: events(spark, sf_dir).select("event_id", F.expr("ts_us div 86400000000").alias("days"), F.expr("(ts_us % 86400000000) div 3600000000").alias("hours")))
query("sca_28_json", "select event_id, '{\"kind\":\"' || kind || '\",\"cpu\":' || cpu || '}' as body from ev", "ev")(lambda spark, sf_dir: events(spark, sf_dir).select("event_id", F.to_json(F.struct("kind", "cpu")).alias("body")))


def rule(name, column, condition, critical):
    query(name, f"select node_id, window_seq, case when {critical} then 'CRITICAL' else 'DEGRADED' end as severity from wi where {condition}")(lambda spark, sf_dir: ruled(spark, sf_dir).filter(c(column).isNotNull()).select(*K, c(column).alias("severity")))


rule("rule_1_affinity_skew", "interrupt_affinity_skew", f"irq_total >= 2 and {DOMINANT} >= 70", f"{DOMINANT} >= 90")
rule("rule_2_latency_spike", "rdma_latency_spike", "completions >= 1 and completion_latency_total // completions >= 50000", "completion_latency_total // completions >= 100000")
rule("rule_4_slab_pressure", "slab_pressure_correlation", f"slab_allocs >= 2 and {TOTAL} > 0", f"{TOTAL} > 100")
rule("rule_8_napi_saturation", "napi_saturation", "napi_polls >= 1 and napi_work / napi_budget * 100 >= 85", "napi_work / napi_budget * 100 >= 95")
rule("rule_11_pcie_bottleneck", "pcie_bottleneck", f"cq_stalls >= 1 and slab_allocs >= 1 and {ALL} = 0", "false")
one("scr_1_composite", lambda: r6(X.composite_score(4)), f"round({SCORE}, 6)", "score")
one("prj_4_milliunits", lambda: X.milliunits(F.round(X.composite_score(4), 6)), f"cast(trunc(round({SCORE}, 6) * 1000) as bigint)", "milli")


@query("src_6_port_counters", "select event_id, case counter " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(COUNTER_KINDS)) + " end as counter_kind, reading as counter_value from rd where event_id % 7 <> 0", "rd")
def _(spark, sf_dir):
    files = {v: k for k, v in COUNTER_FILES.items()}
    name = F.get(F.array(*[F.lit(files[k]) for k in COUNTER_KINDS]), c("counter"))
    text = F.when(c("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), c("reading").cast("string"), F.lit("\n")))
    raw = events(spark, sf_dir).filter("kind = 'HardwareCounter'").select("event_id", name.alias("file_name"), text.alias("value"))
    return landed.port_readings(raw).withColumn("counter_value", c("counter_value").cast("long"))


@query("src_7_interrupts", "select node_id, window_seq as snapshot, cpu, case cpu when 0 then irq0 when 1 then irq1 when 2 then irq2 else irq3 end as count from wi, (select unnest([0, 1, 2, 3]) as cpu)")
def _(spark, sf_dir):
    cells = F.array_join(F.transform("irq_per_cpu", lambda x: x.cast("string")), "  ")
    text = F.concat(F.lit("      CPU0 CPU1 CPU2 CPU3\n 24: "), cells, F.lit(" PCI-MSI mlx5\nNMI:  0 0 0 0 text\n"))
    return landed.interrupts(wins(spark, sf_dir).select("node_id", c("window_seq").alias("snapshot"), text.alias("text"))).select("node_id", "snapshot", c("cpu").cast("int").alias("cpu"), "count")


@query("src_8_slabinfo", "select node_id, window_seq as snapshot, slab_allocs + 1 as active_objects, slab_bytes_alloc + 2 as objects, irq_total + 3 as active_slabs from wi")
def _(spark, sf_dir):
    row = lambda a, b, d: F.concat(F.lit("kmalloc "), a.cast("string"), F.lit(" "), b.cast("string"), F.lit(" 64 64 1 : tunables 0 0 0 : slabdata "), d.cast("string"), F.lit(" 9 0\n"))
    text = F.concat(F.lit("slabinfo - version: 2.1\n# name <active_objs>\n"), row(c("slab_allocs"), c("slab_bytes_alloc"), c("irq_total")), row(F.lit(1), F.lit(2), F.lit(3)), F.lit("short row\n"))
    return landed.slabinfo(wins(spark, sf_dir).select("node_id", c("window_seq").alias("snapshot"), text.alias("text")))


@query("src_9_softnet", "select node_id, window_seq as snapshot, cast(0 as integer) as cpu, n_events as processed, irq_total as dropped, napi_work as time_squeeze from wi")
def _(spark, sf_dir):
    text = F.concat(F.lower(F.concat_ws(" ", F.hex("n_events"), F.hex("irq_total"), F.hex(c("napi_work")))), F.lit("\nzz 1 2\n"))
    found = landed.softnet(wins(spark, sf_dir).select("node_id", c("window_seq").alias("snapshot"), text.alias("text")))
    return found.withColumns({x: c(x).cast("long") for x in ("processed", "dropped", "time_squeeze")})


@query("src_13_metrics_text", "select 'events_total' as name, cast(node_id as varchar) as node, cast(n_events as double) as value from wi")
def _(spark, sf_dir):
    line = F.concat(F.lit('events_total{node="'), c("node_id").cast("string"), F.lit('",x="1"} '), c("n_events").cast("string"))
    return landed.metrics_text(wins(spark, sf_dir).select(line.alias("line"))).select("name", c("labels")["node"].alias("node"), "value")


@query("sca_22_cgroup_ids", "select event_id, cast(qp as varchar) as job_id, 'p' || k as pod from ev", "ev")
def _(spark, sf_dir):
    cg = F.concat(F.lit("0::/slurm/job_"), c("qp").cast("string"), F.lit("/podp"), c("k").cast("string"), F.lit("/x"))
    envs = F.concat(F.lit("A=1"), F.lit("\u0000CUDA_VISIBLE_DEVICES="), c("cpu").cast("string"))
    rows = events(spark, sf_dir).select("node_id", c("event_id").alias("pid"), F.lit("w").alias("comm"), F.replace(cg, F.lit("podp"), F.lit("podp")).alias("cgroup"), envs.alias("environ"))
    return landed.processes(rows).select(c("pid").alias("event_id"), "job_id", "pod")


@query("sca_23_environ", "select event_id, cast(cpu as varchar) as gpus from ev", "ev")
def _(spark, sf_dir):
    envs = F.concat(F.lit("A=1"), F.lit("\u0000CUDA_VISIBLE_DEVICES="), c("cpu").cast("string"), F.lit("\u0000EMPTY="))
    return landed.processes(events(spark, sf_dir).select("node_id", c("event_id").alias("pid"), F.lit("w").alias("comm"), F.lit("").alias("cgroup"), envs.alias("environ"))).select(c("pid").alias("event_id"), "gpus")


@query("set_2_union_sources", "select node_id, window_seq, count(*) as n from (select node_id, window_seq from ev where kind = 'IrqEntry' union all select node_id, window_seq from ev where kind = 'HardwareCounter') group by all", "ev")
def _(spark, sf_dir):
    ev = events(spark, sf_dir)
    a, b = ev.filter("kind = 'IrqEntry'").select(*K, "cpu"), ev.filter("kind = 'HardwareCounter'").select(*K, "port")
    return a.unionByName(b, allowMissingColumns=True).groupBy(*K).agg(F.count("*").alias("n"))


@query("set_3_label_values", "select distinct node_id, port from ev where kind = 'HardwareCounter'", "ev")
def _(spark, sf_dir):
    return events(spark, sf_dir).filter("kind = 'HardwareCounter'").select("node_id", "port").distinct()


@query("str_7_first_snapshot", "select node_id, min(window_seq) as first_window from wi where window_seq > (select min(window_seq) from wi) group by all")
def _(spark, sf_dir):
    return windows.snapshot_windows(snapshots(spark, sf_dir)).groupBy("node_id").agg(F.min("snapshot").alias("first_window"))


@query("flq_5_events_total", "select cast(sum(n_events) as bigint) as events from wi")
def _(spark, sf_dir):
    return wins(spark, sf_dir).agg(F.sum("n_events").alias("events"))


@query("flq_7_gauges", f"select node_id, cast(floor(window_seq / 4) as bigint) as step, round(max_by({DOMINANT}, window_seq), 6) as value from wi group by 1, 2")
def _(spark, sf_dir):
    out = fleet.resample(wins(spark, sf_dir), X.dominant_cpu_pct(), 4)
    return out.select("node_id", "step", r6("value").alias("value"))


@query("flq_8_increase", "select node_id, window_seq, cast(sum(slab_allocs) over (partition by node_id order by window_seq range between 4 preceding and current row) as bigint) as increase from wi")
def _(spark, sf_dir):
    return wins(spark, sf_dir).select(*K, fleet.increase(None, "slab_allocs", 5).alias("increase"))


_link = " + ".join(fleet.LINK_ERRORS)


@query("flq_10_link_series", " union all ".join(f"select node_id, port, window_seq, '{x}' as series, {x} as value from pw" for x in ("symbol_errors", "rcv_errors", "link_downed")), "pw")
def _(spark, sf_dir):
    return fleet.link_series(ports(spark, sf_dir), ["symbol_errors", "rcv_errors", "link_downed"])


@query("flq_11_link_throughput", f"select node_id, port, window_seq, rcv_data * 4 as rx_bytes, xmit_data * 4 as tx_bytes, {BYTES} as bytes, {PKTS} as packets from pw", "pw")
def _(spark, sf_dir):
    return fleet.link_throughput(ports(spark, sf_dir))


@query("flq_12_link_errors", f"select node_id, port, window_seq, {_link} as errors from pw", "pw")
def _(spark, sf_dir):
    return fleet.link_errors(ports(spark, sf_dir))


@query("flq_13_link_now", "select node_id, port, max_by(link_downed, window_seq) as link_downed, max_by(link_recovery, window_seq) as link_recovery, max_by(xmit_wait, window_seq) as xmit_wait from pw group by all", "pw")
def _(spark, sf_dir):
    return fleet.latest(ports(spark, sf_dir), ["node_id", "port"], "window_seq", ["link_downed", "link_recovery", "xmit_wait"])


@query("flq_14_errors_vs_throughput", f"select node_id, port, window_seq, {_link} as errors, {BYTES} as bytes from pw", "pw")
def _(spark, sf_dir):
    p = ports(spark, sf_dir)
    return fleet.link_errors(p).join(fleet.link_throughput(p).select("node_id", "port", "window_seq", "bytes"), ["node_id", "port", "window_seq"])


@query("join_8_series_sum", "select a.node_id, a.window_seq, a.rcv_data + b.rcv_data as rcv_data from pw a join pw b on a.node_id = b.node_id and a.window_seq = b.window_seq where a.port = 1 and b.port = 2", "pw")
def _(spark, sf_dir):
    p = ports(spark, sf_dir)
    two = p.filter("port = 2").select(*K, c("rcv_data").alias("_b"))
    return p.filter("port = 1").join(two, K).select(*K, (c("rcv_data") + c("_b")).alias("rcv_data"))


def _documents(spark, sf_dir, bare: bool):
    """The interrupts of each node and window as a JSON document, as a scenario file or a bare array holds them."""
    event = F.struct(F.struct((c("ts_us") * 1000).alias("timestamp_ns"), "cpu", c("qp").cast("int").alias("irq")).alias("IrqEntry"))
    rows = events(spark, sf_dir).filter("kind = 'IrqEntry'").groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("ts_us", "event_id", event.alias("e")))).alias("es"))
    name = F.concat_ws("-", F.lit("n"), c("node_id"), c("window_seq"))
    body = F.transform("es", lambda x: x["e"])
    expected = F.array(F.struct(F.lit(0).alias("after_event_index"), F.lit("Healthy").alias("expected_state")))
    value = F.to_json(body) if bare else F.to_json(F.struct(name.alias("name"), body.alias("events"), expected.alias("expected_states")))
    return rows.select(F.concat(name, F.lit(".json")).alias("file"), value.alias("value"))


_position = "select 'n-' || node_id || '-' || window_seq as scenario, row_number() over (partition by node_id, window_seq order by ts_us, event_id) - 1 as position, ts_us * 1000 as timestamp_ns, cpu from ev where kind = 'IrqEntry'"
def _landed(spark, sf_dir, documents):
    return landed.scenario_events(landed.parse_scenarios(documents)).select("scenario", c("position").cast("long").alias("position"), "timestamp_ns", "cpu")


for _name, _bare in (("src_1_event_array", True), ("src_2_scenario", False)):
    query(_name, _position, "ev")(lambda spark, sf_dir, bare=_bare: _landed(spark, sf_dir, _documents(spark, sf_dir, bare)))


@query("src_3_either_shape", _position, "ev")
def _(spark, sf_dir):
    """A folder of both shapes, and of documents that are neither, which are listed as rejected and give no events."""
    arrays, scenarios_ = (_documents(spark, sf_dir, bare) for bare in (True, False))
    odd = F.crc32("file") % 2 == 1
    broken = arrays.select(F.concat(F.lit("x"), c("file")).alias("file"), F.concat(F.lit("{"), c("value")).alias("value"))
    return _landed(spark, sf_dir, arrays.filter(odd).unionByName(scenarios_.filter(~odd)).unionByName(broken))


@query("src_15_processes", "select event_id as pid, cast(qp as varchar) as job_id, cast(cpu as varchar) as gpus from ev", "ev")
def _(spark, sf_dir):
    envs = F.concat(F.lit("SLURM_JOB_ID="), c("qp").cast("string"), F.lit("\u0000CUDA_VISIBLE_DEVICES="), c("cpu").cast("string"))
    return landed.processes(events(spark, sf_dir).select("node_id", c("event_id").alias("pid"), F.lit("w").alias("comm"), F.lit("0::/user").alias("cgroup"), envs.alias("environ"))).select("pid", "job_id", "gpus")


@query("str_1_tumbling", "select node_id, time_bucket(interval '6 hours', make_timestamp(ts_us), timestamp '2024-01-01') as start, count(*) as n from ev group by all", "ev")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("t", F.timestamp_micros("ts_us").cast("timestamp_ntz"))
    return rows.groupBy("node_id", F.window("t", "6 hours")["start"].alias("start")).agg(F.count("*").alias("n"))
