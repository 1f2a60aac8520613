"""Shared views of the registered queries, in Spark and in DuckDB's SQL, and the registry itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.operators import rules, windows
from fabrichealth.schemas import DELTAS
from fabrichealth.sources.adapter import EV, telemetry

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, views: str = "wi", recursive: bool = False):
    """Register a query; its SQL follows the shared views it needs (ev, rd, wi, pw or none)."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"with {'recursive ' if recursive else ''}{VIEWS[views]}\n" if views else "") + sql
        return f

    return keep


def also(alias: str, name: str) -> None:
    """Register a query under a second operator that it computes as well."""
    QUERIES[alias] = QUERIES[name]
    if name in ORACLES:
        ORACLES[alias] = ORACLES[name]


RD = """rd as (select *, cast(greatest(coalesce(reading - lag(reading) over (partition by node_id, port, counter order by ts_us, event_id), 0), 0) as bigint) as delta from ev where kind = 'HardwareCounter')"""
_counters = ", ".join(f"cast(coalesce(sum(delta) filter (counter = {i}), 0) as bigint) as {name}" for i, name in enumerate(DELTAS))
_cq = "count(*) filter (kind = 'CqCompletion')"
WA = f"""wa as (select node_id, window_seq, count(*) as n_events, min(ts_us) as window_start_us, max(ts_us) as window_end_us,
  count(*) filter (kind = 'SlabAlloc') as slab_allocs, count(*) filter (kind = 'SlabFree') as slab_frees, cast(sum(latency_ns) filter (kind = 'SlabAlloc') as bigint) as slab_latency_total, max(latency_ns) filter (kind = 'SlabAlloc') as slab_latency_max,
  cast(sum(bytes_req) filter (kind = 'SlabAlloc') as bigint) as slab_bytes_req, cast(sum(bytes_alloc) filter (kind = 'SlabAlloc') as bigint) as slab_bytes_alloc,
  count(*) filter (kind = 'IrqEntry') as irq_total, {", ".join(f"count(*) filter (kind = 'IrqEntry' and cpu = {i}) as irq{i}" for i in range(4))},
  count(*) filter (kind = 'NapiPoll') as napi_polls, cast(sum(work_done) filter (kind = 'NapiPoll') as bigint) as napi_work, cast(sum(budget) filter (kind = 'NapiPoll') as bigint) as napi_budget,
  count(*) filter (kind = 'NetifReceive') as rx_packets, cast(sum(len) filter (kind = 'NetifReceive') as bigint) as rx_bytes, {_cq} as completions, count(*) filter (kind = 'CqCompletion' and is_error) as completion_errors, cast(sum(latency_ns) filter (kind = 'CqCompletion') as bigint) as completion_latency_total,
  max(latency_ns) filter (kind = 'CqCompletion') as completion_latency_max, {_cq} as cq_completions, cast(sum(latency_ns) filter (kind = 'CqCompletion') as bigint) as cq_latency_total, max(latency_ns) filter (kind = 'CqCompletion') as cq_latency_max,
  count(*) filter (kind = 'CqCompletion' and latency_ns > 50000) as cq_stalls from ev group by all)"""
WC = f"wc as (select node_id, window_seq, {_counters} from rd group by all)"
_zero = [*(c for c in windows.SUMS), *(f"irq{i}" for i in range(4)), *DELTAS]
WI = f"""sp as (select node_id, window_seq from (select distinct node_id from wa), (select unnest(generate_series((select min(window_seq) from wa), (select max(window_seq) from wa))) as window_seq)),
wi as (select sp.node_id, sp.window_seq, window_start_us, window_end_us, {", ".join(f"coalesce({c}, 0) as {c}" for c in _zero)} from sp left join wa using (node_id, window_seq) left join wc using (node_id, window_seq))"""
PW = f"pw as (select node_id, port, window_seq, {_counters} from rd group by all)"
VIEWS = {"ev": EV, "rd": f"{EV},\n{RD}", "pw": f"{EV},\n{RD},\n{PW}", "wi": f"{EV},\n{RD},\n{WA},\n{WC},\n{WI}", "": ""}

HARD = "(symbol_errors + link_downed + remote_physical_errors + integrity_errors + buffer_overruns)"
SOFT = "(rxe_duplicate_request + rxe_seq_error + rxe_retry_exceeded + rxe_send_error)"
TOTAL = f"({HARD} + rcv_errors + xmit_discards)"
ALL = f"({TOTAL} + {SOFT})"
BYTES, PKTS = "((rcv_data + xmit_data) * 4)", "(rcv_pkts + xmit_pkts)"
FLOW = f"greatest({BYTES}, {PKTS}, 1)"
TRAFFIC = f"({BYTES} > 0 or {PKTS} > 0)"
SIGNAL = f"({TRAFFIC} or {SOFT} > 0 or {HARD} > 0 or link_recovery > 0 or link_downed > 0)"
DOMINANT = "(case when irq_total > 0 then greatest(irq0, irq1, irq2, irq3) / irq_total * 100 else 0 end)"
P99 = "(case when cq_stalls > 0 then cq_latency_max * cast(0.9 as double) when cq_completions > 0 then cq_latency_total / cq_completions * 2 else 0 end)"
SLABAVG = "(case when slab_allocs > 0 then slab_latency_total // slab_allocs else 0 end)"
D = lambda x: f"cast({x} as double)"
_util = "((napi_work / napi_polls) / (napi_budget / napi_polls))"
SCORE = f"""least(
  (case when {DOMINANT} > 45 then least(({DOMINANT} - {D(45)}) / {D(55)}, 1) * {D(0.15)} else 0 end)
  + (case when link_recovery > 0 then {D(0.35)} else 0 end) + (case when link_downed > 0 then {D(0.25)} else 0 end)
  + (case when {HARD} > 0 then least({HARD} / {FLOW} * {D(1000)}, 1) * {D(0.15)} else 0 end)
  + (case when {SOFT} > 0 and {TRAFFIC} then least({SOFT} / {FLOW} * {D(100)}, 1) * {D(0.25)} else 0 end)
  + (case when {SLABAVG} > 1000 and (cq_stalls > 0 or {SOFT} > 0 or {HARD} > 0) then least(({SLABAVG} - {D(1000)}) / {D(10000)}, 1) * {D(0.05)} else 0 end)
  + (case when napi_polls > 0 and {_util} > {D(0.7)} then least(({_util} - {D(0.7)}) / {D(0.3)}, 1) * {D(0.05)} else 0 end)
  + (case when cq_stalls > 0 then least(cq_stalls / greatest(cq_completions, 1), 1) * {D(0.15)} else 0 end)
  + (case when xmit_wait > 0 and {HARD} = 0 then {D(0.10)} else 0 end), {D(1)})"""


def events(spark, sf_dir):
    return telemetry(spark, sf_dir)


def readings(spark, sf_dir):
    return windows.counter_deltas(events(spark, sf_dir).filter("kind = 'HardwareCounter'"))


def wins(spark, sf_dir):
    return windows.health_windows(events(spark, sf_dir))


def ports(spark, sf_dir):
    return windows.port_counters(events(spark, sf_dir))


def ruled(spark, sf_dir):
    return rules.with_rules(wins(spark, sf_dir), SCALED)


def r6(x):
    return F.round(x.cast("double") if hasattr(x, "cast") else F.col(x).cast("double"), 6)
