"""The verdict as recursive SQL for DuckDB: rolling statistics, link rule, raw score, smoothing and state machines.

Each recursion walks a node's windows in order; what is not recursive is a join or a window between them.
"""

from __future__ import annotations

from fabrichealth.config import SCALED
from fabrichealth.operators import rules
from fabrichealth.operators.folds import EPSILON
from fabrichealth.plans.base import ALL, BYTES, DOMINANT, FLOW, HARD, P99, PKTS, SCORE, SIGNAL, SOFT, TOTAL, TRAFFIC, D

T = SCALED
NODE = "nid"


def rollings(name: str, source: str, tracks: dict[str, tuple[str, float, float | None, float | None]]) -> str:
    """Rolling statistics of several columns of ``source(nid, rn, ...)`` in one walk: before each row z, mean and n of each track, and warm after it."""
    first, inner, outer = [], [], []
    for t, (value, alpha, most, least) in tracks.items():
        a = D(alpha)
        first.append(f"{D(0)} as {t}_z, {D(0)} as {t}_before, false as {t}_warm, {value} as {t}_mean, {D(0)} as {t}_var, 1 as {t}_n, cast(null as double) as {t}_base")
        inner.append(
            f"case when p.{t}_n >= 3 and sqrt(p.{t}_var) >= {EPSILON!r} then (s.{value} - p.{t}_mean) / sqrt(p.{t}_var) else 0 end as {t}_z, p.{t}_mean as {t}_before, p.{t}_n + 1 >= 5 as {t}_warm,"
            f" p.{t}_mean + {a} * (s.{value} - p.{t}_mean) as {t}_m, (1 - {a}) * (p.{t}_var + {a} * (s.{value} - p.{t}_mean) * (s.{value} - p.{t}_mean)) as {t}_var, p.{t}_n + 1 as {t}_n,"
            f" case when p.{t}_base is null and p.{t}_n + 1 = 5 then p.{t}_mean + {a} * (s.{value} - p.{t}_mean) else p.{t}_base end as {t}_base"
        )
        bound = f"least({t}_m, {t}_base * {D(most)})" if most is not None else f"greatest({t}_m, {t}_base * {D(least)})"
        outer.append(f"{t}_z, {t}_before, {t}_warm, case when {t}_base > {EPSILON!r} then {bound} else {t}_m end as {t}_mean, {t}_var, {t}_n, {t}_base")
    return f"""{name} as (select nid, rn, window_seq, {", ".join(first)} from {source} where rn = 1 union all
  select nid, rn, window_seq, {", ".join(outer)} from (select s.nid, s.rn, s.window_seq, {", ".join(inner)} from {name} p join {source} s on s.nid = p.nid and s.rn = p.rn + 1))"""


def track(name: str, source: str, alpha: float, decay: float, enter: int, leave: int) -> str:
    """Smoothing and state machine of ``source(nid, rn, raw)``: ewma, peak, effective, state and windows in it."""
    c = T.state
    upper = f"case when s.state = 'HEALTHY' then {D(c.degrade_enter)} else {D(c.critical_enter)} end"
    up = f"case when s.state <> 'CRITICAL' and e.effective >= {upper} then s.rising + 1 else 0 end"
    return f"""{name}_s as (select nid, rn, raw as ewma, raw as peak from {source} where rn = 1 union all
  select r.nid, r.rn, p.ewma + {D(alpha)} * (r.raw - p.ewma), case when r.raw >= p.peak then r.raw else p.peak * {D(decay)} end from {name}_s p join {source} r on r.nid = p.nid and r.rn = p.rn + 1),
{name}_e as materialized (select *, greatest(ewma, peak) as effective from {name}_s),
{name}_m as (select nid, cast(0 as bigint) as rn, 'HEALTHY' as state, 0 as rising, 0 as calm, 0 as held, 0 as inside from (select distinct nid from {source}) union all
  select nid, rn, nstate, case when nstate <> state then 0 else up end, case when nstate <> state then 0 else ncalm end, case when nstate <> state then 0 else nheld end, case when nstate <> state then 0 else inside + 1 end from (
    select *, case
      when state = 'HEALTHY' then case when up >= {enter} then 'DEGRADED' else state end
      when state = 'DEGRADED' then case when up >= {enter} then 'CRITICAL' when ncalm >= {leave} then 'HEALTHY' else state end
      when state = 'CRITICAL' then case when ncalm >= {leave} then 'RECOVERING' else state end
      else case when up >= {enter} then 'CRITICAL' when nheld >= {c.recover_windows} then 'DEGRADED' else state end end as nstate from (
    select e.nid, e.rn, s.state, s.inside, {up} as up,
      case when s.state = 'DEGRADED' then case when ({up}) >= {enter} then s.calm when e.effective < {D(c.degrade_exit)} then s.calm + 1 else 0 end
           when s.state = 'CRITICAL' then case when e.effective < {D(c.critical_exit)} then s.calm + 1 else 0 end else 0 end as ncalm,
      case when s.state = 'RECOVERING' then s.held + 1 else 0 end as nheld
    from {name}_m s join {name}_e e on e.nid = s.nid and e.rn = s.rn + 1))),
{name} as materialized (select e.*, m.state, m.inside from {name}_e e join {name}_m m using (nid, rn))"""


def _clamped(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


def _fusion() -> str:
    """The shares of the active providers' samples, in their order."""
    link = f"({HARD} + 5 * link_recovery + 50 * link_downed)"
    retx = f"(rxe_retry_exceeded + {D(0.5)} * rxe_seq_error + {D(0.3)} * rxe_duplicate_request)"
    mean = "(case when cq_completions > 0 then cq_latency_total / cq_completions else 0 end)"
    sure = f"least(greatest(cq_completions / {D(100)}, {D(0.05)}), {D(0.7)})"
    busy = lambda a, b: f"(case when {TRAFFIC} then {D(a)} else {D(b)} end)"
    parts = [f"case when {link} > 0 then {_clamped(f'{link} / {D(50)}')} else 0 end * {D(1.0)} * ({D(1.0)} * {busy(1.0, 0.2)})"]
    parts += [f"case when cq_completions > 0 and {v} > 0 then {_clamped(f'({v} - {D(100_000)}) / {D(900_000)}')} else 0 end * {D(0.6)} * ({D(0.4)} * {sure})" for v in (mean, P99, "cq_latency_max")]
    parts.append(f"case when {retx} > 0 then case when {retx} <= 1 then {retx} else {_clamped(f'{retx} / {D(100)}')} end else 0 end * {D(0.8)} * ({D(0.7)} * {busy(0.8, 0.2)})")
    parts.append(f"case when xmit_wait >= 1 and {HARD} < 1 then {_clamped(f'xmit_wait / {D(100)}')} else 0 end * {D(0.5)} * ({D(0.4)} * {D(0.3)})")
    return f"least(greatest(tanh(({' + '.join(parts)}) / {D(2)}) * {D(0.5)}, 0), {D(0.5)})"


def _both(fires: str, critical: str) -> str:
    return f"case when {fires} then case when {critical} then 'CRITICAL' else 'DEGRADED' end end"


def verdict_views(node: str = "node_id", weights: str | None = None) -> str:
    """Views up to ``vd``: a row with every column of the verdict per node and window. ``node`` keys the walks; ``weights(node_id, rule, weight)`` is a view."""
    mean = "(completion_latency_total // completions)"
    napi = "(napi_work / napi_budget * 100)"
    rule = {
        "interrupt_affinity_skew": _both(f"irq_total >= {T.irq_minimum} and {DOMINANT} >= 70", f"{DOMINANT} >= 90"),
        "rdma_latency_spike": _both(f"completions >= {T.latency_minimum} and {mean} >= {int(T.latency_baseline_ns * T.latency_factor)}", f"{mean} / {T.latency_baseline_ns} >= 10"),
        "rdma_link_degradation": "link_severity",
        "slab_pressure_correlation": _both(f"slab_allocs >= {T.slab_pressure} and {TOTAL} > 0", f"{TOTAL} > 100"),
        "rising_error_trend": _both(f"streak >= {T.trend_streak} and {TOTAL} > 0", "streak >= 6"),
        "latency_drift": _both(f"drift_warm and abs(drift_z) >= {D(T.z)}", f"abs(drift_z) >= {D(2 * T.z)}"),
        "throughput_drop": _both(f"flow_warm and flow_before >= 1 and (flow_before - moved) / flow_before * 100 >= {D(T.drop_pct)}", f"(flow_before - moved) / flow_before * 100 >= {D(80)}"),
        "napi_saturation": _both(f"napi_polls >= {T.napi_minimum} and napi_budget >= napi_polls and {napi} >= {T.napi_pct}", f"{napi} >= 95"),
        "cq_jitter_stall": f"case when cq_completions >= {T.stall_minimum} then case when cq_stalls > 0 then case when cq_stalls > 10 or cq_latency_max > 1000000 then 'CRITICAL' else 'DEGRADED' end when stall_warm and stall_z >= {D(T.z)} then 'DEGRADED' end end",
        "congestion_spread": _both(f"wait_warm and xmit_wait >= 1 and {HARD} + link_recovery = 0 and wait_z >= {D(T.z)}", f"wait_z >= {D(2 * T.z)}"),
        "pcie_bottleneck": _both(f"cq_stalls >= {T.pcie_stalls} and slab_allocs >= {T.pcie_allocs} and {ALL} = 0", "false"),
    }
    severities = ", ".join(f"{rule[r]} as s{i}" for i, r in enumerate(rules.ORDER))
    n = range(len(rules.ORDER))
    worst = "case " + " ".join(f"when s{i} = 'CRITICAL' then {i}" for i in n) + " " + " ".join(f"when s{i} = 'DEGRADED' then {i}" for i in n) + " end"
    names = "[" + ", ".join(f"'{r}'" for r in rules.ORDER) + "]"
    alerts = "concat_ws(',', " + ", ".join(f"'{r}:' || s{i}" for i, r in enumerate(rules.ORDER)) + ")"
    z = "greatest(sym_z, rec_z, soft_z)"
    raised = "least(p.elevated + 1, 10)"
    ceiling = D(T.link_ceiling)
    cause = f"""case when link_downed > 0 then 'link_down' when link_recovery > 0 then 'link_recovery' when {HARD} > {T.link_budget} then 'budget'
    when {ALL} > 0 and {TRAFFIC} and {ALL} / {FLOW} >= {ceiling} then 'ceiling' when sym_warm and {ALL} > 0 and {z} >= {D(T.z)} then 'anomaly' end"""
    weight = "coalesce(w.weight, 1)" if weights else "1"
    joined = f"left join {weights} w on w.node_id = x.node_id and w.rule = {names}[worst + 1]" if weights else ""
    tails = [track("tk", "rw", 0.3, 0.85, T.state.enter_windows, T.state.exit_windows), track("fa", "rw", 0.6, 0.5, 1, max(2, T.state.exit_windows // 2)), track("sl", "rw", 0.1, 0.95, max(4, 2 * T.state.enter_windows), max(8, 2 * T.state.exit_windows))]
    rank = lambda x: f"case {x}.state when 'CRITICAL' then 2 when 'HEALTHY' then 0 else 1 end"
    return f""", rise as (select node_id, window_seq, coalesce({TOTAL} > lag({TOTAL}) over (partition by node_id order by window_seq), false) as rises, row_number() over (partition by node_id order by window_seq) as k from wi),
risen as (select node_id, window_seq, k - coalesce(max(case when not rises then k end) over (partition by node_id order by window_seq), 0) as streak from rise),
xs as materialized (select wi.*, streak, {node} as nid, row_number() over (partition by {node} order by window_seq) as rn, cast({FLOW} as double) as flow,
  cast(case when {BYTES} > 0 then {BYTES} else {PKTS} end as double) as moved, cast(xmit_wait as double) as waited, symbol_errors / cast({FLOW} as double) as sym, (rcv_errors + xmit_discards) / cast({FLOW} as double) as rec, {SOFT} / cast({FLOW} as double) as soft,
  {SCORE} as fresh, {SIGNAL} as signal, {_fusion()} as fusion from wi join risen using (node_id, window_seq)),
{rollings("ra", "xs", {"sym": ("sym", 0.1, 3.0, None), "rec": ("rec", 0.1, 3.0, None), "soft": ("soft", 0.1, 3.0, None), "flow": ("moved", 0.1, None, 0.5), "wait": ("waited", 0.1, 5.0, None)})},
xc as materialized (select nid, window_seq, row_number() over (partition by nid order by window_seq) as rn, cq_latency_total / cq_completions as mean, cast({P99} as double) as p99 from xs where cq_completions > 0),
{rollings("rq", "xc", {"drift": ("mean", 0.1, 5.0, None), "stall": ("p99", 0.1, 5.0, None)})},
xr as materialized (select xs.*, ra.* exclude (nid, rn, window_seq), rq.* exclude (nid, rn, window_seq) from xs join ra using (nid, rn) left join rq on rq.nid = xs.nid and rq.window_seq = xs.window_seq),
lc as materialized (select nid, rn, {cause} as cause, {ALL} / {FLOW} as share, {z} as z, {HARD} as hard from xr),
lk as (select nid, cast(0 as bigint) as rn, 0 as elevated, 0 as cooldown, 'NOMINAL' as link, cast(null as varchar) as cause, cast(null as varchar) as severity from (select distinct nid from lc) union all
  select l.nid, l.rn,
    case when l.cause in ('link_down', 'link_recovery') then 0 when l.cause is not null then {raised} when p.cooldown > 0 then p.elevated when p.elevated > 0 then p.elevated - 1 else 0 end,
    case when l.cause in ('link_down', 'link_recovery') then p.cooldown when l.cause is not null then 3 when p.cooldown > 0 then p.cooldown - 1 when p.elevated > 1 then 3 else 0 end,
    case when l.cause = 'link_down' then 'DOWN' when l.cause = 'link_recovery' then 'RECOVERING' when l.cause is not null then 'ELEVATED'
      when (case when p.cooldown > 0 then p.elevated when p.elevated > 0 then p.elevated - 1 else 0 end) = 0 then 'NOMINAL' else p.link end,
    l.cause,
    case when l.cause is null then null when l.cause in ('link_down', 'link_recovery') then 'CRITICAL' when l.cause = 'budget' then case when l.hard > {10 * T.link_budget} then 'CRITICAL' else 'DEGRADED' end
      when l.cause = 'ceiling' then case when l.share >= {D(3.0)} * {ceiling} or {raised} >= 3 then 'CRITICAL' else 'DEGRADED' end
      else case when l.z >= {D(2 * T.z)} or {raised} >= 3 then 'CRITICAL' else 'DEGRADED' end end
  from lk p join lc l on l.nid = p.nid and l.rn = p.rn + 1),
xa as materialized (select x.node_id, x.window_seq, x.nid, x.rn, fresh, signal, fusion, cause as link_cause, link as link_state, {severities}
  from (select xr.*, lk.cause, lk.link, lk.severity as link_severity from xr join lk using (nid, rn)) x),
xw as (select *, {worst} as worst from xa),
xf as materialized (select x.*, {names}[worst + 1] as worst_rule, {alerts} as alerts, coalesce(case worst {" ".join(f"when {i} then s{i}" for i in n)} end, 'HEALTHY') as severity,
  case when worst is null then 0 else (case (case worst {" ".join(f"when {i} then s{i}" for i in n)} end) when 'CRITICAL' then {D(T.state.critical_enter)} else {D(T.state.degrade_enter)} end) * {weight} end as floor from xw x {joined}),
rw as (select nid, rn, greatest(least((case when signal then fresh else greatest(0, fresh) end) + fusion, 1), floor) as raw from xf where rn = 1 union all
  select x.nid, x.rn, greatest(least((case when signal then fresh else greatest({D(0.9)} * p.raw, fresh) end) + fusion, 1), floor) from rw p join xf x on x.nid = p.nid and x.rn = p.rn + 1),
{", ".join(tails)},
bu as (select nid, rn, sum(case when raw >= {D(0.40)} then 1 else 0 end) over (partition by nid order by rn rows between 29 preceding and current row) as spikes from rw),
vd as (select xf.node_id, xf.window_seq, round(rw.raw, 6) as raw, round(tk.ewma, 6) as ewma, round(tk.peak, 6) as peak, round(tk.effective, 6) as effective, tk.state, severity, worst_rule, alerts, link_cause, link_state,
  fa.state as fast_state, tk.state as medium_state, sl.state as slow_state,
  case when {rank("sl")} >= {rank("tk")} and {rank("sl")} >= {rank("fa")} then sl.state when {rank("tk")} >= {rank("fa")} then tk.state else fa.state end as composite_state,
  case when spikes >= 2 or fa.state in ('DEGRADED', 'CRITICAL') then case when sl.state in ('DEGRADED', 'CRITICAL') then 'MIXED' else 'BURST' end when sl.state in ('DEGRADED', 'CRITICAL') then 'SUSTAINED' else 'QUIET' end as burst,
  tk.state <> 'HEALTHY' and tk.inside >= {T.state.max_hold_windows} as stuck, cast(tk.inside as bigint) as windows_in_state
  from xf join rw using (nid, rn) join tk using (nid, rn) join fa using (nid, rn) join sl using (nid, rn) join bu using (nid, rn))"""
