"""Queries of folds, samples, coverage, joins, fleet state, alerts, scheduling and sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.functions import exprs as X
from fabrichealth.operators import alerting, fleet, folds, joins, rules, samples, scans, scheduling, sketches
from fabrichealth.plans.base import ALL, BYTES, HARD, P99, PKTS, SCORE, SIGNAL, TRAFFIC, D, also, events, ports, query, r6, wins
from fabrichealth.plans.window_queries import K
from fabrichealth.schemas import CAPABILITY_WEIGHTS
from fabrichealth.sources import landed, sinks, store
from fabrichealth.sources.adapter import completions

c, lit = F.col, F.lit


def history(spark, sf_dir, windows=None):
    """Health history by the smoothing and state machine over the plain composite score."""
    return folds.fold_column(scored(spark, sf_dir, windows), lambda: folds.Track(0.3, 0.85, SCALED.state), _track, "node_id long, window_seq long, raw double, ewma double, peak double, effective double, state string")


def _track(track, r):
    state = track.update(r["raw"])
    return {"ewma": track.score.mean, "peak": track.score.peak, "effective": max(track.score.mean, track.score.peak), "state": state}


# the smoothing and the state machine as a recursive SQL walk over each node's windows
_next = "case when s.state = 'HEALTHY' then 0.30 else 0.55 end"
_up = f"case when s.state <> 'CRITICAL' and e.effective >= cast({_next} as double) then s.rising + 1 else 0 end"
SMOOTH = f""", raws as materialized (select node_id, window_seq, row_number() over (partition by node_id order by window_seq) as rn, {SCORE} as raw from wi),
sm as (select node_id, rn, window_seq, raw, raw as ewma, raw as peak from raws where rn = 1 union all
  select r.node_id, r.rn, r.window_seq, r.raw, s.ewma + {D(0.3)} * (r.raw - s.ewma), case when r.raw >= s.peak then r.raw else s.peak * {D(0.85)} end
  from sm s join raws r on r.node_id = s.node_id and r.rn = s.rn + 1),
eff as materialized (select *, greatest(ewma, peak) as effective from sm),
st as (select node_id, cast(0 as bigint) as rn, 'HEALTHY' as state, 0 as rising, 0 as calm, 0 as held from (select distinct node_id from eff) union all
  select node_id, rn, nstate, case when nstate <> state then 0 else up end, case when nstate <> state then 0 else ncalm end, case when nstate <> state then 0 else nheld end from (
    select *, case
      when state = 'HEALTHY' then case when up >= 2 then 'DEGRADED' else state end
      when state = 'DEGRADED' then case when up >= 2 then 'CRITICAL' when ncalm >= 5 then 'HEALTHY' else state end
      when state = 'CRITICAL' then case when ncalm >= 5 then 'RECOVERING' else state end
      else case when up >= 2 then 'CRITICAL' when nheld >= 3 then 'DEGRADED' else state end end as nstate from (
    select e.node_id, e.rn, s.state, {_up} as up,
      case when s.state = 'DEGRADED' then case when ({_up}) >= 2 then s.calm when e.effective < {D(0.10)} then s.calm + 1 else 0 end
           when s.state = 'CRITICAL' then case when e.effective < {D(0.30)} then s.calm + 1 else 0 end else 0 end as ncalm,
      case when s.state = 'RECOVERING' then s.held + 1 else 0 end as nheld
    from st s join eff e on e.node_id = s.node_id and e.rn = s.rn + 1))),
hist as materialized (select eff.node_id, window_seq, raw, ewma, peak, effective, state from eff join st using (node_id, rn))"""


def state_query(name, tail):
    """A query over the health history; its SQL walks the windows recursively."""
    return query(name, SMOOTH + " " + tail, recursive=True)


_six = "round(raw, 6) as raw, round(ewma, 6) as ewma, round(peak, 6) as peak, round(effective, 6) as effective"


def scored(spark, sf_dir, windows=None):
    return (wins(spark, sf_dir) if windows is None else windows).select(*K, X.composite_score(4).alias("raw"))


@state_query("fold_2_smoothed", f"select node_id, window_seq, {_six} from hist")
def _(spark, sf_dir):
    return scans.smoothed(scored(spark, sf_dir)).select(*K, *[r6(x).alias(x) for x in ("raw", "ewma", "peak", "effective")])


@state_query("fold_3_state_machine", "select node_id, window_seq, state from hist")
def _(spark, sf_dir):
    return history(spark, sf_dir).select(*K, "state")


@state_query("scr_5_published_score", "select node_id, window_seq, round(effective, 6) as composite from hist")
def _(spark, sf_dir):
    return scans.smoothed(scored(spark, sf_dir)).select(*K, r6("effective").alias("composite"))


@state_query("win_5_transitions", "select * from (select node_id, window_seq, coalesce(lag(state) over (partition by node_id order by window_seq), 'HEALTHY') as from_state, state as to_state from hist) where from_state <> to_state")
def _(spark, sf_dir):
    return fleet.transitions(history(spark, sf_dir))


@state_query("win_9_time_in_state", ", x as (select *, case when state = lag(state) over (partition by node_id order by window_seq) then 0 else 1 end as ch from hist), y as (select *, sum(ch) over (partition by node_id order by window_seq) as g from x) select node_id, window_seq, state, row_number() over (partition by node_id, g order by window_seq) as windows_in_state from y")
def _(spark, sf_dir):
    order = W.partitionBy("node_id").orderBy("window_seq")
    rows = history(spark, sf_dir).withColumn("_c", F.when(F.lag("state").over(order) == c("state"), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(order))
    return rows.select(*K, "state", F.row_number().over(W.partitionBy("node_id", "_g").orderBy("window_seq")).cast("long").alias("windows_in_state"))


@state_query("win_10_drain_duration", "select node_id, window_seq, window_seq - last_value(case when state = 'CRITICAL' then window_seq end ignore nulls) over (partition by node_id order by window_seq) as since from hist")
def _(spark, sf_dir):
    return history(spark, sf_dir).select(*K, (c("window_seq") - F.last(F.when(c("state") == "CRITICAL", c("window_seq")), ignorenulls=True).over(W.partitionBy("node_id").orderBy("window_seq"))).alias("since"))


@state_query("flq_1_state_counts", ", n as (select node_id, max_by(state, window_seq) as state from hist group by all) select count(*) filter (state = 'HEALTHY') as healthy, count(*) filter (state = 'DEGRADED') as degraded, count(*) filter (state = 'CRITICAL') as critical, count(*) filter (state = 'RECOVERING') as recovering from n")
def _(spark, sf_dir):
    return fleet.state_counts(history(spark, sf_dir))


@state_query("flq_2_worst_score", ", n as (select node_id, max_by(effective, window_seq) as e from hist group by all) select coalesce(max(cast(trunc(e * 1000) as bigint)) / 1000, 0) as worst_score from n")
def _(spark, sf_dir):
    return fleet.worst_score(history(spark, sf_dir))


@state_query("flq_6_timeline", ", x as (select *, case when state = lag(state) over (partition by node_id order by window_seq) then 0 else 1 end as ch from hist), y as (select *, sum(ch) over (partition by node_id order by window_seq) as g from x) select node_id, state, min(window_seq) as first_window, max(window_seq) as last_window, count(*) as windows from y group by node_id, g, state")
def _(spark, sf_dir):
    return fleet.timeline(history(spark, sf_dir)).drop("stretch")


_table = f", n as (select node_id, max_by(state, window_seq) as state, max_by(effective, window_seq) as e from hist group by all), m as (select node_id, max_by({ALL}, window_seq) as errors, max_by(case when napi_budget > 0 then napi_work / napi_budget * 100 else 0 end, window_seq) as napi from wi group by all) select node_id, state, cast(trunc(e * 1000) as bigint) as score, errors, round(napi, 6) as napi_pct from n full join m using (node_id)"


def _node_table(spark, sf_dir):
    windows = wins(spark, sf_dir)
    return fleet.node_table(history(spark, sf_dir, windows), windows)


@state_query("flq_9_node_table", _table)
def _(spark, sf_dir):
    return _node_table(spark, sf_dir).withColumn("napi_pct", r6("napi_pct"))


state_query("join_9_merge_instant", _table.replace("round(napi, 6)", "napi"))(lambda spark, sf_dir: _node_table(spark, sf_dir))


def nodes(spark, sf_dir):
    """Every supplier as an inventory target; most have no telemetry."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(c("s_suppkey").cast("long").alias("node_id"), c("s_name").alias("name"), c("s_nationkey").cast("long").alias("region"))


@state_query("join_10_unreachable", ", n as (select node_id, max_by(state, window_seq) as state from hist group by all) select cast(s_suppkey as bigint) as node_id, s_name as name, coalesce(state, 'unreachable') as state from supplier left join n on s_suppkey = node_id")
def _(spark, sf_dir):
    return fleet.unreachable(nodes(spark, sf_dir).select("node_id", "name"), history(spark, sf_dir))


@state_query("agg_17_fleet_rollup", ", n as (select node_id, max_by(state, window_seq) as state from hist group by all) select coalesce(state, 'unreachable') as state, count(*) as nodes from supplier left join n on s_suppkey = node_id group by all")
def _(spark, sf_dir):
    return fleet.unreachable(nodes(spark, sf_dir), history(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("nodes"))


@state_query("prj_2_state_code", "select node_id, window_seq, case state when 'HEALTHY' then 0 when 'DEGRADED' then 1 when 'CRITICAL' then 2 else 3 end as code, case state when 'CRITICAL' then 2 when 'HEALTHY' then 0 else 1 end as rank, case state when 'RECOVERING' then 'DEGRADED' else state end as scheduler from hist")
def _(spark, sf_dir):
    return history(spark, sf_dir).select(*K, X.state_code(c("state")).alias("code"), X.severity_rank(c("state")).alias("rank"), X.scheduler_view(c("state")).alias("scheduler"))


for _alias in ("sca_15_severity_rank", "sca_29_scheduler_view"):
    state_query(_alias, "select node_id, window_seq, case state when 'CRITICAL' then 2 when 'HEALTHY' then 0 else 1 end as rank, case state when 'RECOVERING' then 'DEGRADED' else state end as scheduler from hist")(
        lambda spark, sf_dir: history(spark, sf_dir).select(*K, X.severity_rank(c("state")).alias("rank"), X.scheduler_view(c("state")).alias("scheduler"))
    )


@state_query("snk_2_health_json", "select node_id, '{\"state\":\"' || max_by(state, window_seq) || '\",\"uptime_windows\":' || count(*) || ',\"last_window\":' || max(window_seq) || '}' as body from hist group by all")
def _(spark, sf_dir):
    return sinks.health_json(history(spark, sf_dir))


_changed = ", p as (select *, lag(state) over (partition by node_id order by window_seq) as before from hist) select node_id, window_seq, state from p where before is null or before <> state"


@state_query("snk_6_durable_state", _changed)
def _(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.withColumn("_c", sinks.changed(h, ["state"], "window_seq")).filter("_c").select(*K, "state")


_held = lambda cond, n: f", h as (select *, row_number() over (partition by node_id order by window_seq) as rn from hist), g as (select *, rn - coalesce(max(case when not ({cond}) then rn end) over (partition by node_id order by window_seq), 0) as held from h) select node_id, window_seq, held from g where held > {n}"


@state_query("alr_2_hold_time", _held("state = 'CRITICAL'", 2))
def _(spark, sf_dir):
    from fabrichealth.operators.windows import with_streak

    return with_streak(history(spark, sf_dir), "held", c("state") == "CRITICAL").filter("held > 2").select(*K, "held")


def series(spark, sf_dir):
    windows = wins(spark, sf_dir)
    h = history(spark, sf_dir, windows).select(*K, X.state_code(c("state")).alias("state_code"))
    return windows.join(h, K)


def alerts(spark, sf_dir):
    return alerting.alert_rules(series(spark, sf_dir), 15)


def _alr():
    parts = []
    for name, condition, hold, severity in alerting.RULES:
        n = -(-hold // 15) if hold else 0
        parts.append(f"select node_id, window_seq, '{name}' as alertname, '{severity}' as severity from (select *, rn - coalesce(max(case when not ({condition}) then rn end) over (partition by node_id order by window_seq), 0) as held from z) where held > {n}")
    return ", z as (select wi.*, row_number() over (partition by wi.node_id order by wi.window_seq) as rn, case state when 'HEALTHY' then 0 when 'DEGRADED' then 1 when 'CRITICAL' then 2 else 3 end as state_code from wi join hist using (node_id, window_seq)), al as (" + " union all ".join(parts) + ")"


@state_query("alr_1_alert_rules", _alr() + " select * from al")
def _(spark, sf_dir):
    return alerts(spark, sf_dir)


_inh = " select node_id, window_seq, alertname, severity from al a where severity = 'CRITICAL' or not exists (select 1 from al b where b.severity = 'CRITICAL' and b.node_id = a.node_id and b.window_seq = a.window_seq)"


for _alias in ("alr_4_inhibition", "join_11_inhibit"):
    state_query(_alias, _alr() + _inh)(lambda spark, sf_dir: joins.inhibit(alerts(spark, sf_dir), K))



def _now(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max("window_seq").alias("now"))


state_query("flq_3_recent_alerts", _alr() + " select coalesce(count(*), 0) as alerts from al where window_seq > (select max(window_seq) from wi) - 15")(lambda spark, sf_dir: fleet.recent_alerts(alerts(spark, sf_dir), _now(spark, sf_dir), 15, []))
state_query("flq_4_alerts_by_kind", _alr() + " select alertname, severity, count(*) as alerts from al where window_seq > (select max(window_seq) from wi) - 20 group by all")(lambda spark, sf_dir: fleet.recent_alerts(alerts(spark, sf_dir), _now(spark, sf_dir), 20, ["alertname", "severity"]))
state_query("top_3_recent_alerts", _alr() + ", r as (select *, row_number() over (partition by node_id order by window_seq desc, alertname) as rank from al) select node_id, window_seq, alertname, rank from r where rank <= 20")(
    lambda spark, sf_dir: sketches.recent(alerts(spark, sf_dir), "node_id", [F.desc("window_seq"), F.asc("alertname")], 20).select(*K, "alertname", c("rank").cast("long").alias("rank"))
)
state_query("top_4_alert_log", _alr() + " select node_id, window_seq, alertname from al order by window_seq desc, node_id, alertname limit 50")(lambda spark, sf_dir: alerts(spark, sf_dir).select(*K, "alertname").orderBy(F.desc("window_seq"), "node_id", "alertname").limit(50))
state_query("snk_5_alert_payload", _alr() + " select node_id, window_seq, '{\"source\":\"fabric\",\"severity\":\"' || severity || '\",\"kind\":\"' || alertname || '\",\"message\":\"' || alertname || '\",\"affected\":\"node ' || node_id || '\",\"timestamp_ns\":' || window_seq || '}' as body from al")(
    lambda spark, sf_dir: alerts(spark, sf_dir).select(*K, "severity", c("alertname").alias("kind"), c("alertname").alias("message"), F.concat(lit("node "), c("node_id").cast("string")).alias("affected"), c("window_seq").alias("timestamp_ns")).select(*K, alerting.payload(None).alias("body"))
)
# of a node's alert windows each next one is sent that lies at least 4 after the last one sent
_sent = """, a as (select node_id, window_seq, count(*) as alerts from al group by all),
nx as (select a.node_id, a.window_seq, min(b.window_seq) as nxt from a join a b on b.node_id = a.node_id and b.window_seq >= a.window_seq + 4 group by all),
d as (select node_id, min(window_seq) as window_seq from a group by node_id union all select nx.node_id, nxt from d join nx using (node_id, window_seq))"""
_place = "case alertname " + " ".join(f"when '{r[0]}' then {i}" for i, r in enumerate(alerting.RULES)) + " end"
_first = f", fi as (select node_id, window_seq, arg_min(alertname, {_place}) as alertname, arg_min(severity, {_place}) as severity from al group by all)"
state_query("fold_10_rate_limit", _alr() + _sent + _first + " select a.*, alertname, severity, (node_id, window_seq) in (select (node_id, window_seq) from d) as dispatched from a join fi using (node_id, window_seq)")(lambda spark, sf_dir: alerting.rate_limited(alerts(spark, sf_dir), 4))
state_query("act_1_dispatch_log", _alr() + _sent + _first + " select node_id, window_seq, alertname, severity, handler, true as dry_run, 'ok' as result from d join fi using (node_id, window_seq) cross join (values ('webhook'), ('log')) h(handler)")(lambda spark, sf_dir: alerting.dispatch_log(alerting.rate_limited(alerts(spark, sf_dir), 4), ["webhook", "log"]))
_last = """, r as (select *, row_number() over (partition by node_id order by window_seq desc, alertname) as rank from al),
g as (select node_id, string_agg('{"rank":' || rank || ',"window_seq":' || window_seq || ',"kind":"' || alertname || '","severity":"' || severity || '"}', ',' order by rank) as rows from r where rank <= 100 group by node_id),
n as (select node_id, max_by(state, window_seq) as state, max(window_seq) as w from hist group by node_id)"""
state_query("snk_3_status_json", _alr() + _last + """ select node_id, '{"now":{"state":"' || state || '","window_seq":' || w || '},"alerts":[' || coalesce(rows, '') || ']}' as body from n left join g using (node_id)""")(lambda spark, sf_dir: sinks.status_json(history(spark, sf_dir), alerts(spark, sf_dir).withColumnRenamed("alertname", "kind")))

def _carry(spark, sf_dir):
    rows = wins(spark, sf_dir).select(*K, X.composite_score(4).alias("fresh"), X.has_link_signal().alias("signal"))
    return scans.carried(rows).withColumn("raw", r6("raw"))


_cw = f""", raws as materialized (select node_id, window_seq, row_number() over (partition by node_id order by window_seq) as rn, {SCORE} as fresh, {SIGNAL} as signal from wi),
cf as (select node_id, rn, window_seq, fresh as raw from raws where rn = 1 union all
 select r.node_id, r.rn, r.window_seq, case when r.signal then r.fresh else greatest({D(0.9)} * s.raw, r.fresh) end from cf s join raws r on r.node_id = s.node_id and r.rn = s.rn + 1)
select node_id, window_seq, round(raw, 6) as raw from cf"""


query("fold_5_carry_forward", _cw, recursive=True)(_carry)


# samples
def _smp(name, capability, backend, sql, where="true"):
    @query(name, f"select node_id, window_seq, {sql} from wi where {where}")
    def run(spark, sf_dir):
        return samples.samples_of(wins(spark, sf_dir), capability, backend).select(*K, r6("value").alias("value"), r6("confidence").alias("confidence"))


_unsent = "greatest(xmit_pkts - rcv_pkts, 0)"
_busy = lambda a, b: f"cast(case when {TRAFFIC} then {a} else {b} end as double) as confidence"
_smp("smp_1_link_errors", "LinkErrors", "sysfs_port_counters", f"cast({HARD} + 5 * link_recovery + 50 * link_downed as double) as value, {_busy(1.0, 0.2)}")
_smp("smp_2_inferred_errors", "LinkErrors", "cq_error_inference", "cast(cq_stalls as double) as value, cast(case when cq_stalls > 0 then 0.3 else 0.05 end as double) as confidence")
_smp("smp_5_retransmit_port", "RetransmitSignal", "mad_retx_proxy", f"round(remote_physical_errors + {D(0.05)} * {_unsent}, 6) as value, {_busy(0.7, 0.2)}")
_smp("smp_6_retransmit_retry", "RetransmitSignal", "ethtool_retx", f"round(rxe_retry_exceeded + {D(0.5)} * rxe_seq_error + {D(0.3)} * rxe_duplicate_request, 6) as value, {_busy(0.8, 0.2)}")
_smp("smp_7_retransmit_ratio", "RetransmitSignal", "wr_ratio_inference", f"round({_unsent} / xmit_pkts, 6) as value, round(least(greatest({_unsent} / xmit_pkts * 4, 0), {D(0.4)}), 6) as confidence", "xmit_pkts >= 1 and rcv_pkts >= 1")
_smp("smp_8_pause", "PfcPause", "pfc_inference", f"cast(case when {HARD} < 1 then xmit_wait else 0 end as double) as value, cast(case when {HARD} < 1 then 0.3 else 0.05 end as double) as confidence", "xmit_wait >= 1")


@query("smp_3_throughput", f"select node_id, window_seq, 'pkts' as label, cast({PKTS} as double) as value from wi union all select node_id, window_seq, 'bytes', cast({BYTES} as double) from wi")
def _(spark, sf_dir):
    return samples.samples_of(wins(spark, sf_dir), "Throughput", "sysfs_port_counters").select(*K, "label", "value")


QS = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def cq_quantiles(spark, sf_dir):
    rows = events(spark, sf_dir).filter("kind = 'CqCompletion'")
    return sketches.quantiles(sketches.bucket_counts(rows, K, "latency_ns"), K, QS)


_gamma = repr((1 + sketches.ALPHA) / (1 - sketches.ALPHA))
_at = lambda q: f"floor({D(q)} * (total - 1) + {D(0.5)}) + 1"


def skt(source: str, keys: str) -> str:
    return f"""b as (select {keys}, case when latency_ns > 0 then cast(floor(ln(latency_ns) / ln({D(_gamma)})) as integer) + 1 else 0 end as bucket, sign(latency_ns) as sg, count(*) as n from {source} group by all),
w as (select {keys}, bucket, sg, sum(n) over (partition by {keys} order by sg, bucket) as upto, sum(n) over (partition by {keys}) as total from b),
q as (select {keys}, cast(max(total) as bigint) as n, {", ".join(f"round(sg_edge(min(case when upto >= {_at(q)} then sg * 100000 + bucket end)), 3) as {p}" for p, q in QS.items())} from w group by all)""".replace("sg_edge(", "edge_of(")


def _edges(sql: str) -> str:
    """Spell out the edge of a bucket: 0 for the zero bucket."""
    out = sql
    for p, q in QS.items():
        inner = f"min(case when upto >= {_at(q)} then sg * 100000 + bucket end)"
        out = out.replace(f"edge_of({inner})", f"case when {inner} >= 100000 then pow({D(_gamma)}, {inner} - 100000) else 0 end")
    return out


SK = _edges(skt("(select * from ev where kind = 'CqCompletion')", "node_id, window_seq"))


@query("skt_1_quantiles", ", " + SK + " select * from q", "ev")
def _(spark, sf_dir):
    return cq_quantiles(spark, sf_dir).select(*K, "n", *[F.round(p, 3).alias(p) for p in QS])


query("smp_4_completion_latency", ", " + SK + " " + " union all ".join(f"select node_id, window_seq, '{p}' as label, {p} as value, round(least(greatest(n / 200, {D(0.1)}), {D(0.95)}), 6) as confidence from q" for p in QS), "ev")(
    lambda spark, sf_dir: samples.completion_latency(wins(spark, sf_dir), cq_quantiles(spark, sf_dir)).select(*K, "label", F.round("value", 3).alias("value"), r6("confidence").alias("confidence"))
)
query("smp_11_cq_quantiles", ", " + SK + " " + " union all ".join(f"select node_id, window_seq, '{p}' as label, 'ebpf_cq_latency' as backend, 'High' as quality, {p} as value, round(case when n >= 100 then 1.0::double else greatest(n / 100, {D(0.05)}) end, 6) as confidence from q" for p in ("p50", "p99", "p999")), "ev")(
    lambda spark, sf_dir: samples.kernel_quantiles(cq_quantiles(spark, sf_dir)).select(*K, "label", "backend", "quality", F.round("value", 3).alias("value"), r6("confidence").alias("confidence"))
)


@query("top_2_quantile_labels", f"select node_id, window_seq, round(case when cq_completions > 0 then cq_latency_total / cq_completions end, 3) as avg, round({P99}, 3) as p99, cast(cq_latency_max as double) as max from wi where cq_completions > 0")
def _(spark, sf_dir):
    rows = samples.completion_latency(wins(spark, sf_dir))
    return rows.groupBy(*K).pivot("label", ["avg", "p99", "max"]).agg(F.round(F.first("value"), 3))


_heavy = "h as (select node_id, window_seq, qp, cast(sum(latency_ns) as bigint) as weight from ev where kind = 'CqCompletion' group by all), r as (select *, row_number() over (partition by node_id, window_seq order by weight desc, qp) as rank from h)"


def heavy(spark, sf_dir):
    return sketches.heavy_hitters(events(spark, sf_dir).filter("kind = 'CqCompletion'"), K, "qp", c("latency_ns"))


query("top_1_heavy_hitters", f", {_heavy} select node_id, window_seq, qp, weight, rank from r where rank <= 8", "ev")(lambda spark, sf_dir: heavy(spark, sf_dir).select(*K, "qp", "weight", c("rank").cast("long").alias("rank")))
query("smp_10_qp_attribution", f", {_heavy} select node_id, window_seq, cast(qp as varchar) as label, cast(weight as double) as value from r where rank <= 8", "ev")(lambda spark, sf_dir: samples.qp_attribution(heavy(spark, sf_dir)).select(*K, "label", "value"))
query("top_1_space_saving", f", {_heavy} select node_id, window_seq, qp, weight, cast(0 as bigint) as error, rank from r where rank <= 8", "ev")(  # a window may have more queue pairs than counters
    lambda spark, sf_dir: sketches.verified_hitters(events(spark, sf_dir).filter("kind = 'CqCompletion'"), K, "qp", c("latency_ns")).withColumn("rank", c("rank").cast("long"))
)
query("top_1_lineitem", "with h as (select l_suppkey % 64 as node_id, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as window_seq, l_partkey % 97 as qp, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as weight from lineitem group by all), r as (select *, row_number() over (partition by node_id, window_seq order by weight desc, qp) as rank from h) select node_id, window_seq, qp, weight from r where rank <= 3", "")(
    lambda spark, sf_dir: sketches.heavy_hitters(completions(spark, sf_dir), K, "qp", c("latency_ns"), 3).select(*K, "qp", "weight")
)


def probes(spark, sf_dir):
    return events(spark, sf_dir).filter("kind = 'NapiPoll'").select(*K, c("qp").cast("string").alias("peer"), (c("k") * 20.0).alias("rtt_us"), F.when(c("is_error"), "timeout").alias("error"))


@query("smp_9_peer_liveness", "select node_id, window_seq, cast(qp as varchar) as label, cast(case when is_error then 5000.0 else k * 20.0 end as double) as value, cast(case when is_error then 0.3 else 0.9 end as double) as confidence from ev where kind = 'NapiPoll'", "ev")
def _(spark, sf_dir):
    return samples.peer_liveness(probes(spark, sf_dir), 5000.0).select(*K, "label", "value", "confidence")


def _norm():
    return f"""case capability when 'LinkErrors' then least(value / 50, 1) when 'RetransmitSignal' then case when value <= 1 then value else least(value / 100, 1) end
  when 'PfcPause' then least(value / 100, 1) else 0 end"""


SMP = f"""s as (select node_id, window_seq, 'LinkErrors' as capability, cast({HARD} + 5 * link_recovery + 50 * link_downed as double) as value, cast(case when {TRAFFIC} then 1.0 else 0.2 end as double) as confidence, cast(1.0 as double) as q from wi
 union all select node_id, window_seq, 'RetransmitSignal', rxe_retry_exceeded + {D(0.5)} * rxe_seq_error + {D(0.3)} * rxe_duplicate_request, cast(case when {TRAFFIC} then 0.8 else 0.2 end as double), cast(0.7 as double) from wi
 union all select node_id, window_seq, 'PfcPause', cast(case when {HARD} < 1 then xmit_wait else 0 end as double), cast(case when {HARD} < 1 then 0.3 else 0.05 end as double), cast(0.4 as double) from wi where xmit_wait >= 1)"""
_three = (("LinkErrors", "sysfs_port_counters"), ("RetransmitSignal", "ethtool_retx"), ("PfcPause", "pfc_inference"))


@query("scr_2_fusion", f", {SMP}, x as (select *, case when value > 0 then {_norm()} else 0 end * case capability when 'LinkErrors' then {D(1.0)} when 'RetransmitSignal' then {D(0.8)} else {D(0.5)} end * q * confidence as part from s) select node_id, window_seq, round(tanh(sum(part) / 2) * {D(0.5)}, 6) as fusion from x group by all")
def _(spark, sf_dir):
    return wins(spark, sf_dir).select(*K, r6(samples.fusion_column(_three)).alias("fusion"))


@query("sca_14_normalise", f", {SMP} select node_id, window_seq, capability, round(case when value > 0 then {_norm()} else 0 end, 6) as x from s")
def _(spark, sf_dir):
    return samples.all_samples(wins(spark, sf_dir), _three).select(*K, "capability", r6(X.normalised(c("capability"), c("value"))).alias("x"))


for _alias in ("set_1_union_samples", "cov_5_active_samples"):
    query(_alias, f", {SMP} select capability, count(*) as n, round(sum(value), 3) as total from s group by all")(lambda spark, sf_dir: samples.all_samples(wins(spark, sf_dir), _three).groupBy("capability").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")))
query("flt_6_actionable", f", {SMP} select count(*) as n from s where confidence > 0 and value > 1")(lambda spark, sf_dir: samples.all_samples(wins(spark, sf_dir), _three).filter(X.is_actionable(c("quality"), c("confidence")) & (c("value") > 1)).agg(F.count("*").alias("n")))

def inventory(spark, sf_dir):
    """Suppliers as an inventory of nodes with a fabric and counter lists."""
    fabric = F.when(c("region") % 3 == 0, "InfiniBand").when(c("region") % 3 == 1, "SoftRoCE").otherwise("RoCEv2")
    standard = F.when(c("node_id") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(lit("symbol_error"), lit("port_rcv_remote_physical_errors")))
    hw = F.when(c("node_id") % 2 == 0, F.array(lit("retry_exceeded_err"))).otherwise(F.array().cast("array<string>"))
    return nodes(spark, sf_dir).select("node_id", fabric.alias("fabric"), standard.alias("counters"), hw.alias("hw_counters"), (c("node_id") % 5 == 0).alias("probes"))


_avail = {
    ("LinkErrors", "sysfs_port_counters"): "n % 4 <> 3", ("LinkErrors", "cq_error_inference"): "true", ("Throughput", "sysfs_port_counters"): "n % 4 <> 3 or n % 2 = 0",
    ("CompletionLatency", "throughput_proxy_latency"): "true", ("RetransmitSignal", "mad_retx_proxy"): "r % 3 = 0 and n % 4 <> 3", ("RetransmitSignal", "ethtool_retx"): "n % 2 = 0",
    ("RetransmitSignal", "wr_ratio_inference"): "true", ("PfcPause", "pfc_inference"): "r % 3 = 2", ("PeerLiveness", "active_prober"): "n % 5 = 0",
}
INV = "with inv as (select cast(s_suppkey as bigint) as n, cast(s_nationkey as bigint) as r from supplier), pr as (" + " union all ".join(f"select n as node_id, '{cap}' as capability, '{b}' as backend, '{q}' as quality, {samples.QUALITY_CODE[q]} as code, {i} as place, {_avail.get((cap, b), 'false')} as available from inv" for i, (cap, b, q, _) in enumerate(samples.BACKENDS)) + "), wn as (select * from (select *, row_number() over (partition by node_id, capability order by code desc, place desc) as rk from pr where available) where rk = 1)"
CAPS = "caps as (select unnest([" + ", ".join(f"'{x}'" for x in CAPABILITY_WEIGHTS) + "]) as capability), cv as (select i.n as node_id, caps.capability, coalesce(wn.backend, 'none') as backend, coalesce(wn.quality, 'Absent') as quality, coalesce(wn.code, 0) as code, coalesce((select string_agg(backend, '>' order by code desc, place desc) from pr where pr.node_id = i.n and pr.capability = caps.capability and available), '') as chain from inv i cross join caps left join wn on wn.node_id = i.n and wn.capability = caps.capability)"


def covered(spark, sf_dir):
    return samples.coverage(samples.probe(inventory(spark, sf_dir)))


_why = "case when available then 'ok' else case backend " + " ".join(f"when '{b}' then '{r}'" for b, r in samples.REASONS.items()) + " else 'no collector attached' end end"
query("cov_1_probe", INV + f" select node_id, capability, backend, available, {_why} as reason from pr", "")(lambda spark, sf_dir: samples.probe(inventory(spark, sf_dir)).select("node_id", "capability", "backend", "available", "reason"))
query("cov_2_best_backend", INV + " select node_id, capability, backend, quality from wn", "")(lambda spark, sf_dir: samples.winners(samples.probe(inventory(spark, sf_dir))).select("node_id", "capability", "backend", "quality"))
query("cov_3_coverage", INV + ", " + CAPS + " select node_id, capability, backend, quality, chain from cv", "")(covered)
query("cov_4_grade", INV + ", " + CAPS + " select node_id, case when min(code) = 3 then 'A' when min(code) >= 2 then 'B' when max(code) > 0 then 'C' else 'F' end as grade from cv where capability in ('LinkErrors', 'Throughput', 'CompletionLatency', 'RetransmitSignal') group by all", "")(lambda spark, sf_dir: samples.grade(covered(spark, sf_dir)))
query("cov_6_quality_gauge", INV + ", " + CAPS + " select node_id, capability, backend, code from cv", "")(lambda spark, sf_dir: covered(spark, sf_dir).select("node_id", "capability", "backend", samples.quality_code(c("quality")).alias("code")))
query("prj_3_codes", INV + ", " + CAPS + " select quality, code, count(*) as n from cv group by all", "")(lambda spark, sf_dir: covered(spark, sf_dir).groupBy("quality", samples.quality_code(c("quality")).alias("code")).agg(F.count("*").alias("n")))
_cells = """'{"capability":"' || capability || '","backend":"' || backend || '","quality":"' || quality || '"}'"""
query("snk_4_coverage_json", INV + ", " + CAPS + f" select node_id, '[' || string_agg({_cells}, ',' order by capability, backend, quality) || ']' as body from cv group by node_id", "")(lambda spark, sf_dir: sinks.coverage_json(covered(spark, sf_dir)))
query("srt_1_sorted_capabilities", INV + ", " + CAPS + " select node_id, capability, row_number() over (partition by node_id order by capability) as place from cv", "")(lambda spark, sf_dir: covered(spark, sf_dir).select("node_id", "capability", F.row_number().over(W.partitionBy("node_id").orderBy("capability")).cast("long").alias("place")))
query("flt_10_counter_probe", "select cast(s_suppkey as bigint) as node_id from supplier where s_suppkey % 2 = 0", "")(lambda spark, sf_dir: inventory(spark, sf_dir).filter(F.exists("hw_counters", lambda x: F.contains(x, lit("retry")))).select("node_id"))
query("flt_7_device_filter", "select cast(s_suppkey as bigint) as node_id from supplier where s_nationkey % 3 = 1", "")(lambda spark, sf_dir: inventory(spark, sf_dir).filter("fabric = 'SoftRoCE'").select("node_id"))

RULE_CAPS = {r: list(rules.CONSULTS.get(r, ())) for r in rules.ORDER}


WEIGHTS = INV + ", " + CAPS + ", rc as (select * from (values " + ", ".join(f"('{r}', {repr(x) if x else 'null'})" for r, xs in RULE_CAPS.items() for x in (xs or [None])) + ") v(rule, capability)), wt as (select n as node_id, rule, max(cast(case when rc.capability is null then 1.0 when quality = 'High' then 1.0 when quality = 'Medium' then 0.7 when quality = 'Low' then 0.4 else 0.0 end as double)) as weight from inv cross join rc left join cv on cv.node_id = n and cv.capability = rc.capability group by all)"


@query("join_2_rule_weights", WEIGHTS + " select * from wt", "")
def coverage_weights(spark, sf_dir):
    return samples.rule_weights(covered(spark, sf_dir), rules.capabilities())


def rule_weights(spark, sf_dir):
    """The same weights by node from the inventory alone."""
    return samples.inventory_weights(inventory(spark, sf_dir), rules.capabilities())


@query("join_6_fabric_overlay", "select cast(s_suppkey as bigint) as node_id, case when s_nationkey % 3 = 0 then 0.25 else 0.30 end::double as degrade_enter, case when s_nationkey % 3 = 1 then 3 else 2 end as enter_windows from supplier", "")
def _(spark, sf_dir):
    profiles = spark.createDataFrame([("InfiniBand", 0.25, None), ("SoftRoCE", None, 3)], "fabric string, degrade_enter double, enter_windows int")
    return joins.overlay(inventory(spark, sf_dir).select("node_id", "fabric"), profiles, {"degrade_enter": 0.30, "enter_windows": 2}).drop("fabric")


# joins
def _submits(spark, sf_dir):
    ev = events(spark, sf_dir)
    return ev.filter("kind = 'IrqEntry'").select("node_id", "cpu", c("ts_us").alias("submit_us"), c("event_id").alias("submit_id")), ev.filter("kind = 'CqCompletion'").select("node_id", "cpu", "ts_us", "event_id")


_asof = ", s as (select node_id, cpu, ts_us, max(event_id) as submit_id from ev where kind = 'IrqEntry' group by all), l as (select * from ev where kind = 'CqCompletion') select l.event_id, s.submit_id, s.ts_us as submit_us from l {kind} join s on l.node_id = s.node_id and l.cpu = s.cpu and l.ts_us >= s.ts_us"


@query("join_3_submit_completion", _asof.format(kind="asof"), "ev")
def _(spark, sf_dir):
    left, right = _submits(spark, sf_dir)[1], _submits(spark, sf_dir)[0].groupBy("node_id", "cpu", "submit_us").agg(F.max("submit_id").alias("submit_id"))
    return joins.as_of(left, right, ["node_id", "cpu"], "ts_us", "submit_us", ["submit_id"]).filter("submit_id is not null").select("event_id", "submit_id", c("matched_at").alias("submit_us"))


@query("join_4_entry_return", ", o as (select *, lag(kind) over w as pk, lag(ts_us) over w as pt from ev where kind in ('IrqEntry', 'CqCompletion') window w as (partition by node_id, cpu order by ts_us, event_id)) select event_id, ts_us - pt as took from o where kind = 'CqCompletion' and pk = 'IrqEntry'", "ev")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).filter(c("kind").isin("IrqEntry", "CqCompletion"))
    return joins.pair_calls(rows, ["node_id", "cpu"], ["ts_us", "event_id"], c("kind") == "CqCompletion", "ts_us").select("event_id", "took")


@query("join_7_latest_probe", ", p as (select node_id, window_seq, max(k) as best from ev where kind = 'NapiPoll' group by all), w as (select node_id, window_seq from ev group by all) select w.node_id, w.window_seq, case when w.window_seq - p.window_seq <= 2 then p.best end as best from w asof left join p on w.node_id = p.node_id and w.window_seq >= p.window_seq", "ev")
def _(spark, sf_dir):
    ev = events(spark, sf_dir)
    p = ev.filter("kind = 'NapiPoll'").groupBy("node_id", c("window_seq").alias("at")).agg(F.max("k").alias("best"))
    return joins.as_of(ev.select(*K).distinct(), p, ["node_id"], "window_seq", "at", ["best"], max_age=2).select(*K, "best")


@query("flt_9_staleness", "select event_id from ev where (select max(ts_us) from ev) - ts_us <= 3 * 86400000000", "ev")
def _(spark, sf_dir):
    ev = events(spark, sf_dir).select("event_id", c("ts_us").alias("timestamp_unix"), lit(86_400_000_000).cast("long").alias("interval_secs"))
    now = ev.agg(F.max("timestamp_unix").alias("now"))
    return landed.fresh(ev, now.scalar()).select("event_id")


def _procs(spark, sf_dir):
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return cust.select((c("c_custkey") % 8).alias("node_id"), c("c_custkey").alias("pid"), c("c_mktsegment").alias("comm"), (c("c_custkey") % 5).cast("string").alias("job_id"), lit(None).cast("string").alias("pod"))


@query("join_5_blast_radius", ", o as (select distinct node_id, qp as pid from ev), p as (select c_custkey % 8 as node_id, c_custkey as pid, c_mktsegment as comm, cast(c_custkey % 5 as varchar) as job from customer) select node_id, count(*) as processes, 'jobs ' || string_agg(distinct job, ',' order by job) || '; processes ' || string_agg(distinct comm, ',' order by comm) as summary from o join p using (node_id, pid) group by all", "ev")
def _(spark, sf_dir):
    owners = events(spark, sf_dir).select("node_id", c("qp").alias("pid"))
    return joins.blast_radius(owners, _procs(spark, sf_dir)).select("node_id", "processes", "summary")


also("sca_24_blast_summary", "join_5_blast_radius")


_level = f"case when raw >= {D(0.55)} then 'CRITICAL' when raw >= {D(0.30)} then 'DEGRADED' else 'HEALTHY' end"


@state_query("join_12_expected_vs_actual", f"select node_id, window_seq, {_level} as expected, state, {_level} = state as agrees from hist where window_seq % 10 = 9")
def _(spark, sf_dir):
    """What a window's own score would call the node, beside the state that smoothing and dwell times give it."""
    level = F.when(c("raw") >= 0.55, "CRITICAL").when(c("raw") >= 0.30, "DEGRADED").otherwise("HEALTHY")
    want = scored(spark, sf_dir).filter("window_seq % 10 = 9").select(*K, level.alias("expected"))
    return want.join(history(spark, sf_dir).select(*K, "state"), K).select(*K, "expected", "state", (c("expected") == c("state")).alias("agrees"))


_saved = ", ch as (select *, lag(state) over (partition by node_id order by window_seq) as before from hist), lc as (select node_id, max(window_seq) as since from ch where before is null or before <> state group by all)"


@state_query("snk_6_versions", _saved + " select node_id, state, since from ch join lc on lc.node_id = ch.node_id and lc.since = ch.window_seq".replace("select node_id", "select ch.node_id"))
def _(spark, sf_dir):
    """The states as they are kept: written on change only, in versions, day after day."""
    h = store.settle(history(spark, sf_dir).select(*K, "state"), "history")
    kept = store.KeyedState(spark, store.shared_dir(spark, "decisions"), "node_id long, state string, since long")
    changes = h.withColumn("_c", sinks.changed(h, ["state"], "window_seq")).filter("_c").select("node_id", "state", c("window_seq").alias("since"))
    low, high = h.agg(F.coalesce(F.min("window_seq"), lit(0)), F.coalesce(F.max("window_seq"), lit(0))).first()
    for part in range(3):
        a, b = (low + (high + 1 - low) * k // 3 for k in (part, part + 1))
        kept.save(store.updated(kept.load(), changes.filter((c("since") >= a) & (c("since") < b)), "node_id", "since"))
    return kept.load()


_radius = ", o as (select distinct node_id, qp as pid from ev), p as (select c_custkey % 8 as node_id, c_custkey as pid, c_mktsegment as comm, cast(c_custkey % 5 as varchar) as job from customer), br as (select node_id, 'jobs ' || string_agg(distinct job, ',' order by job) || '; processes ' || string_agg(distinct comm, ',' order by comm) as summary from o join p using (node_id, pid) group by all)"


@state_query("act_3_enriched_alerts", _alr() + _radius + " select al.node_id, window_seq, alertname, alertname || coalesce(' | Affected: ' || summary, '') as message from al left join br using (node_id)")
def _(spark, sf_dir):
    owners = events(spark, sf_dir).select("node_id", c("qp").alias("pid"))
    radius = joins.blast_radius(owners, _procs(spark, sf_dir)).select("node_id", "summary")
    return alerts(spark, sf_dir).join(radius, "node_id", "left").select(*K, "alertname", F.concat(c("alertname"), F.coalesce(F.concat(lit(" | Affected: "), c("summary")), lit(""))).alias("message"))


# scheduling
_policy = ", dl as (select node_id, window_seq, state, case when state = 'CRITICAL' then 'Draining' when state = 'HEALTHY' then 'Available' end as want from hist), ds as (select node_id, window_seq, state, coalesce(last_value(want ignore nulls) over (partition by node_id order by window_seq), 'Available') as desired from dl)"


@state_query("sch_1_desired_state", _policy + " select node_id, window_seq, state, desired from ds")
def _(spark, sf_dir):
    return scheduling.desired_states(history(spark, sf_dir)).select(*K, "state", "desired")


_hold = ", hc as (select node_id, window_seq, state, row_number() over (partition by node_id order by window_seq) as rn, case window_seq % 30 when 10 then 'hold' when 20 then 'release' end as cmd from hist), pc as (select distinct node_id, cast(0 as bigint) as rn, cast(null as bigint) as window_seq, cast(null as varchar) as state, 'Available' as desired from hc union all select h.node_id, h.rn, h.window_seq, h.state, case when h.state <> 'HEALTHY' then 'Draining' when h.cmd = 'hold' or (p.desired = 'HeldByOperator' and coalesce(h.cmd, '') <> 'release') then 'HeldByOperator' else 'Available' end from pc p join hc h on h.node_id = p.node_id and h.rn = p.rn + 1)"


@state_query("sch_7_hold_commands", _hold + " select node_id, window_seq, state, desired, desired = 'HeldByOperator' as held from pc where rn > 0")
def _(spark, sf_dir):
    h = history(spark, sf_dir)
    commands = h.filter("window_seq % 30 = 10 or window_seq % 30 = 20").select(*K, F.when(c("window_seq") % 30 == 10, "hold").otherwise("release").alias("command"))
    return scheduling.desired_states(h, True, commands)


also("fold_8_policy", "sch_7_hold_commands")


_parts = ["IDLE", "ALLOCATED+DRAIN", "DRAINED*", "DOWN*", "MIXED", "IDLE+DRAIN", "PLANNED"]
_obs = ["Available", "Draining", "Drained", "Down", "Available", "Drained", "Unknown"]
_pick = lambda xs: F.get(F.array(*[lit(x) for x in xs]), (c("k") % 7).cast("int"))
_sqlpick = lambda xs: "case k % 7 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(xs)) + " end"


def reports(spark, sf_dir):
    line = F.concat(lit("NodeName=n"), c("node_id").cast("string"), lit(" State="), _pick(_parts), lit(" Reason="), F.when(c("cpu") == 0, lit("fabrichealth:critical")).when(c("cpu") == 1, lit("(null)")).otherwise(lit("maintenance by ops")))
    ev = events(spark, sf_dir)
    parsed = scheduling.node_reports(ev.select("event_id", "node_id", "ts_us", "k", line.alias("line")).select("*"))
    return parsed, ev.select("event_id", "node_id", "ts_us", "is_error", line.alias("line"))


@query("src_14_node_line", f"select 'n' || node_id as node, {_sqlpick(_obs)} as observed, case when cpu = 0 then 'fabrichealth:critical' when cpu = 1 then null else 'maintenance' end as reason, cpu = 0 as managed_by_self, {_sqlpick(_parts)} not like '%*%' as responsive from ev", "ev")
def _(spark, sf_dir):
    return reports(spark, sf_dir)[0]


for _alias in ("sca_17_compound_state", "sca_18_field_extract", "sca_19_ownership"):
    also(_alias, "src_14_node_line")


def observations(spark, sf_dir):
    """Node reports beside the desired state of their window."""
    raw = F.coalesce(scheduling.field(c("line"), "State"), lit(""))
    reason = scheduling.field(c("line"), "Reason")
    base = events(spark, sf_dir)
    line = F.concat(lit("NodeName=n State="), _pick(_parts), lit(" Reason="), F.when(c("cpu") == 0, lit("fabrichealth:critical")).otherwise(lit("ops")))
    rows = base.select(*K, "event_id", F.floor(c("ts_us") / 1_000_000).cast("long").alias("at"), line.alias("line")).select("*", scheduling.observed_state(raw).alias("observed"), F.startswith(reason, lit(scheduling.PREFIX)).alias("managed_by_self"), (~F.contains(raw, lit("*"))).alias("responsive"))
    want = scheduling.desired_states(history(spark, sf_dir)).select(*K, "state", "desired")
    command = F.when(c("event_id") % 211 == 5, "hold").when(c("event_id") % 211 == 100, "release")
    return rows.join(want, K).withColumns({"error": c("window_seq") % 20 == 7, "command": command}).drop("line")


def reconciled(spark, sf_dir):
    return scheduling.reconcile(observations(spark, sf_dir).drop("desired"), order=("at", "event_id"))


_obsql = _policy + f", ob as (select ev.node_id, ev.window_seq, event_id, {_sqlpick(_obs)} as observed, cpu = 0 as managed, {_sqlpick(_parts)} not like '%*%' as responsive, desired from ev join ds using (node_id, window_seq))"
_act = """case when desired = 'Available' and observed in ('Draining', 'Drained', 'Down') and not managed then 'hold' when observed = 'Unknown' then 'skip_unknown'
 when observed = 'Down' and not responsive then 'skip_down' when desired = 'Available' and observed = 'Available' then 'none'
 when desired = 'Draining' and observed in ('Draining', 'Drained') then 'none' when desired = 'Available' then 'resume' else 'drain' end"""

for _alias in ("sch_3_converge", "join_13_desired_vs_observed"):
    state_query(_alias, _obsql + f" select event_id, node_id, desired, observed, {_act} as action from ob")(lambda spark, sf_dir: observations(spark, sf_dir).select("event_id", "node_id", "desired", "observed", scheduling.action().alias("action")))
state_query("sch_2_operator_hold", _obsql + " select event_id, node_id from ob where observed in ('Draining', 'Drained', 'Down') and not managed and desired = 'Available'")(lambda spark, sf_dir: observations(spark, sf_dir).filter(scheduling.operator_hold()).select("event_id", "node_id"))
_held_ = scheduling.HELD
_ticks = f""", tk as materialized (select ob.node_id, event_id, ev.ts_us // 1000000 as "at", state, observed, managed, responsive, ob.window_seq % 20 = 7 as error, case event_id % 211 when 5 then 'hold' when 100 then 'release' end as cmd,
  row_number() over (partition by ob.node_id order by ev.ts_us // 1000000, event_id) as rn from ob join hist using (node_id, window_seq) join (select event_id, ts_us from ev) ev using (event_id)),
rr as (select node_id, cast(0 as bigint) as rn, cast(null as bigint) as "at", cast(null as varchar) as state, cast(null as varchar) as observed, cast(null as varchar) as cmd, 'Available' as des, 'Available' as pol, cast(null as bigint) as con, cast(null as bigint) as drained, 'Unknown' as seen, 0 as fails, cast(null as bigint) as probed, cast(null as varchar) as decision from (select distinct node_id from tk) union all
  select node_id, rn, "at", state, observed, cmd,
    case when d in ('hold') then '{_held_}' when d in ('backoff', 'read_failed', 'contested_resume', 'contested') then des0 else pol1 end,
    case when d = 'backoff' then pol0 when d = 'hold' then '{_held_}' else pol1 end,
    case when d in ('backoff', 'read_failed', 'hold', 'contested') then con0 when d = 'contested_resume' then "at" + 300 end,
    case when d = 'drain' then "at" when d = 'resume' then null else drained end,
    case when d in ('backoff', 'read_failed', 'hold', 'contested') then seen else observed end,
    case when d = 'backoff' then fails when d = 'read_failed' then fails + 1 else 0 end, probed1, d
  from (select *, case when skip then 'backoff' when error then 'read_failed' when pol1 = 'Available' and observed in ('Draining', 'Drained', 'Down') and not managed then 'hold'
      when des0 = 'Draining' and observed = 'Available' and seen in ('Draining', 'Drained') then 'contested_resume' when con0 is not null and "at" < con0 then 'contested'
      when observed = 'Unknown' then 'skip_unknown' when observed = 'Down' and not responsive then 'skip_down' when pol1 = '{_held_}' or observed = pol1 or (pol1 = 'Draining' and observed = 'Drained') then 'none'
      when pol1 = 'Draining' then 'drain' when drained is not null and "at" - drained < 60 then 'cooldown' else 'resume' end as d
    from (select *, case when state = 'CRITICAL' then 'Draining' when state = 'HEALTHY' and pol0 <> '{_held_}' then 'Available' else pol0 end as pol1
      from (select t.*, p.drained, p.seen, p.fails, case t.cmd when 'hold' then '{_held_}' when 'release' then case when p.pol = '{_held_}' then 'Available' else p.pol end else p.pol end as pol0,
          case t.cmd when 'hold' then '{_held_}' when 'release' then 'Available' else p.des end as des0, case when t.cmd = 'release' then null else p.con end as con0,
          p.fails >= 5 and (p.probed is null or t."at" - p.probed < 300) as skip, case when p.fails >= 5 and (p.probed is null or t."at" - p.probed >= 300) then t."at" else p.probed end as probed1
        from rr p join tk t on t.node_id = p.node_id and t.rn = p.rn + 1)))),
dc as (select node_id, "at", state, observed, cmd as command, des as desired, decision from rr where rn > 0)"""
_log = "case decision " + " ".join(f"when '{d}' then '{k}'" for d, k in scheduling.LOG_KINDS.items()) + " end"
for _name, _tail, _run in (
    ("fold_9_reconciler", "select * from dc", lambda df: df),
    ("sch_4_contested", "select * from dc where decision in ('contested_resume', 'contested')", lambda df: df.filter(c("decision").isin("contested_resume", "contested"))),
    ("sch_6_backoff", "select * from dc where decision in ('read_failed', 'backoff')", lambda df: df.filter(c("decision").isin("read_failed", "backoff"))),
    ("sch_8_action_log", f"select kind, 'dry_run' as mode, count(*) as n from (select unnest([case command when 'hold' then 'hold_set' when 'release' then 'hold_released' end, {_log}]) as kind from dc) where kind is not null group by all", lambda df: scheduling.action_log(df).groupBy("kind", "mode").agg(F.count("*").alias("n"))),
):
    state_query(_name, _obsql + _ticks + " " + _tail)(lambda spark, sf_dir, run=_run: run(reconciled(spark, sf_dir)))

#: The events lie minutes apart, so a node is due once an hour here.
DUE = 3600
_due = f""", e as materialized (select node_id, ts_us // 1000000 as "at", event_id, row_number() over (partition by node_id order by ts_us // 1000000, event_id) as rn from ev),
nx as materialized (select a.node_id, a.rn, b.rn as nxt from e a asof join (select *, "at" - {DUE} as due_at, -("at" - {DUE}) as neg from e qualify row_number() over (partition by node_id, "at" order by rn) = 1) b on a.node_id = b.node_id and a."at" <= b.due_at),
d as (select node_id, cast(1 as bigint) as rn from (select distinct node_id from e) union all select d.node_id, nx.nxt from d join nx on nx.node_id = d.node_id and nx.rn = d.rn)
select e.node_id, "at", event_id, d.rn is not null as due from e left join d on d.node_id = e.node_id and d.rn = e.rn"""


@query("sch_5_reconcile_interval", _due, "ev", recursive=True)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("node_id", F.floor(c("ts_us") / 1_000_000).cast("long").alias("at"), "event_id")
    return scheduling.due_ticks(rows, DUE, order=("at", "event_id"))


# metrics
GAUGES = {"irq_total": lambda: c("irq_total"), "napi_pct": X.napi_utilisation, "slab_max": lambda: c("slab_latency_max")}


@query("snk_1_metrics", "select node_id, window_seq, 'irq_total' as name, cast(irq_total as double) as value from wi union all select node_id, window_seq, 'napi_pct', round(case when napi_budget > 0 then napi_work / napi_budget * 100 else 0 end, 6) from wi union all select node_id, window_seq, 'slab_max', cast(slab_latency_max as double) from wi")
def _(spark, sf_dir):
    return fleet.metrics_long(wins(spark, sf_dir), {k: v() for k, v in GAUGES.items()}).withColumn("value", r6("value"))


@query("src_11_peer_probes", "select event_id, cast(qp as varchar) as peer, cast(k * 20.0 as double) as rtt_us from ev where kind = 'NapiPoll'", "ev")
def _(spark, sf_dir):
    body = F.to_json(F.struct(c("event_id"), F.array(F.struct(c("qp").cast("string").alias("peer"), (c("k") * 20.0).alias("rtt_us"))).alias("results")))
    parsed = F.from_json("body", "event_id long, results array<struct<peer: string, rtt_us: double, error: string>>")
    return events(spark, sf_dir).filter("kind = 'NapiPoll'").select(body.alias("body")).select(parsed.alias("p")).select("p.event_id", F.inline("p.results")).drop("error")


@query("src_12_targets", "select s_name || ':9100' as target, cast(s_nationkey as varchar) as region from supplier", "")
def _(spark, sf_dir):
    body = F.to_json(F.array(F.struct(F.array(F.concat(c("name"), lit(":9100"))).alias("targets"), F.create_map(lit("region"), c("region").cast("string")).alias("labels"))))
    rows = nodes(spark, sf_dir).select(F.from_json(body, "array<struct<targets: array<string>, labels: map<string,string>>>").alias("x")).select(F.inline("x"))
    return rows.select(F.explode("targets").alias("target"), c("labels")["region"].alias("region"))
