"""Queries of the verdict fold and its parts, each with the verdict's recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fabrichealth.config import SCALED
from fabrichealth.functions import exprs as X
from fabrichealth.operators import alerting, folds, rules, samples
from fabrichealth.plans.base import query, r6, wins
from fabrichealth.plans.state_queries import WEIGHTS, inventory, rule_weights
from fabrichealth.plans.verdict_sql import rollings, verdict_views
from fabrichealth.plans.window_queries import K

c, lit = F.col, F.lit
_weights = ", " + WEIGHTS.removeprefix("with ")
VERDICT = _weights + verdict_views(weights="wt")


def verdicts(spark, sf_dir):
    """The verdicts with fusion, and with the weights that each node's coverage gives the rules."""
    return folds.verdicts(rules.fold_input(wins(spark, sf_dir), SCALED), SCALED, rule_weights(spark, sf_dir))


def rounded(rows):
    return rows.withColumns({x: r6(x) for x in ("raw", "ewma", "peak", "effective")})


def verdict_query(name: str, tail: str):
    return query(name, VERDICT + " " + tail, recursive=True)


verdict_query("scr_4_verdict", "select * from vd")(lambda spark, sf_dir: rounded(verdicts(spark, sf_dir)))
verdict_query("rule_3_link_degradation", "select node_id, window_seq, link_cause, link_state from vd where link_cause is not null")(lambda spark, sf_dir: verdicts(spark, sf_dir).filter("link_cause is not null").select(*K, "link_cause", "link_state"))
for _id, _rule in (("rule_6", "latency_drift"), ("rule_7", "throughput_drop"), ("rule_9", "cq_jitter_stall"), ("rule_10", "congestion_spread")):
    verdict_query(f"{_id}_{_rule}", f"select node_id, window_seq, regexp_extract(alerts, '{_rule}:(\\w+)', 1) as severity from vd where contains(alerts, '{_rule}:')")(
        lambda spark, sf_dir, r=_rule: verdicts(spark, sf_dir).select(*K, F.nullif(F.regexp_extract("alerts", rf"{r}:(\w+)", 1), lit("")).alias("severity")).filter("severity is not null")
    )
verdict_query("rule_12_worst_severity", "select node_id, window_seq, severity, worst_rule from vd")(lambda spark, sf_dir: verdicts(spark, sf_dir).select(*K, "severity", "worst_rule"))
verdict_query("fold_4_link_rule", "select node_id, window_seq, link_cause, link_state from vd")(lambda spark, sf_dir: verdicts(spark, sf_dir).select(*K, "link_cause", "link_state"))
verdict_query("fold_6_timescales", "select node_id, window_seq, fast_state, medium_state, slow_state, composite_state from vd")(lambda spark, sf_dir: verdicts(spark, sf_dir).select(*K, "fast_state", "medium_state", "slow_state", "composite_state"))
verdict_query("fold_7_burst_class", "select node_id, window_seq, burst from vd")(lambda spark, sf_dir: verdicts(spark, sf_dir).select(*K, "burst"))


@query("fold_1_rolling_stats", ", cs as materialized (select node_id as nid, window_seq, row_number() over (partition by node_id order by window_seq) as rn, cq_latency_total / cq_completions as value from wi where cq_completions > 0), " + rollings("rs", "cs", {"v": ("value", 0.1, 5.0, None)}) + " select nid as node_id, rs.window_seq, round(value, 6) as value, round(v_z, 6) as z, round(v_mean, 6) as mean, round(sqrt(v_var), 6) as sd, v_n >= 5 as warm from rs join cs using (nid, rn)", recursive=True)
def _(spark, sf_dir):
    rows = wins(spark, sf_dir).filter("cq_completions > 0").select(*K, X.average("cq_latency_total", "cq_completions").alias("value"))

    def step(s, r):
        z = s.z(r["value"])
        s.push(r["value"])
        return {"z": z, "mean": s.mean, "sd": s.var**0.5, "warm": s.warm}

    out = folds.fold_column(rows, lambda: folds.Rolling(0.1, 5.0), step, "node_id long, window_seq long, value double, z double, mean double, sd double, warm boolean")
    return out.withColumns({x: r6(x) for x in ("value", "z", "mean", "sd")})


#: A node starts anew every 40 windows.
RESET = 40


@query("fold_11_reset", verdict_views(node=f"node_id * 100000 + window_seq // {RESET}") + " select node_id, window_seq, effective, state from vd", recursive=True)
def _(spark, sf_dir):
    marked = rules.fold_input(wins(spark, sf_dir), SCALED).withColumn("reset", c("window_seq") % RESET == 0)
    return folds.verdicts(marked, SCALED).select(*K, r6("effective").alias("effective"), "state")


@verdict_query("act_2_port_disable", ", ip as (select n as node_id, unnest(generate_series(1, 1 + n % 2)) as port from inv), sp1 as (select node_id, min(port) as port from ip group by node_id having count(distinct port) = 1) select vd.node_id, window_seq, cast(port as bigint) as port from vd join sp1 using (node_id) where severity = 'CRITICAL' and link_cause = 'link_down'")
def _(spark, sf_dir):
    """Nodes of the inventory have one port or two."""
    ports = inventory(spark, sf_dir).select("node_id", F.explode(F.sequence(lit(1).cast("long"), 1 + c("node_id") % 2)).alias("port"))
    return alerting.port_disable_candidates(verdicts(spark, sf_dir), ports)


@verdict_query("scr_3_severity_floor", "select node_id, window_seq, worst_rule, round(floor, 6) as floor from xf")
def _(spark, sf_dir):
    """The floor of each window's worst severity, scaled by the node's coverage of the rule that raised it."""
    worst = verdicts(spark, sf_dir).select(*K, "severity", "worst_rule")
    weighted = worst.join(rule_weights(spark, sf_dir).withColumnRenamed("rule", "worst_rule"), ["node_id", "worst_rule"], "left")
    return weighted.select(*K, "worst_rule", r6(samples.severity_floor(c("severity"), F.coalesce("weight", lit(1.0)))).alias("floor"))
