"""Registered queries against their SQL in DuckDB, and stream against batch."""

import glob
import os

import duckdb
import pytest

from fabrichealth.config import SCALED
from fabrichealth.operators import folds, rules
from fabrichealth.plans import base, registry
from fabrichealth.sources import landed

NAMES = ["join_9_merge_instant", "snk_3_status_json", "snk_4_coverage_json", "fold_10_rate_limit", "act_1_dispatch_log", "agg_6_counter_deltas", "win_1_counter_delta", "rule_1_affinity_skew", "scr_1_composite", "fold_3_state_machine", "fold_5_carry_forward", "skt_1_quantiles", "join_3_submit_completion", "alr_1_alert_rules", "sch_3_converge", "cov_3_coverage", "join_2_rule_weights", "src_7_interrupts", "scr_2_fusion"]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(rows):
    cell = lambda x: "null" if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted([str([cell(x) for x in r]) for r in rows])


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({registry.oracle_sql()[name]})").fetchall()
    assert plain([tuple(r[c] for c in cols) for r in df.collect()]) == plain(want)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_day_by_day_equals_at_once(spark, sf_dir):
    windows = rules.fold_input(base.wins(spark, sf_dir), SCALED).cache()
    whole = {(r.node_id, r.window_seq): r.effective for r in folds.verdicts(windows, SCALED).collect()}
    first = windows.filter("window_seq < 60")
    states = folds.final_states(first, SCALED)
    rest = folds.verdicts(windows.filter("window_seq >= 60"), SCALED, states=states).collect()
    assert rest and all(whole[r.node_id, r.window_seq] == r.effective for r in rest)


def test_three_days_equal_one_run(spark, sf_dir):
    """States, weights and nodes without new windows go on from day to day; one pass gives verdicts and states."""
    from fabrichealth.plans.state_queries import rule_weights

    windows, weights = rules.fold_input(base.wins(spark, sf_dir), SCALED).cache(), rule_weights(spark, sf_dir).cache()
    whole = {(r.node_id, r.window_seq): r for r in folds.verdicts(windows, SCALED, weights).collect()}
    states, seen = None, 0
    for low, high in ((0, 40), (40, 80), (80, 10_000)):
        day = windows.filter(f"window_seq >= {low} and window_seq < {high}" + (" and node_id <> 3" if low == 40 else ""))
        if low == 80:
            day = day.unionByName(windows.filter("window_seq >= 40 and window_seq < 80 and node_id = 3"))
        rows = folds.verdicts(day, SCALED, weights, states, with_states=True).cache()
        for r in rows.drop("final_state").collect():
            assert r == whole[r.node_id, r.window_seq]
            seen += 1
        own = {r.node_id: r.final_state for r in rows.filter("final_state is not null").collect()}
        kept = {r.node_id: r.state for r in folds.final_states(day, SCALED, weights, states).collect()}
        assert all(kept[n] == s for n, s in own.items()) and len(kept) == 8
        states = spark.createDataFrame(list(kept.items()), "node_id long, state string")
    assert seen == len(whole)


def test_registered_rules_and_providers_take_part(spark, sf_dir):
    from pyspark.sql import functions as F

    from fabrichealth.operators import samples

    windows = base.wins(spark, sf_dir)
    rules.register("always", lambda t: F.lit("CRITICAL"), ("Throughput",))
    try:
        given = rules.fold_input(windows, SCALED)
        rows = folds.verdicts(given, SCALED).collect()
        assert all("always:CRITICAL" in r.alerts and r.severity == "CRITICAL" for r in rows)
        none = spark.createDataFrame([(n, r, 0.0) for n in range(8) for r in rules.order()], "node_id long, rule string, weight double")
        assert min(r.raw for r in folds.verdicts(given, SCALED, none).collect()) < 0.1 < min(r.raw for r in rows)
        assert rules.capabilities()["always"] == ("Throughput",)
    finally:
        rules.unregister("always")
    assert "always" not in rules.order()
    with pytest.raises(ValueError):
        rules.register("latency_drift", None)
    inventory = spark.createDataFrame([(1, "RoCEv2", ["symbol_error"], ["x_pause"], False), (2, "RoCEv2", ["symbol_error"], [], False)], "node_id long, fabric string, counters array<string>, hw_counters array<string>, probes boolean")
    samples.register("PfcPause", "own_pause", lambda: samples.sent(samples.sample("PfcPause", F.lit(200.0), F.lit(1.0), "High", "own_pause")), "High", F.exists("hw_counters", lambda x: F.contains(x, F.lit("pause"))))
    try:
        best = {r.node_id: (r.backend, r.quality) for r in samples.coverage(samples.probe(inventory)).filter("capability = 'PfcPause'").collect()}
        assert best == {1: ("own_pause", "High"), 2: ("pfc_inference", "Low")}
        told = rules.capabilities()
        plain = sorted(map(tuple, samples.rule_weights(samples.coverage(samples.probe(inventory)), told).collect()))
        assert plain == sorted(map(tuple, samples.inventory_weights(inventory, told).collect()))
        assert {w for n, r, w in plain if r == "congestion_spread"} == {1.0, 0.4}
        assert samples.all_samples(windows, (("PfcPause", "own_pause"),)).filter("value = 200").count() == windows.count()
    finally:
        samples.unregister("PfcPause", "own_pause")


def test_scenario_files(spark, tmp_path):
    # fixed values: the field names of scenario files
    (tmp_path / "a.json").write_text('{"name": "s", "description": "", "events": [{"IrqEntry": {"timestamp_ns": 1, "cpu": 2, "irq": 3, "handler_name_hash": 18446744073709551615}}, {"HardwareCounter": {"timestamp_ns": 2, "port_num": 1, "counter": {"LinkDowned": 4}}}], "expected_states": [{"after_event_index": 1, "expected_state": "Healthy"}]}')
    (tmp_path / "b.json").write_text('[{"SlabFree": {"timestamp_ns": 5, "cpu": 0, "bytes_freed": 9}}]')
    (tmp_path / "c.json").write_text("not json")
    found = landed.scenarios(spark, str(tmp_path))
    rows = landed.scenario_events(found).orderBy("scenario", "position").collect()
    assert [(r.scenario, r.position, r.kind) for r in rows] == [("b", 0, "SlabFree"), ("s", 0, "IrqEntry"), ("s", 1, "HardwareCounter")]
    assert int(rows[1].handler_name_hash) == 2**64 - 1 and (rows[2].counter_kind, int(rows[2].counter_value)) == ("LinkDowned", 4)
    assert [tuple(r) for r in landed.scenario_expectations(found).collect()] == [("s", 1, "HEALTHY")]
