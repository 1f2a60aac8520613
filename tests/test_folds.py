import math

from hypothesis import given, settings
from hypothesis import strategies as st

from fabrichealth.config import SCALED, StateConfig, Thresholds
from fabrichealth.operators import alerting, folds, scheduling
from fabrichealth.streaming.stateful import empty_window


def test_recovery_takes_9_12_and_17_clean_windows():
    track, seen = folds.Track(0.3, 0.85, StateConfig()), {}
    for _ in range(10):
        track.update(0.6)
    assert track.machine.state == folds.CRITICAL
    for n in range(1, 30):
        seen.setdefault(track.update(0.0), n)
    assert seen == {folds.CRITICAL: 1, folds.RECOVERING: 9, folds.DEGRADED: 12, folds.HEALTHY: 17}


def test_critical_after_four_windows():
    track = folds.Track(0.3, 0.85, StateConfig())
    assert [track.update(0.9) for _ in range(4)] == [folds.HEALTHY, folds.DEGRADED, folds.DEGRADED, folds.CRITICAL]


def test_decayed_peak_may_fall_below_raw():
    s = folds.Smoothed()
    s.update(0.6)
    assert math.isclose(s.update(0.55), 0.6 + 0.3 * (0.55 - 0.6)) and math.isclose(s.peak, 0.51)


def test_rolling_step_change_gives_z_of_three():
    r = folds.Rolling(0.1)
    for _ in range(10):
        assert r.z(5.0) == 0.0
        r.push(5.0)
    r.push(9.0)
    assert math.isclose(r.z(9.0), 3.0)


def test_rolling_bounds_follow_the_baseline():
    r = folds.Rolling(0.5, 3.0)
    for _ in range(5):
        r.push(1.0)
    for _ in range(50):
        r.push(1000.0)
    assert r.mean == 3.0
    low = folds.Rolling(0.5, None, 0.5)
    for v in [10.0] * 5 + [0.0] * 50:
        low.push(v)
    assert low.mean == 5.0


def test_link_rule_layers_and_cooldown():
    rule = folds.LinkRule(Thresholds())
    w = empty_window(0, 0) | {"throughput": 1000}
    assert rule.update(w | {"link_downed": 1, "hard_errors": 1}) == (folds.CRITICAL, "link_down")
    assert rule.update(w | {"link_recovery": 1}) == (folds.CRITICAL, "link_recovery")
    assert rule.update(w | {"hard_errors": 6, "all_errors": 6, "symbol_errors": 6}) == (folds.DEGRADED, "budget")
    assert rule.update(w | {"hard_errors": 51, "all_errors": 51}) == (folds.CRITICAL, "budget")
    assert rule.update(w | {"hard_errors": 1, "all_errors": 60, "has_traffic": True})[1] == "ceiling"
    assert rule.elevated == 3
    for _ in range(20):
        assert rule.update(w) is None
    assert rule.elevated == 0 and rule.link == "NOMINAL"


def test_a_hold_outlives_health_but_not_a_critical_window():
    p = scheduling.Policy()
    assert [p.update(*x) for x in (("HEALTHY",), ("HEALTHY", "hold"), ("DEGRADED",), ("HEALTHY",), ("CRITICAL",), ("DEGRADED",), ("HEALTHY",))] == ["Available", *["HeldByOperator"] * 3, "Draining", "Draining", "Available"]
    assert p.update("HEALTHY", "hold") == "HeldByOperator" and p.update("HEALTHY", "release") == "Available"
    assert p.update("CRITICAL") == "Draining" and p.update("DEGRADED", "release") == "Draining"
    assert scheduling.Policy(True).update("RECOVERING", "hold") == "Draining"


def test_reconciler_holds_contests_cools_down_and_backs_off():
    tick = lambda at, state="CRITICAL", observed="Available", mine=True, **more: {"at": at, "state": state, "observed": observed, "managed_by_self": mine, "responsive": True} | more
    r = scheduling.Reconciler()
    assert [r.update(x) for x in (tick(0), tick(10, observed="Drained"), tick(20), tick(30), tick(319), tick(320))] == ["drain", "none", "contested_resume", "contested", "contested", "drain"]
    assert [r.update(tick(at, "HEALTHY", "Drained")) for at in (330, 379, 380)] == ["cooldown", "cooldown", "resume"]
    assert [r.update(tick(400, "HEALTHY", "Down", False)), r.update(tick(410, "HEALTHY", "Available")), r.desired] == ["hold", "none", "HeldByOperator"]
    assert [r.update(tick(420, "CRITICAL", "Down", responsive=False)), r.update(tick(430, "CRITICAL", "Unknown"))] == ["skip_down", "skip_unknown"]
    assert [r.update(tick(500 + k, error=True)) for k in range(7)] == [*["read_failed"] * 5, "backoff", "backoff"]
    assert [r.update(tick(804)), r.update(tick(805)), r.update(tick(806))] == ["backoff", "drain", "drain"]


def test_fusion_and_weights_move_the_raw_score():
    w = empty_window(0, 0) | {"score": 0.1, "has_link_signal": True, "fusion": 0.25}
    assert math.isclose(folds.Verdict(Thresholds()).update(w)["raw"], 0.35)
    alert = w | {"fusion": 0.0, "slab_pressure_correlation": folds.CRITICAL}
    assert math.isclose(folds.Verdict(Thresholds(), {"slab_pressure_correlation": 0.4}).update(alert)["raw"], 0.55 * 0.4)
    assert math.isclose(folds.Verdict(Thresholds()).update(alert)["raw"], 0.55)


def test_ties_take_the_slower_track():
    t = folds.Timescales(StateConfig())
    t.fast.machine.state, t.medium.machine.state, t.slow.machine.state = folds.DEGRADED, folds.RECOVERING, folds.HEALTHY
    assert t.update(0.2) in (folds.RECOVERING, folds.DEGRADED)


def test_state_survives_a_dump():
    a = folds.Verdict(SCALED)
    rows = [empty_window(1, k) | {"score": (k % 7) / 7, "has_link_signal": k % 3 == 0, "xmit_wait": k % 5} for k in range(60)]
    for w in rows[:30]:
        a.update(w)
    b = folds.Verdict(SCALED).load(a.dump())
    assert [a.update(w) for w in rows[30:]] == [b.update(w) for w in rows[30:]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=80))
def test_any_scores_give_a_valid_state(scores):
    v = folds.Verdict(Thresholds())
    for k, x in enumerate(scores):
        out = v.update(empty_window(1, k) | {"score": x, "has_link_signal": True})
        assert out["state"] in folds.RANK and 0 <= out["effective"] <= 1


def test_notifications_wait_repeat_and_resolve():
    second = 1_000_000

    def told(severity, fired, until, **settings):
        n, out = alerting.Notifier(severity, **settings), []
        for at in fired:
            out += n.advance(at * second)
            n.fire(at * second)
        return [(at // second, kind) for at, kind in out + n.advance(until * second)]

    assert told("DEGRADED", [100], 1000) == [(110, "firing"), (170, "resolved")]  # looks at 140, where it still fires
    assert told("CRITICAL", [100], 106) == [(105, "firing")]
    assert told("DEGRADED", range(0, 15_000, 15), 15_000) == [(10, "firing"), (14_410, "firing")]
    assert told("DEGRADED", range(0, 960, 15), 1000, repeat=300) == [(at, "firing") for at in (10, 310, 610, 910)]
    assert told("DEGRADED", [0, 500], 2000) == [(10, "firing"), (70, "resolved"), (510, "firing"), (570, "resolved")]
    assert told("DEGRADED", [0, 65], 1000) == [(10, "firing"), (130, "resolved")]
