"""The per-node ordered folds: rolling statistics, smoothing, state machine, stateful rules, timescales, bursts.

Each step class keeps a small state and takes one window at a time; ``dump`` and ``load`` turn the state into
plain lists, so a batch back-fill and a stream run the same steps. Windows are aggregated before they reach a
fold; a task walks its nodes' sorted rows batch by batch and never holds a whole history. ``verdicts`` can start
from a stored state, so new days need no replay of old ones.
"""

from __future__ import annotations

import json
import math

from fabrichealth.config import StateConfig, Thresholds
from fabrichealth.operators.rules import ORDER

EPSILON = 2.220446049250313e-16
HEALTHY, DEGRADED, CRITICAL, RECOVERING = "HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING"
RANK = {HEALTHY: 0, DEGRADED: 1, RECOVERING: 1, CRITICAL: 2}


class State:
    """Named numbers and strings that can be stored and restored."""

    fields: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()

    def dump(self) -> list:
        return [*(getattr(self, f) for f in self.fields), *(getattr(self, p).dump() for p in self.parts)]

    def load(self, values: list):
        for name, value in zip(self.fields, values):
            setattr(self, name, value)
        for name, value in zip(self.parts, values[len(self.fields) :]):
            getattr(self, name).load(value)
        return self


class Rolling(State):
    """Exponential mean and variance with a baseline after five values that bounds the mean's drift."""

    fields = ("mean", "var", "trend", "n", "baseline")

    def __init__(self, alpha: float, most: float | None = None, least: float | None = None):
        self.alpha, self.most, self.least = alpha, most, least
        self.mean, self.var, self.trend, self.n, self.baseline = 0.0, 0.0, 0.0, 0, None

    def z(self, value: float) -> float:
        """Distance from the mean in standard deviations; 0 before three values or without spread."""
        spread = math.sqrt(self.var)
        return (value - self.mean) / spread if self.n >= 3 and spread >= EPSILON else 0.0

    def push(self, value: float) -> None:
        self.n += 1
        if self.n == 1:
            self.mean = value
            return
        before, away = self.mean, value - self.mean
        mean = before + self.alpha * away
        self.var = (1.0 - self.alpha) * (self.var + self.alpha * away * away)
        if self.baseline is None and self.n == 5:
            self.baseline = mean
        if self.baseline is not None and self.baseline > EPSILON:
            if self.most is not None:
                mean = min(mean, self.baseline * self.most)
            if self.least is not None:
                mean = max(mean, self.baseline * self.least)
        self.mean, self.trend = mean, mean - before

    @property
    def warm(self) -> bool:
        return self.n >= 5


class Smoothed(State):
    """Exponential mean beside a decaying peak; the effective score is the larger."""

    fields = ("mean", "peak", "n")

    def __init__(self, alpha: float = 0.3, decay: float = 0.85):
        self.alpha, self.decay = min(max(alpha, 0.001), 1.0), min(max(decay, 0.0), 0.999)
        self.mean, self.peak, self.n = 0.0, 0.0, 0

    def update(self, raw: float) -> float:
        self.n += 1
        self.mean = raw if self.n == 1 else self.mean + self.alpha * (raw - self.mean)
        self.peak = raw if raw >= self.peak else self.peak * self.decay
        return max(self.mean, self.peak)


class Machine(State):
    """The four-state machine with dwell times."""

    fields = ("state", "rising", "calm", "held", "in_state")

    def __init__(self, config: StateConfig):
        self.config = config
        self._enter(HEALTHY)

    def _enter(self, state: str) -> None:
        self.state, self.rising, self.calm, self.held, self.in_state = state, 0, 0, 0, 0

    def update(self, effective: float) -> str:
        c = self.config
        self.in_state += 1
        upper = c.degrade_enter if self.state == HEALTHY else c.critical_enter
        self.rising = self.rising + 1 if self.state != CRITICAL and effective >= upper else 0
        up = self.rising >= c.enter_windows
        if self.state == HEALTHY:
            if up:
                self._enter(DEGRADED)
        elif self.state == DEGRADED:
            if up:
                self._enter(CRITICAL)
            else:
                self.calm = self.calm + 1 if effective < c.degrade_exit else 0
                if self.calm >= c.exit_windows:
                    self._enter(HEALTHY)
        elif self.state == CRITICAL:
            self.calm = self.calm + 1 if effective < c.critical_exit else 0
            if self.calm >= c.exit_windows:
                self._enter(RECOVERING)
        else:
            self.held += 1
            if up:
                self._enter(CRITICAL)
            elif self.held >= c.recover_windows:
                self._enter(DEGRADED)
        return self.state

    @property
    def stuck(self) -> bool:
        return self.state != HEALTHY and self.in_state >= self.config.max_hold_windows


class Track(State):
    parts = ("score", "machine")

    def __init__(self, alpha: float, decay: float, config: StateConfig):
        self.score, self.machine = Smoothed(alpha, decay), Machine(config)

    def update(self, raw: float) -> str:
        return self.machine.update(self.score.update(raw))


class Timescales(State):
    """A fast, a medium and a slow track; the worst of them, of equals the slowest."""

    parts = ("fast", "medium", "slow")

    def __init__(self, base: StateConfig):
        from dataclasses import replace

        self.fast = Track(0.6, 0.5, replace(base, enter_windows=1, exit_windows=max(2, base.exit_windows // 2)))
        self.medium = Track(0.3, 0.85, base)
        self.slow = Track(0.1, 0.95, replace(base, enter_windows=max(4, 2 * base.enter_windows), exit_windows=max(8, 2 * base.exit_windows)))

    def update(self, raw: float) -> str:
        worst = HEALTHY
        for state in (self.fast.update(raw), self.medium.update(raw), self.slow.update(raw)):
            if RANK[state] >= RANK[worst]:
                worst = state
        return worst


class Bursts(State):
    """Spikes among the last windows, and the class they make with the fast and slow tracks."""

    fields = ("recent",)

    def __init__(self, spike: float = 0.40, span: int = 30, least: int = 2):
        self.spike, self.span, self.least, self.recent = spike, span, least, []

    def update(self, raw: float, fast: str, slow: str) -> str:
        self.recent = [*self.recent[-(self.span - 1) :], int(raw >= self.spike)]
        burst = sum(self.recent) >= self.least or fast in (DEGRADED, CRITICAL)
        lasting = slow in (DEGRADED, CRITICAL)
        return ("MIXED" if lasting else "BURST") if burst else ("SUSTAINED" if lasting else "QUIET")


class LinkRule(State):
    """Link degradation: immediate faults, error budget, rate ceiling, rate anomaly, then cool-down."""

    fields = ("elevated", "cooldown", "link")
    parts = ("symbol", "received", "soft")

    def __init__(self, t: Thresholds):
        self.t = t
        self.symbol, self.received, self.soft = (Rolling(0.1, 3.0) for _ in range(3))
        self.elevated, self.cooldown, self.link = 0, 0, "NOMINAL"

    def _raise(self) -> None:
        self.elevated, self.cooldown, self.link = min(self.elevated + 1, 10), 3, "ELEVATED"

    def update(self, w: dict) -> tuple[str, str] | None:
        """(severity, cause) of an alert, if any."""
        flow = float(w["throughput"])
        rates = (w["symbol_errors"] / flow, (w["rcv_errors"] + w["xmit_discards"]) / flow, w["soft_errors"] / flow)
        tracks = (self.symbol, self.received, self.soft)
        z = [track.z(rate) for track, rate in zip(tracks, rates)]
        for track, rate in zip(tracks, rates):
            track.push(rate)
        if w["link_downed"] > 0:
            self.link, self.elevated = "DOWN", 0
            return CRITICAL, "link_down"
        if w["link_recovery"] > 0:
            self.link, self.elevated = "RECOVERING", 0
            return CRITICAL, "link_recovery"
        if w["hard_errors"] > self.t.link_budget:
            self._raise()
            return CRITICAL if w["hard_errors"] > 10 * self.t.link_budget else DEGRADED, "budget"
        errors = w["all_errors"]
        if errors > 0 and w["has_traffic"] and errors / flow >= self.t.link_ceiling:
            self._raise()
            return CRITICAL if errors / flow >= 3.0 * self.t.link_ceiling or self.elevated >= 3 else DEGRADED, "ceiling"
        if self.symbol.warm and errors > 0 and max(z) >= self.t.z:
            self._raise()
            return CRITICAL if max(z) >= 2.0 * self.t.z or self.elevated >= 3 else DEGRADED, "anomaly"
        if self.cooldown > 0:
            self.cooldown -= 1
        elif self.elevated > 0:
            self.elevated -= 1
            self.cooldown = 3 if self.elevated else 0
        if not self.elevated:
            self.link = "NOMINAL"
        return None


class RollingRules(State):
    """The rules that compare a window with its own past: latency drift, throughput drop, stalls, congestion."""

    parts = ("drift", "flow", "stall", "wait")

    def __init__(self, t: Thresholds):
        self.t = t
        self.drift, self.flow, self.stall, self.wait = Rolling(0.1, 5.0), Rolling(0.1, None, 0.5), Rolling(0.1, 5.0), Rolling(0.1, 5.0)

    def update(self, w: dict) -> dict[str, str]:
        t, out = self.t, {}
        if w["cq_completions"] > 0:
            mean = w["cq_latency_total"] / w["cq_completions"]
            z = self.drift.z(mean)
            self.drift.push(mean)
            if self.drift.warm and abs(z) >= t.z:
                out["latency_drift"] = CRITICAL if abs(z) >= 2 * t.z else DEGRADED
        moved = float(w["traffic_bytes"] if w["traffic_bytes"] > 0 else w["traffic_packets"])
        before = self.flow.mean
        self.flow.push(moved)
        if self.flow.warm and before >= 1.0:
            drop = (before - moved) / before * 100.0
            if drop >= t.drop_pct:
                out["throughput_drop"] = CRITICAL if drop >= 80.0 else DEGRADED
        if w["cq_completions"] >= t.stall_minimum:
            z = self.stall.z(w["estimated_p99"])
            self.stall.push(w["estimated_p99"])
            if w["cq_stalls"] > 0:
                out["cq_jitter_stall"] = CRITICAL if w["cq_stalls"] > 10 or w["cq_latency_max"] > 1_000_000 else DEGRADED
            elif self.stall.warm and z >= t.z:
                out["cq_jitter_stall"] = DEGRADED
        wait = float(w["xmit_wait"])
        z = self.wait.z(wait)
        self.wait.push(wait)
        if self.wait.warm and wait >= 1.0 and w["hard_errors"] + w["link_recovery"] == 0 and z >= t.z:
            out["congestion_spread"] = CRITICAL if z >= 2 * t.z else DEGRADED
        return out


class TrendRule(State):
    """Rising error totals, for rows that hold no trend of their own: a stream can't look back over its rows."""

    fields = ("before", "streak")

    def __init__(self, t: Thresholds):
        self.t, self.before, self.streak = t, None, 0

    def update(self, w: dict) -> str | None:
        total = w["hard_errors"] + w["rcv_errors"] + w["xmit_discards"]
        self.streak = self.streak + 1 if self.before is not None and total > self.before else 0
        self.before = total
        return (CRITICAL if self.streak >= 6 else DEGRADED) if self.streak >= self.t.trend_streak and total > 0 else None


class Verdict(State):
    """One node: stateful rules, carry-forward of the raw score, fusion, severity floor, smoothing, states."""

    fields = ("raw",)
    parts = ("trend", "link", "rolling", "track", "scales", "bursts")

    def __init__(self, t: Thresholds, weights: dict[str, float] | None = None, order: tuple[str, ...] = ORDER):
        self.t, self.weights, self.order, self.raw = t, weights or {}, order, 0.0
        self.trend, self.link, self.rolling = TrendRule(t), LinkRule(t), RollingRules(t)
        self.track, self.scales, self.bursts = Track(0.3, 0.85, t.state), Timescales(t.state), Bursts()

    def update(self, w: dict) -> dict:
        rising = self.trend.update(w)
        alerts = {rule: w[rule] for rule in self.order if w.get(rule)}
        if rising and "rising_error_trend" not in w:
            alerts["rising_error_trend"] = rising
        cause = self.link.update(w)
        if cause:
            alerts["rdma_link_degradation"] = cause[0]
        alerts |= self.rolling.update(w)
        worst = max((r for r in self.order if r in alerts), key=lambda r: (RANK[alerts[r]], -self.order.index(r)), default=None)
        severity = alerts[worst] if worst else HEALTHY
        fresh = w["score"]
        raw = fresh if w["has_link_signal"] else max(0.9 * self.raw, fresh)
        raw = min(raw + (w.get("fusion") or 0.0), 1.0)
        c = self.t.state
        floor = {CRITICAL: c.critical_enter, DEGRADED: c.degrade_enter}.get(severity, 0.0) * (self.weights.get(worst, 1.0) if worst else 0.0)
        self.raw = raw = max(raw, floor)
        state = self.track.update(raw)
        composite = self.scales.update(raw)
        fast, medium, slow = (s.machine.state for s in (self.scales.fast, self.scales.medium, self.scales.slow))
        score = self.track.score
        return {
            "raw": raw, "ewma": score.mean, "peak": score.peak, "effective": max(score.mean, score.peak), "state": state, "severity": severity,
            "worst_rule": worst, "alerts": ",".join(f"{r}:{alerts[r]}" for r in self.order if r in alerts), "link_cause": cause[1] if cause else None,
            "link_state": self.link.link, "fast_state": fast, "medium_state": medium, "slow_state": slow, "composite_state": composite,
            "burst": self.bursts.update(raw, fast, slow), "stuck": self.track.machine.stuck, "windows_in_state": self.track.machine.in_state,
        }


VERDICT_SCHEMA = (
    "node_id long, window_seq long, raw double, ewma double, peak double, effective double, state string, severity string, worst_rule string, alerts string, "
    "link_cause string, link_state string, fast_state string, medium_state string, slow_state string, composite_state string, burst string, stuck boolean, windows_in_state long"
)
#: The columns a fold reads; nothing else is sent to it.
FOLD_COLUMNS = (
    "node_id", "window_seq", "score", "has_link_signal", "throughput", "traffic_bytes", "traffic_packets", "has_traffic", "hard_errors", "soft_errors", "all_errors",
    "symbol_errors", "rcv_errors", "xmit_discards", "link_downed", "link_recovery", "xmit_wait", "cq_completions", "cq_latency_total", "cq_latency_max", "cq_stalls", "estimated_p99", "fusion",
)


def advance(steps: list, w: dict) -> dict:
    """Feed a node's next window to the only item of ``steps``; a row with ``reset`` starts the node anew."""
    if w.get("reset"):
        steps[0] = Verdict(steps[0].t, steps[0].weights, steps[0].order)
    return steps[0].update(w)


#: Arrow's name of each type that the folds return.
ARROW_TYPES = {"long": "int64", "double": "float64", "string": "string", "boolean": "bool"}


def walk(table, start, step, schema: str, order=("window_seq",), keys=("node_id",), end=None, last=None, heads=None, many: bool = False):
    """Each key's rows in order through ``step(state, row)``, whose result is added to the row.

    ``start(head, key)`` makes a key's state from its JSON in ``heads(keys, head)``, None for a key without one. With
    ``end`` only ``end(state, key)`` is given, once per key, also for keys that have a head and no rows. With ``last``
    the last row of each key also holds ``last(state)``. With ``many`` a step gives any number of rows, and so does ``end``
    after the key's last one. Heads come as the first row of their key, so they are neither joined to the rows nor
    held by the driver. Rows are dealt by key and sorted in their partition, so a task holds one batch of rows however
    long a history is.
    """
    from pyspark.sql import functions as F

    fields = [f.split() for f in schema.split(", ")]
    if heads is not None:
        table = heads.select(*keys, F.coalesce("head", F.lit("null")).alias("_head")).unionByName(table, allowMissingColumns=True)
    else:
        table = table.withColumn("_head", F.lit(None).cast("string"))

    def run(batches):
        import pyarrow as pa

        given = pa.schema([(name, ARROW_TYPES[kind]) for name, kind in fields])
        state, now, held = None, None, None

        def closing():
            """What is left to give of the key that just ended."""
            if held is not None:
                return [{**held, **last(state)}]
            if end is None or now is None:
                return []
            made = end(state, dict(zip(keys, now)))
            return made if many else [made]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = [row[k] for k in keys]
                if key != now:
                    out += closing()
                    state, now, held = start(row["_head"] and json.loads(row["_head"]), dict(zip(keys, key))), key, None
                if row["_head"] is not None:
                    continue
                new = step(state, row)
                own = {name: row[name] for name, _ in fields if name in row}
                if many:
                    out += [{**own, **x} for x in new]
                elif last is not None:
                    if held is not None:
                        out.append(held)
                    held = {**own, **new}
                elif end is None:
                    out.append({**own, **new})
            yield pa.RecordBatch.from_pylist(out, schema=given)
        yield pa.RecordBatch.from_pylist(closing(), schema=given)

    # dealt by a hash of its own: a table that is dealt by the keys already would not be dealt again, and the adaptive
    # planner may then read its shuffle by map task, which parts a key's rows before an operator that can't say it needs them
    return table.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, F.col("_head").isNull(), *order).mapInArrow(run, schema)


def _heads(weights, states):
    """(node_id, head): a node's weights by rule and its state to continue from, as JSON."""
    from pyspark.sql import functions as F

    own = None
    if weights is not None:
        own = weights.groupBy("node_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("rule", "weight")))).alias("weights"))
    if states is not None:
        given = states.select("node_id", "state")
        own = given if own is None else own.join(given, "node_id", "full")
    if own is None:
        return None
    parts = [F.coalesce(F.col(c) if c in own.columns else F.lit(None), F.lit("null")) for c in ("weights", "state")]
    return own.select("node_id", F.concat(F.lit("["), parts[0], F.lit(","), parts[1], F.lit("]")).alias("head"))


def _verdict_start(t: Thresholds, weights):
    from fabrichealth.operators import rules

    by_rule, order = weights if isinstance(weights, dict) else None, rules.order()

    def start(head: list | None, key: dict) -> list:
        own, state = head or (None, None)
        step = Verdict(t, by_rule if own is None else own, order)
        return [step if state is None else step.load(state)]

    return start


def verdicts(windows, t: Thresholds, weights=None, states=None, with_states: bool = False):
    """The verdict of every (node, window) row of a table with the fold columns, rule columns and fusion.

    ``weights`` scales the floor of each rule's severity: by rule for all nodes, or as a table (node_id, rule,
    weight). ``states(node_id, state)`` continues where an earlier run ended. ``with_states`` adds final_state: the
    state to continue from, on each node's last row, so one pass gives both.
    """
    schema, last = VERDICT_SCHEMA, None
    if with_states:
        schema, last = f"{VERDICT_SCHEMA}, final_state string", lambda steps: {"final_state": json.dumps(steps[0].dump())}
    heads = _heads(None if isinstance(weights, dict) else weights, states)
    return walk(windows, _verdict_start(t, weights), advance, schema, last=last, heads=heads)


def final_states(windows, t: Thresholds, weights=None, states=None):
    """(node_id, state): each node's state after its last window, to continue from; nodes without new windows keep theirs."""
    end = lambda steps, key: {**key, "state": json.dumps(steps[0].dump())}
    kept = states.select("node_id") if states is not None else None
    own = _heads(None if isinstance(weights, dict) else weights, states)
    if own is not None and weights is not None and not isinstance(weights, dict):
        known = windows.select("node_id").distinct() if kept is None else windows.select("node_id").unionByName(kept).distinct()
        own = own.join(known, "node_id", "left_semi")  # a node that has weights alone has no state
    return walk(windows, _verdict_start(t, weights), advance, "node_id long, state string", end=end, heads=own)


def fold_column(table, make, update, schema: str, order=("window_seq",), key=("node_id",)):
    """Run one step class over each key's rows in order; ``update(step, row)`` gives the new columns."""
    return walk(table, lambda head, own: make(), update, schema, order, key)
