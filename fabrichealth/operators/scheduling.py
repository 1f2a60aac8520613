"""Drain and resume decisions as data: the policy, holds, reconciliation and its log. Nothing is carried out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.operators.folds import State, fold_column

c = F.col
PREFIX = "fabrichealth:"


def observed_state(text: Column) -> Column:
    """A compound state like ``IDLE+DRAIN*`` as one of five."""
    parts = F.split(F.upper(F.replace(text, F.lit("*"), F.lit(""))), r"\+")
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    running = has("ALLOCATED", "MIXED", "COMPLETING", "ALLOC", "MIX", "COMP")
    return (
        F.when(has("DOWN"), "Down")
        .when(has("DRAINING", "DRNG"), "Draining")
        .when(has("DRAINED"), "Drained")
        .when(has("DRAIN"), F.when(running, "Draining").otherwise("Drained"))
        .when(running | has("IDLE"), "Available")
        .otherwise("Unknown")
    )


def field(line: Column, key: str) -> Column:
    """The value of ``key=``, up to the first blank; empty or (null) is null."""
    value = F.regexp_extract(line, rf"(?:^|\s){key}=(\S*)", 1)
    return F.nullif(F.nullif(value, F.lit("")), F.lit("(null)"))


def node_reports(lines: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """node, observed, reason, managed_by_self, responsive of workload-manager lines(line)."""
    raw = F.coalesce(field(c("line"), "State"), F.lit(""))
    reason = field(c("line"), "Reason")
    return lines.select(field(c("line"), "NodeName").alias("node"), observed_state(raw).alias("observed"), reason.alias("reason"), F.coalesce(F.startswith(reason, F.lit(prefix)), F.lit(False)).alias("managed_by_self"), (~F.contains(raw, F.lit("*"))).alias("responsive"))


HELD = "HeldByOperator"


class Policy(State):
    """The desired state: draining when critical, kept when degraded, available when healthy. An operator's hold is a
    desired state of its own: health does not end it, but a critical window replaces it."""

    fields = ("desired",)

    def __init__(self, drain_degraded: bool = False):
        self.drain_degraded, self.desired = drain_degraded, "Available"

    def command(self, command: str | None) -> None:
        if command == "hold":
            self.desired = HELD
        elif command == "release" and self.desired == HELD:
            self.desired = "Available"

    def update(self, state: str, command: str | None = None) -> str:
        self.command(command)
        if state == "CRITICAL" or (state in ("DEGRADED", "RECOVERING") and self.drain_degraded):
            self.desired = "Draining"
        elif state == "HEALTHY" and self.desired != HELD:
            self.desired = "Available"
        return self.desired


DESIRED_SCHEMA = "node_id long, window_seq long, state string, desired string, held boolean"


def desired_states(history: DataFrame, drain_degraded: bool = False, commands: DataFrame | None = None) -> DataFrame:
    """(node_id, window_seq, state, desired, held) from health and the hold and release commands of a window."""
    rows = history.select("node_id", "window_seq", "state")
    if commands is None:  # then the last state that says anything decides
        drains = F.when(c("state").isin("CRITICAL", *(["DEGRADED", "RECOVERING"] if drain_degraded else [])), "Draining").when(c("state") == "HEALTHY", "Available")
        desired = F.coalesce(F.last(drains, ignorenulls=True).over(W.partitionBy("node_id").orderBy("window_seq")), F.lit("Available"))
        return rows.select("*", desired.alias("desired"), F.lit(False).alias("held"))
    rows = rows.join(commands, ["node_id", "window_seq"], "left")
    return fold_column(rows, lambda: Policy(drain_degraded), lambda s, r: {"desired": s.update(r["state"], r["command"]), "held": s.desired == HELD}, DESIRED_SCHEMA)


def operator_hold() -> Column:
    """Drained or down by someone else while we want the node available."""
    return c("observed").isin("Draining", "Drained", "Down") & ~c("managed_by_self") & (c("desired") == "Available")


def action() -> Column:
    """What would bring the observed state to the desired one."""
    drained = c("observed").isin("Draining", "Drained")
    return (
        F.when(operator_hold(), "hold")
        .when(c("observed") == "Unknown", "skip_unknown")
        .when((c("observed") == "Down") & ~c("responsive"), "skip_down")
        .when(c("desired") == HELD, "none")
        .when((c("desired") == "Available") & (c("observed") == "Available"), "none")
        .when((c("desired") == "Draining") & drained, "none")
        .when(c("desired") == "Available", "resume")
        .otherwise("drain")
    )


class Reconciler(State):
    """A node's ticks: the policy, holds that are found, a pause after a contested resume, a cool-down before a
    resume, and backing off from failing reads but for a probe now and then. An operator's hold and release take effect
    at once, also while reads fail; a release ends a contested pause. Times are seconds."""

    fields = ("desired", "drained_at", "contested_until", "last_observed", "failures", "probed_at")
    parts = ("policy",)

    def __init__(self, cooldown: int = 60, contest: int = 300, failures: int = 5, probe: int = 300, drain_degraded: bool = False):
        self.cooldown, self.contest, self.most, self.probe = cooldown, contest, failures, probe
        self.policy, self.desired, self.last_observed = Policy(drain_degraded), "Available", "Unknown"
        self.drained_at, self.contested_until, self.failures, self.probed_at = None, None, 0, None

    def _skips(self, now: int) -> bool:
        if self.failures < self.most:
            return False
        if self.probed_at is None:
            self.probed_at = now
            return True
        if now - self.probed_at >= self.probe:
            self.probed_at = now
            return False
        return True

    def update(self, r: dict) -> str:
        now, observed, command = r["at"], r["observed"], r.get("command")
        self.policy.command(command)
        if command == "hold":
            self.desired = HELD
        elif command == "release":
            self.desired, self.contested_until = "Available", None
        if self._skips(now):
            return "backoff"
        new = self.policy.update(r["state"])
        if r.get("error"):
            self.failures += 1
            return "read_failed"
        self.failures = 0
        if new == "Available" and observed in ("Draining", "Drained", "Down") and not r["managed_by_self"]:
            self.desired = self.policy.desired = HELD
            return "hold"
        if self.desired == "Draining" and observed == "Available" and self.last_observed in ("Draining", "Drained"):
            self.contested_until, self.last_observed = now + self.contest, observed
            return "contested_resume"
        if self.contested_until is not None:
            if now < self.contested_until:
                return "contested"
            self.contested_until = None
        self.desired, self.last_observed = new, observed
        if observed == "Unknown":
            return "skip_unknown"
        if observed == "Down" and not r["responsive"]:
            return "skip_down"
        if new == HELD or observed == new or (new == "Draining" and observed == "Drained"):
            return "none"
        if new == "Draining":
            self.drained_at = now
            return "drain"
        if self.drained_at is not None and now - self.drained_at < self.cooldown:
            return "cooldown"
        self.drained_at = None
        return "resume"


def reconcile(rows: DataFrame, cooldown: int = 60, contest: int = 300, order=("at",)) -> DataFrame:
    """rows(node_id, at, state, observed, managed_by_self, responsive, error, command) with the desired state and decision of each tick."""
    if "command" not in rows.columns:
        rows = rows.withColumn("command", F.lit(None).cast("string"))

    def step(s, r):
        decision = s.update(r)
        return {"desired": s.desired, "decision": decision}

    return fold_column(rows, lambda: Reconciler(cooldown, contest), step, "node_id long, at long, state string, observed string, command string, desired string, decision string", order=list(order))


#: What the action log calls a decision; other decisions leave no entry.
LOG_KINDS = {"drain": "drained", "resume": "resumed", "hold": "operator_hold_detected", "read_failed": "error", "skip_down": "skipped", "skip_unknown": "skipped", "cooldown": "skipped", "contested_resume": "contested_resume"}


def action_log(decided: DataFrame, dry_run: bool = True) -> DataFrame:
    """(node_id, at, kind, mode) of reconciled ticks: what a decision did, and the operator's own commands."""
    kind = F.lit(None).cast("string")
    for decision, name in LOG_KINDS.items():
        kind = F.when(c("decision") == decision, name).otherwise(kind)
    asked = F.when(c("command") == "hold", "hold_set").when(c("command") == "release", "hold_released")
    both = F.filter(F.array(asked, kind), lambda k: k.isNotNull())
    return decided.select("node_id", "at", F.explode(both).alias("kind"), F.lit("dry_run" if dry_run else "live").alias("mode"))


class Interval(State):
    """Ticks at least a span apart."""

    fields = ("last",)

    def __init__(self, span: int):
        self.span, self.last = span, None

    def due(self, at: int) -> bool:
        if self.last is not None and at - self.last < self.span:
            return False
        self.last = at
        return True


def due_ticks(rows: DataFrame, interval: int = 10, order=("at",)) -> DataFrame:
    """rows(node_id, at, event_id) with ``due``: a node is reconciled when that was ``interval`` seconds ago or more."""
    return fold_column(rows, lambda: Interval(interval), lambda s, r: {"due": s.due(r["at"])}, "node_id long, at long, event_id long, due boolean", order=list(order))
