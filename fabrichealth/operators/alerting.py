"""Alert rules with hold times, grouping, rate limits and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.operators.folds import State, fold_column, walk

c = F.col

#: Name, series condition, hold time in seconds, severity.
RULES = (
    ("NodeDegraded", "state_code = 1", 30, "DEGRADED"), ("NodeCritical", "state_code = 2", 15, "CRITICAL"), ("LinkDowned", "link_downed > 0", 0, "CRITICAL"),
    ("HighErrorRate", "symbol_errors + rcv_errors > 10", 15, "DEGRADED"), ("CqStalls", "cq_latency_max > 1000000", 15, "DEGRADED"),
    ("LinkRecovery", "link_recovery > 0", 0, "DEGRADED"), ("Congestion", "xmit_wait > 0", 30, "DEGRADED"),
)


def alert_rules(series: DataFrame, window_seconds: float, rules=RULES) -> DataFrame:
    """(node_id, window_seq, alertname, severity) of all firing rules, in one pass over the series.

    A rule fires where its condition has held for more windows in a row than its hold time takes; any break starts anew.
    """
    order = W.partitionBy("node_id").orderBy("window_seq")
    rows = series.withColumn("_row", F.row_number().over(order))
    breaks = {f"_break{i}": F.max(F.when(~F.coalesce(F.expr(condition), F.lit(False)), c("_row"))).over(order) for i, (_, condition, *_) in enumerate(rules)}
    held = lambda i: c("_row") - F.coalesce(f"_break{i}", F.lit(0))
    needed = lambda hold: -(-hold // int(window_seconds)) if hold else 0
    found = F.array(*[F.struct(F.lit(name).alias("alertname"), F.lit(severity).alias("severity"), (held(i) > needed(hold)).alias("fires")) for i, (name, _, hold, severity) in enumerate(rules)])
    return rows.withColumns(breaks).select("node_id", "window_seq", F.inline(F.filter(found, lambda x: x["fires"]))).drop("fires")


#: What groups alerts, and what a notification holds.
GROUP = ["node_id", "alertname", "severity"]
NOTIFICATION_SCHEMA = "node_id long, alertname string, severity string, at_us long, kind string"
#: Seconds until a new group is told, those of critical ones, between looks at a group, until a lasting
#: group is told again, and until an alert that fires no more counts as resolved.
WAIT, CRITICAL_WAIT, INTERVAL, REPEAT, RESOLVE = 10, 5, 30, 14_400, 60


class Notifier(State):
    """One group's notifications in microseconds: the first after the wait, then a look every interval, which repeats a
    lasting alert, or tells that it is resolved and ends the group. The next firing makes a new group."""

    fields = ("tick", "sent", "last")

    def __init__(self, severity: str, wait: float = WAIT, critical_wait: float = CRITICAL_WAIT, interval: float = INTERVAL, repeat: float = REPEAT, resolve: float = RESOLVE):
        self.wait, self.interval, self.repeat, self.resolve = (round(x * 1_000_000) for x in (critical_wait if severity == "CRITICAL" else wait, interval, repeat, resolve))
        self.tick, self.sent, self.last = None, None, None

    def fire(self, at: int) -> None:
        if self.tick is None:
            self.tick, self.sent = at + self.wait, None
        self.last = at

    def advance(self, until: int) -> list[tuple[int, str]]:
        """The notifications due before a time, at which everything that fired before it is known."""
        out = []
        while self.tick is not None and self.tick < until:
            if self.tick - self.last > self.resolve:
                if self.sent is not None:
                    out.append((self.tick, "resolved"))
                self.tick = None
                break
            if self.sent is None or self.tick - self.sent >= self.repeat:
                out.append((self.tick, "firing"))
                self.sent = self.tick
            self.tick += self.interval
        return out


class RateLimit(State):
    """At most one dispatch per span."""

    fields = ("last",)

    def __init__(self, span: int):
        self.span, self.last = span, None

    def update(self, at: int) -> bool:
        if self.last is not None and at - self.last < self.span:
            return False
        self.last = at
        return True


def rate_limited(alerts: DataFrame, span: int, rules=RULES) -> DataFrame:
    """alerts(node_id, alertname, severity, window_seq) by window: how many, the first in order of the rules, and ``dispatched``: at most one per node and span."""
    place = F.lit(len(rules))
    for i, (name, *_) in enumerate(rules):
        place = F.when(c("alertname") == name, i).otherwise(place)
    rows = alerts.groupBy("node_id", "window_seq").agg(F.count("*").alias("alerts"), F.min_by(F.struct("alertname", "severity"), F.struct(place, c("alertname"))).alias("_first"))
    rows = rows.select("node_id", "window_seq", "alerts", "_first.*")
    return fold_column(rows, lambda: RateLimit(span), lambda s, r: {"dispatched": s.update(r["window_seq"])}, "node_id long, window_seq long, alerts long, alertname string, severity string, dispatched boolean")


def notifications(alerts: DataFrame, until_us: int, **settings) -> DataFrame:
    """(group, at_us, kind) of alerts(node_id, alertname, severity, event_us) up to a time: a firing row per evaluation."""

    def step(notifier, row):
        found = notifier.advance(row["event_us"])
        notifier.fire(row["event_us"])
        return [{"at_us": at, "kind": kind} for at, kind in found]

    def end(notifier, key):
        return [{**key, "at_us": at, "kind": kind} for at, kind in notifier.advance(until_us + 1)]

    rows = alerts.select(*GROUP, "event_us").distinct()
    return walk(rows, lambda _, key: Notifier(key["severity"], **settings), step, NOTIFICATION_SCHEMA, order=("event_us",), keys=GROUP, end=end, many=True)


def dispatch_log(dispatched: DataFrame, handlers: list[str], dry_run: bool = True) -> DataFrame:
    """A row per handler for each dispatched alert: what it was told, and how that went; a dry run calls none and is ok."""
    kinds = F.explode(F.array(*[F.lit(h) for h in handlers]))
    return dispatched.filter("dispatched").select("node_id", "window_seq", "alertname", "severity", kinds.alias("handler"), F.lit(dry_run).alias("dry_run"), F.lit("ok" if dry_run else None).cast("string").alias("result"))


def port_disable_candidates(alerts: DataFrame, ports: DataFrame) -> DataFrame:
    """Critical link alerts with a downed link on nodes that have exactly one port."""
    single = ports.groupBy("node_id").agg(F.countDistinct("port").alias("ports"), F.min("port").alias("port")).filter("ports = 1")
    return alerts.filter("severity = 'CRITICAL' and link_cause = 'link_down'").join(single, "node_id").select("node_id", "window_seq", "port")


def payload(alerts: DataFrame) -> Column:
    return F.to_json(F.struct(F.lit("fabric").alias("source"), "severity", "kind", "message", "affected", "timestamp_ns"))


def top_severity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("_r", F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("window_seq")))).filter("_r = 1").drop("_r")
