"""Derived figures of a window row as Column expressions, evaluated inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabrichealth.schemas import CAPABILITY_WEIGHTS, QUALITY_WEIGHTS

c = F.col


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def whole_average(total: str, n: str) -> Column:
    """Integer average, 0 when there is nothing."""
    return F.when(c(n) > 0, F.expr(f"{total} div {n}")).otherwise(F.lit(0)).cast("long")


def average(total: str, n: str) -> Column:
    return F.when(c(n) > 0, c(total) / c(n)).otherwise(F.lit(0.0))


def error_rate() -> Column:
    return F.when(c("completions") > 0, c("completion_errors") / c("completions")).otherwise(F.lit(0.0))


def estimated_p99() -> Column:
    mean = average("cq_latency_total", "cq_completions")
    return F.when(c("cq_stalls") > 0, c("cq_latency_max") * F.lit(0.9)).when(c("cq_completions") > 0, mean * 2).otherwise(F.lit(0.0))


def hard_errors() -> Column:
    return c("symbol_errors") + c("link_downed") + c("remote_physical_errors") + c("integrity_errors") + c("buffer_overruns")


def soft_errors() -> Column:
    return c("rxe_duplicate_request") + c("rxe_seq_error") + c("rxe_retry_exceeded") + c("rxe_send_error")


def total_errors() -> Column:
    return hard_errors() + c("rcv_errors") + c("xmit_discards")


def all_errors() -> Column:
    return total_errors() + soft_errors()


def traffic_bytes() -> Column:
    """Data counters are in units of 4 bytes."""
    return (c("rcv_data") + c("xmit_data")) * 4


def traffic_packets() -> Column:
    return c("rcv_pkts") + c("xmit_pkts")


def throughput() -> Column:
    """Bytes or packets, whichever is larger, 1 at least: what error rates are relative to."""
    return F.greatest(traffic_bytes(), traffic_packets(), F.lit(1).cast("long"))


def has_traffic() -> Column:
    return (traffic_bytes() > 0) | (traffic_packets() > 0)


def has_link_signal() -> Column:
    return has_traffic() | (soft_errors() > 0) | (hard_errors() > 0) | (c("link_recovery") > 0) | (c("link_downed") > 0)


def dominant_cpu_pct() -> Column:
    return F.when(c("irq_total") > 0, F.array_max("irq_per_cpu") / c("irq_total") * 100).otherwise(F.lit(0.0))


def dominant_cpu() -> Column:
    """The CPU with most interrupts; of equals the last, null without CPUs."""
    return F.array_max(F.transform("irq_per_cpu", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]


def irq_imbalance_pct(num_cpus: int) -> Column:
    if num_cpus <= 1:
        return F.lit(0.0)
    ideal = 100.0 / num_cpus
    return clamp((dominant_cpu_pct() - ideal) / (100.0 - ideal) * 100, 0.0, 100.0)


def napi_utilisation() -> Column:
    return F.when(c("napi_budget") > 0, c("napi_work") / c("napi_budget") * 100).otherwise(F.lit(0.0))


def irq_threshold(num_cpus: int, floor: float = 70.0) -> float:
    return max(floor, 100.0 / num_cpus + 45.0)


def irq_threshold_of(num_cpus: Column, floor: float = 70.0) -> Column:
    """The same threshold for a number of CPUs that differs from node to node."""
    return F.greatest(F.lit(floor), 100.0 / num_cpus + 45.0)


def quality_weight(quality: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        out = F.when(quality == name, F.lit(weight)).otherwise(out)
    return out


def effective_weight(quality: Column, confidence: Column) -> Column:
    return quality_weight(quality) * clamp(confidence, 0.0, 1.0)


def is_actionable(quality: Column, confidence: Column) -> Column:
    return (quality != "Absent") & (confidence > 0)


def capability_weight(capability: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in CAPABILITY_WEIGHTS.items():
        out = F.when(capability == name, F.lit(weight)).otherwise(out)
    return out


def normalised(capability: Column, value: Column) -> Column:
    """A sample's value on [0, 1]; not finite or not positive gives 0."""
    unit = lambda x: clamp(x, 0.0, 1.0)
    scaled = (
        F.when(capability.isin("LinkErrors", "OutOfOrder"), unit(value / 50.0))
        .when(capability == "RetransmitSignal", F.when(value <= 1.0, value).otherwise(unit(value / 100.0)))
        .when(capability == "CompletionLatency", unit((value - 100_000.0) / 900_000.0))
        .when(capability.isin("PfcPause", "NakRate", "CnpRate", "CreditStall"), unit(value / 100.0))
        .when(capability == "EcnMarks", unit(value / 1000.0))
        .when(capability == "PeerLiveness", unit((value - 100.0) / 1000.0))
        .otherwise(F.lit(0.0))
    )
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite & (value > 0), scaled).otherwise(F.lit(0.0))


def severity_rank(state: Column) -> Column:
    return F.when(state == "CRITICAL", 2).when(state.isin("DEGRADED", "RECOVERING"), 1).otherwise(0)


def state_code(state: Column) -> Column:
    return F.when(state == "HEALTHY", 0).when(state == "DEGRADED", 1).when(state == "CRITICAL", 2).when(state == "RECOVERING", 3)


def scheduler_view(state: Column) -> Column:
    return F.when(state == "RECOVERING", F.lit("DEGRADED")).otherwise(state)


def milliunits(score: Column) -> Column:
    return (score * 1000).cast("long")


#: The parts of an error summary in their order.
ERROR_PARTS = (
    ("sym", "symbol_errors"), ("recovery", "link_recovery"), ("link_down", "link_downed"), ("rcv_err", "rcv_errors"),
    ("xmit_disc", "xmit_discards"), ("remote_phys", "remote_physical_errors"), ("link_integ", "integrity_errors"), ("buf_overrun", "buffer_overruns"),
)


def error_summary() -> Column:
    return F.concat_ws(", ", *[F.when(c(name) > 0, F.concat(F.lit(f"{short}+"), c(name).cast("string"))) for short, name in ERROR_PARTS])


def composite_score(num_cpus: int) -> Column:
    """Nine bounded terms of a window, 1 at most."""
    base = 100.0 / max(num_cpus, 1) + 20.0
    pct, flow, slab = dominant_cpu_pct(), throughput(), whole_average("slab_latency_total", "slab_allocs")
    util = F.when(c("napi_budget") > 0, (c("napi_work") / c("napi_polls")) / (c("napi_budget") / c("napi_polls"))).otherwise(F.lit(0.0))
    backlog = (c("cq_stalls") > 0) | (soft_errors() > 0) | (hard_errors() > 0)
    up = lambda x: F.least(x, F.lit(1.0))
    term = lambda cond, value: F.when(cond, value).otherwise(F.lit(0.0))
    score = (
        term(pct > base, up((pct - base) / (100.0 - base)) * 0.15)
        + term(c("link_recovery") > 0, F.lit(0.35))
        + term(c("link_downed") > 0, F.lit(0.25))
        + term(hard_errors() > 0, up(hard_errors() / flow * 1000.0) * 0.15)
        + term((soft_errors() > 0) & has_traffic(), up(soft_errors() / flow * 100.0) * 0.25)
        + term((slab > 1000) & backlog, up((slab - 1000.0) / 10000.0) * 0.05)
        + term((c("napi_polls") > 0) & (util > 0.7), up((util - 0.7) / 0.3) * 0.05)
        + term(c("cq_stalls") > 0, up(c("cq_stalls") / F.greatest(c("cq_completions"), F.lit(1))) * 0.15)
        + term((c("xmit_wait") > 0) & (hard_errors() == 0), F.lit(0.10))
    )
    return F.least(score, F.lit(1.0))
