"""Stateless detection rules as columns: null where a rule doesn't fire, else the severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabrichealth.config import Thresholds
from fabrichealth.functions import exprs as X
from fabrichealth.operators.windows import with_streak
from pyspark.sql import Window as W

c = F.col


def _severity(fires: Column, critical: Column) -> Column:
    return F.when(fires, F.when(critical, F.lit("CRITICAL")).otherwise(F.lit("DEGRADED")))


def interrupt_affinity_skew(t: Thresholds) -> Column:
    least = t.irq_minimum if t.num_cpus > 2 else max(t.irq_minimum, 1000)
    pct = X.dominant_cpu_pct()
    return _severity((c("irq_total") >= least) & (pct >= X.irq_threshold(t.num_cpus, t.irq_pct)), pct >= 90)


def rdma_latency_spike(t: Thresholds) -> Column:
    mean = X.whole_average("completion_latency_total", "completions")
    return _severity((c("completions") >= t.latency_minimum) & (mean >= int(t.latency_baseline_ns * t.latency_factor)), mean / t.latency_baseline_ns >= 10)


def slab_pressure(t: Thresholds) -> Column:
    return _severity((c("slab_allocs") >= t.slab_minimum) & (c("slab_allocs") >= t.slab_pressure) & (X.total_errors() > 0), X.total_errors() > 100)


def napi_saturation(t: Thresholds) -> Column:
    pct = X.napi_utilisation()
    return _severity((c("napi_polls") >= t.napi_minimum) & (c("napi_budget") >= c("napi_polls")) & (pct >= t.napi_pct), pct >= 95)


def pcie_bottleneck(t: Thresholds) -> Column:
    return _severity((c("cq_stalls") >= t.pcie_stalls) & (c("slab_allocs") >= t.pcie_allocs) & (X.all_errors() == 0), F.lit(False))


def with_trend(windows: DataFrame, t: Thresholds) -> DataFrame:
    """Add the length of the run of rising error totals and the trend rule."""
    order = W.partitionBy("node_id").orderBy("window_seq")
    totals = windows.withColumn("_total", X.total_errors())
    rising = totals.withColumn("_rises", c("_total") > F.lag("_total").over(order))
    runs = with_streak(rising, "error_streak", c("_rises"))
    fires = (c("error_streak") >= t.trend_streak) & (c("_total") > 0)
    return runs.withColumn("rising_error_trend", _severity(fires, c("error_streak") >= 6)).drop("_total", "_rises")


#: The stateless rules by name.
STATELESS = {
    "interrupt_affinity_skew": interrupt_affinity_skew,
    "rdma_latency_spike": rdma_latency_spike,
    "slab_pressure_correlation": slab_pressure,
    "napi_saturation": napi_saturation,
    "pcie_bottleneck": pcie_bottleneck,
}


def _fixed(x: Column, places: int) -> Column:
    """A number with so many places, rounded by its exact binary value, ties to the even digit."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * places if places else "0"))


#: The texts of the stateless rules' alerts, with figures in their places.
MESSAGES = {
    "interrupt_affinity_skew": ("Interrupt affinity skew: CPU %s handling %s%% of interrupts", lambda t: (F.coalesce(X.dominant_cpu(), F.lit(0)), _fixed(X.dominant_cpu_pct(), 1))),
    "rdma_latency_spike": ("RDMA latency spike: %sns (%sx baseline)", lambda t: (X.whole_average("completion_latency_total", "completions"), _fixed(X.whole_average("completion_latency_total", "completions") / t.latency_baseline_ns, 1))),
    "slab_pressure_correlation": ("Slab pressure correlated with IB errors: %s allocs/window, %s IB errors", lambda t: (c("slab_allocs"), X.total_errors())),
    "rising_error_trend": ("IB errors rising for %s consecutive windows (current delta: %s)", lambda t: (c("error_streak"), X.total_errors())),
    "napi_saturation": ("NAPI saturation: %s%% budget utilization (%s/%s per poll)", lambda t: (_fixed(X.napi_utilisation(), 0), _fixed(c("napi_work") / F.nullif(c("napi_polls"), F.lit(0)), 0), _fixed(c("napi_budget") / F.nullif(c("napi_polls"), F.lit(0)), 0))),
    "pcie_bottleneck": ("PCIe bottleneck suspected: %s CQ stalls + %s slab allocs, no IB errors — not a cable fault", lambda t: (c("cq_stalls"), c("slab_allocs"))),
}


def alerts(windows: DataFrame, t: Thresholds) -> DataFrame:
    """(node_id, window_seq, rule, severity, message) of the stateless rules and the trend, one row per alert."""
    ruled = with_rules(windows, t)
    told = [F.struct(F.lit(name).alias("rule"), c(name).alias("severity"), F.format_string(text, *[x.cast("string") for x in figures(t)]).alias("message")) for name, (text, figures) in MESSAGES.items()]
    return ruled.select("node_id", "window_seq", F.inline(F.filter(F.array(*told), lambda a: a["severity"].isNotNull())))


#: All rules in their order of evaluation; of equally severe alerts the first gives the coverage weight.
ORDER = (
    "interrupt_affinity_skew", "rdma_latency_spike", "rdma_link_degradation", "slab_pressure_correlation", "rising_error_trend", "latency_drift",
    "throughput_drop", "napi_saturation", "cq_jitter_stall", "congestion_spread", "pcie_bottleneck",
)
#: The capabilities that a rule consults; a rule that isn't named reads signals of the host alone.
CONSULTS = {
    "rdma_latency_spike": ("CompletionLatency",), "rdma_link_degradation": ("LinkErrors", "RetransmitSignal"), "rising_error_trend": ("LinkErrors",),
    "latency_drift": ("CompletionLatency",), "throughput_drop": ("Throughput",), "cq_jitter_stall": ("CompletionLatency",), "congestion_spread": ("PfcPause", "CreditStall"),
}
#: Rules that were registered beside the built-in ones: name to capabilities, in order of registration.
REGISTERED: dict[str, tuple[str, ...]] = {}


def register(name: str, rule, capabilities: tuple[str, ...] = ()) -> None:
    """Add a stateless rule: a function of the thresholds that gives the severity as a column, null where it doesn't fire.

    It takes part in the verdict after the built-in rules; its floor is scaled by the best coverage of ``capabilities``.
    """
    if name in ORDER:
        raise ValueError(f"{name} is a built-in rule")
    STATELESS[name] = rule
    REGISTERED[name] = tuple(capabilities)


def unregister(name: str) -> None:
    del STATELESS[name], REGISTERED[name]


def order() -> tuple[str, ...]:
    """Every rule of the verdict in order of evaluation."""
    return (*ORDER, *REGISTERED)


def capabilities() -> dict[str, tuple[str, ...]]:
    """The capabilities that each rule consults."""
    return {r: CONSULTS.get(r, REGISTERED.get(r, ())) for r in order()}


def with_rules(windows: DataFrame, t: Thresholds, trend: bool = True) -> DataFrame:
    """Add a column for each rule that needs no fold, and the figures that the folds read; without ``trend`` also on streams."""
    ruled = (with_trend(windows, t) if trend else windows).withColumns({name: rule(t) for name, rule in STATELESS.items()})
    return ruled.withColumns(
        {
            "score": X.composite_score(t.num_cpus),
            "has_link_signal": X.has_link_signal(),
            "throughput": X.throughput(),
            "traffic_bytes": X.traffic_bytes(),
            "traffic_packets": X.traffic_packets(),
            "has_traffic": X.has_traffic(),
            "hard_errors": X.hard_errors(),
            "soft_errors": X.soft_errors(),
            "all_errors": X.all_errors(),
            "estimated_p99": X.estimated_p99(),
        }
    )


def fold_input(windows: DataFrame, t: Thresholds, trend: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow table that the verdict fold reads; without ``trend`` the fold finds rising errors itself."""
    from fabrichealth.operators import samples
    from fabrichealth.operators.folds import FOLD_COLUMNS

    return with_rules(windows, t, trend).withColumn("fusion", samples.fusion_column()).select(*FOLD_COLUMNS, *STATELESS, *(["rising_error_trend"] if trend else []), *keep)
