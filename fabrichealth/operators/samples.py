"""Capability samples of a window, backend coverage, and the fusion of samples into a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabrichealth.functions import exprs as X
from fabrichealth.schemas import CAPABILITY_WEIGHTS, QUALITY_WEIGHTS

c, lit = F.col, F.lit

#: Backends in their order of registration: capability, backend, declared quality, and whether it emits samples.
BACKENDS = (
    ("LinkErrors", "sysfs_port_counters", "High", True), ("LinkErrors", "cq_error_inference", "Low", True), ("Throughput", "sysfs_port_counters", "High", True),
    ("CompletionLatency", "ebpf_cq_latency", "High", False), ("CompletionLatency", "throughput_proxy_latency", "High", True),
    ("RetransmitSignal", "ebpf_retx", "High", False), ("RetransmitSignal", "mad_retx_proxy", "Medium", True),
    ("RetransmitSignal", "ethtool_retx", "Medium", True), ("RetransmitSignal", "wr_ratio_inference", "Low", True),
    ("QpAttribution", "ebpf_qp", "High", False), ("QpAttribution", "rdma_core_qp", "Medium", False), ("QpAttribution", "sysfs_rxe_qp", "Medium", False),
    ("PfcPause", "ethtool_pfc", "High", False), ("PfcPause", "pfc_inference", "Low", True), ("EcnMarks", "ethtool_ecn", "High", False),
    ("CnpRate", "ethtool_cnp", "High", False), ("PeerLiveness", "active_prober", "Medium", True),
)
QUALITY_CODE = {"Absent": 0, "Low": 1, "Medium": 2, "High": 3}
CRITICAL_CAPABILITIES = ("LinkErrors", "Throughput", "CompletionLatency", "RetransmitSignal")


def _sample(capability: str, value: Column, confidence: Column, quality: str, backend: str, label: Column | None = None) -> Column:
    return F.struct(
        lit(capability).alias("capability"),
        value.cast("double").alias("value"),
        confidence.cast("double").alias("confidence"),
        lit(quality).alias("quality"),
        lit(backend).alias("backend"),
        (label if label is not None else lit(None).cast("string")).alias("label"),
    )


def _busy(high: float, low: float) -> Column:
    return F.when(X.has_traffic(), lit(high)).otherwise(lit(low))


def unsent() -> Column:
    return F.greatest(c("xmit_pkts") - c("rcv_pkts"), lit(0))


def _sent(*samples: Column, when: Column | None = None) -> Column:
    """An array of a window's samples, empty where the provider has none."""
    found = F.array(*samples)
    return F.filter(found, lambda _: F.coalesce(when, lit(False))) if when is not None else found


def _emit(windows: DataFrame, *sent: Column) -> DataFrame:
    """The samples of each window, one a row; all providers in one pass over the windows."""
    return windows.select("node_id", "window_seq", F.inline(F.concat(*sent)))


def _link_errors() -> Column:
    return _sent(_sample("LinkErrors", X.hard_errors() + 5 * c("link_recovery") + 50 * c("link_downed"), _busy(1.0, 0.2), "High", "sysfs_port_counters"))


def _inferred_link_errors() -> Column:
    return _sent(_sample("LinkErrors", c("cq_stalls"), F.when(c("cq_stalls") > 0, 0.3).otherwise(0.05), "Low", "cq_error_inference"))


def _throughput() -> Column:
    one = lambda v, name: _sample("Throughput", v, F.when(v > 0, 1.0).otherwise(0.5), "High", "sysfs_port_counters", lit(name))
    return _sent(one(X.traffic_packets(), "pkts"), one(X.traffic_bytes(), "bytes"))


def _estimated_latency() -> Column:
    figures = (("avg", X.average("cq_latency_total", "cq_completions")), ("p99", X.estimated_p99()), ("max", c("cq_latency_max")))
    sure = X.clamp(c("cq_completions") / 100.0, 0.05, 0.7)
    return _sent(*[_sample("CompletionLatency", v, sure, "Low", "throughput_proxy_latency", lit(name)) for name, v in figures], when=c("cq_completions") > 0)


def _retransmit_port() -> Column:
    return _sent(_sample("RetransmitSignal", c("remote_physical_errors") + 0.05 * unsent(), _busy(0.7, 0.2), "Medium", "mad_retx_proxy"))


def _retransmit_retry() -> Column:
    return _sent(_sample("RetransmitSignal", c("rxe_retry_exceeded") + 0.5 * c("rxe_seq_error") + 0.3 * c("rxe_duplicate_request"), _busy(0.8, 0.2), "Medium", "ethtool_retx"))


def _retransmit_ratio() -> Column:
    ratio = unsent() / F.nullif(c("xmit_pkts"), lit(0))
    return _sent(_sample("RetransmitSignal", ratio, X.clamp(ratio * 4, 0.0, 0.4), "Low", "wr_ratio_inference"), when=(c("xmit_pkts") >= 1) & (c("rcv_pkts") >= 1))


def _pause() -> Column:
    clean = X.hard_errors() < 1
    return _sent(_sample("PfcPause", F.when(clean, c("xmit_wait")).otherwise(0), F.when(clean, 0.3).otherwise(0.05), "Low", "pfc_inference"), when=c("xmit_wait") >= 1)


#: The samples that each capability's backend takes from a window.
PROVIDERS = {
    ("LinkErrors", "sysfs_port_counters"): _link_errors, ("LinkErrors", "cq_error_inference"): _inferred_link_errors, ("Throughput", "sysfs_port_counters"): _throughput,
    ("CompletionLatency", "throughput_proxy_latency"): _estimated_latency, ("RetransmitSignal", "mad_retx_proxy"): _retransmit_port,
    ("RetransmitSignal", "ethtool_retx"): _retransmit_retry, ("RetransmitSignal", "wr_ratio_inference"): _retransmit_ratio, ("PfcPause", "pfc_inference"): _pause,
}
#: Active unless others are named.
ACTIVE = (("LinkErrors", "sysfs_port_counters"), ("Throughput", "sysfs_port_counters"), ("CompletionLatency", "throughput_proxy_latency"), ("RetransmitSignal", "ethtool_retx"), ("PfcPause", "pfc_inference"))


#: Providers that were registered beside the built-in ones: declared quality and availability by capability and backend.
REGISTERED: dict[tuple[str, str], tuple[str, Column]] = {}

sample, sent = _sample, _sent


def register(capability: str, backend: str, provider, quality: str, available: Column) -> None:
    """Add a provider: a function without arguments that gives an array column of samples over window columns (see
    ``sample`` and ``sent``), the quality it declares, and a condition on the inventory for where it is available.

    It is probed, and wins over built-in ones of equal or lower quality.
    """
    PROVIDERS[capability, backend] = provider
    REGISTERED[capability, backend] = (quality, available)


def unregister(capability: str, backend: str) -> None:
    del PROVIDERS[capability, backend], REGISTERED[capability, backend]


def samples_of(windows: DataFrame, capability: str, backend: str) -> DataFrame:
    """The samples of one provider."""
    return _emit(windows, PROVIDERS[capability, backend]())


def completion_latency(w: DataFrame, quantiles: DataFrame | None = None) -> DataFrame:
    """From sketch quantiles (node_id, window_seq, n, p50, p95, p99, p999) where a window has them, else estimates."""
    if quantiles is None:
        return _emit(w, _estimated_latency())
    sure = X.clamp(c("_q.n") / 200.0, 0.1, 0.95)
    high = [_sample("CompletionLatency", c(f"_q.{p}"), sure, "Medium", "throughput_proxy_latency", lit(p)) for p in ("p50", "p95", "p99", "p999")]
    joined = w.join(quantiles.select("node_id", "window_seq", F.struct("n", "p50", "p95", "p99", "p999").alias("_q")), ["node_id", "window_seq"], "left")
    return _emit(joined, F.when(c("_q").isNotNull(), _sent(*high)).otherwise(_estimated_latency()))


def kernel_quantiles(quantiles: DataFrame) -> DataFrame:
    """Samples of quantiles (node_id, window_seq, n, p50, p99, p999) of every single completion; sure from 100 completions on."""
    sure = F.when(c("n") >= 100, 1.0).otherwise(F.greatest(c("n") / 100.0, lit(0.05)))
    return _emit(quantiles, _sent(*[_sample("CompletionLatency", c(p), sure, "High", "ebpf_cq_latency", lit(p)) for p in ("p50", "p99", "p999")]))


def peer_liveness(probes: DataFrame, dead_peer_value: float | None = None) -> DataFrame:
    """A sample per peer of ``probes(node_id, window_seq, peer, rtt_us, error)``; a dead peer is infinitely far, which counts 0 in the fusion unless a value is given."""
    alive = c("error").isNull() & c("rtt_us").isNotNull()
    dead = float("inf") if dead_peer_value is None else dead_peer_value
    return probes.select("node_id", "window_seq", F.inline(F.array(_sample("PeerLiveness", F.when(alive, c("rtt_us")).otherwise(lit(dead)), F.when(alive, 0.9).otherwise(0.3), "Medium", "active_prober", c("peer")))))


def qp_attribution(top: DataFrame) -> DataFrame:
    """Heavy hitters (node_id, window_seq, qp, weight) as samples."""
    return top.select("node_id", "window_seq", F.inline(F.array(_sample("QpAttribution", c("weight"), lit(1.0), "High", "ebpf_qp", c("qp").cast("string")))))


def all_samples(windows: DataFrame, backends=ACTIVE) -> DataFrame:
    """The samples of the active providers."""
    return _emit(windows, *[PROVIDERS[b]() for b in backends])


def _share(capability: Column, value: Column, quality: Column, confidence: Column) -> Column:
    """What a sample adds to the fusion; nothing unless it is actionable."""
    part = X.normalised(capability, value) * X.capability_weight(capability) * X.effective_weight(quality, confidence)
    return F.when(X.is_actionable(quality, confidence), part).otherwise(0.0)


def _squashed(total: Column) -> Column:
    return X.clamp(F.tanh(total / 2.0) * 0.5, 0.0, 0.5)


def fusion(samples: DataFrame) -> DataFrame:
    """(node_id, window_seq, fusion): the squashed weighted sum of actionable samples, 0.5 at most."""
    return samples.groupBy("node_id", "window_seq").agg(_squashed(F.sum(_share(c("capability"), c("value"), c("quality"), c("confidence")))).alias("fusion"))


def fusion_column(backends=ACTIVE) -> Column:
    """The same figure as a column of the window table, without a row per sample."""
    return _squashed(F.aggregate(F.concat(*[PROVIDERS[b]() for b in backends]), lit(0.0), lambda total, x: total + _share(x["capability"], x["value"], x["quality"], x["confidence"])))


def inventory_predicates() -> dict[tuple[str, str], Column]:
    """Whether a backend is available on a node: columns fabric, counters (standard), hw_counters (arrays) and probes."""
    has = lambda col, part: F.exists(col, lambda x: F.contains(x, lit(part)))
    return {
        ("LinkErrors", "sysfs_port_counters"): F.size("counters") > 0, ("LinkErrors", "cq_error_inference"): lit(True),
        ("Throughput", "sysfs_port_counters"): (F.size("counters") > 0) | (F.size("hw_counters") > 0),
        ("CompletionLatency", "throughput_proxy_latency"): lit(True), ("RetransmitSignal", "mad_retx_proxy"): (c("fabric") == "InfiniBand") & has("counters", "port_rcv_remote_physical_errors"),
        ("RetransmitSignal", "ethtool_retx"): has("hw_counters", "retry"), ("RetransmitSignal", "wr_ratio_inference"): lit(True),
        ("PfcPause", "pfc_inference"): ~c("fabric").isin("InfiniBand", "SoftRoCE"), ("PeerLiveness", "active_prober"): c("probes"),
    }


#: Why a backend is not available on a node, by backend; those that are not named have no collector.
REASONS = {
    "sysfs_port_counters": "no port counters", "mad_retx_proxy": "no InfiniBand port with physical-error counters", "ethtool_retx": "no retry counter",
    "pfc_inference": "no pause frames on this fabric", "active_prober": "no peer probes",
}


def probe(inventory: DataFrame) -> DataFrame:
    """Every backend of every node with its availability and reason."""
    known = inventory_predicates() | {at: available for at, (_, available) in REGISTERED.items()}
    declared = [b[:3] for b in BACKENDS] + [(*at, quality) for at, (quality, _) in REGISTERED.items()]
    rows = [
        F.struct(lit(cap).alias("capability"), lit(name).alias("backend"), lit(quality).alias("quality"), lit(i).alias("place"), F.coalesce(known[cap, name], lit(False)).alias("available") if (cap, name) in known else lit(False).alias("available"))
        for i, (cap, name, quality) in enumerate(declared)
    ]
    out = inventory.select("node_id", F.inline(F.array(*rows)))
    missing = lit("no collector attached")
    for name, reason in REASONS.items():
        missing = F.when(c("backend") == name, reason).otherwise(missing)
    return out.withColumn("reason", F.when(c("available"), lit("ok")).otherwise(missing))


def quality_code(quality: Column) -> Column:
    out = lit(0)
    for name, code in QUALITY_CODE.items():
        out = F.when(quality == name, lit(code)).otherwise(out)
    return out


def winners(probed: DataFrame) -> DataFrame:
    """The best available backend of each node and capability; of equal quality the later registered."""
    order = W.partitionBy("node_id", "capability").orderBy(quality_code(c("quality")).desc(), c("place").desc())
    return probed.filter("available").withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def coverage(probed: DataFrame) -> DataFrame:
    """Every capability of every node: its backend and quality, absent without one, and the fallbacks in order."""
    caps = F.array(*[lit(x) for x in CAPABILITY_WEIGHTS])
    grid = probed.select("node_id").distinct().select("node_id", F.explode(caps).alias("capability"))
    chain = probed.filter("available").groupBy("node_id", "capability").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(quality_code(c("quality")), "place", "backend")))), lambda x: x["backend"]), ">").alias("chain"))
    best = winners(probed).select("node_id", "capability", "backend", "quality")
    return grid.join(best, ["node_id", "capability"], "left").join(chain, ["node_id", "capability"], "left").select("node_id", "capability", F.coalesce("backend", lit("none")).alias("backend"), F.coalesce("quality", lit("Absent")).alias("quality"), F.coalesce("chain", lit("")).alias("chain"))


def grade(covered: DataFrame) -> DataFrame:
    """A: all critical capabilities high; B: all at least medium; C: any present; F: none."""
    code = F.when(c("capability").isin(*CRITICAL_CAPABILITIES), quality_code(c("quality")))
    least, most = F.min(code), F.max(code)
    return covered.groupBy("node_id").agg(F.when(least == 3, "A").when(least >= 2, "B").when(most > 0, "C").otherwise("F").alias("grade"))


def _weighed(rows: DataFrame, capabilities: dict[str, tuple[str, ...]], best) -> DataFrame:
    """(node_id, rule, weight): the largest of ``best(capability)`` over a rule's capabilities; a rule without any has 1."""
    weight = lambda asked: F.greatest(lit(0.0), *[best(x) for x in asked]) if asked else lit(1.0)
    return rows.select("node_id", F.inline(F.array(*[F.struct(lit(rule).alias("rule"), weight(asked).alias("weight")) for rule, asked in capabilities.items()])))


def rule_weights(covered: DataFrame, capabilities: dict[str, tuple[str, ...]]) -> DataFrame:
    """(node_id, rule, weight): the best coverage weight among a rule's capabilities, from a coverage table."""
    quality = F.struct("capability", X.quality_weight(F.coalesce("quality", lit("Absent"))).alias("weight"))
    own = covered.groupBy("node_id").agg(F.map_from_entries(F.collect_set(quality)).alias("_w"))
    return _weighed(own, capabilities, lambda x: F.coalesce(F.try_element_at(c("_w"), lit(x)), lit(0.0)))


def inventory_weights(inventory: DataFrame, capabilities: dict[str, tuple[str, ...]]) -> DataFrame:
    """The same weights straight from the inventory, a row per node, with nothing shuffled: a capability's backend is its
    best available one, so its weight is the largest of those that are available."""
    known = inventory_predicates() | {at: available for at, (_, available) in REGISTERED.items()}
    declared = [b[:3] for b in BACKENDS] + [(*at, quality) for at, (quality, _) in REGISTERED.items()]
    one = lambda cap, name, quality: F.when(F.coalesce(known[cap, name], lit(False)), QUALITY_WEIGHTS[quality]).otherwise(0.0)
    best = lambda x: F.greatest(lit(0.0), lit(0.0), *[one(*d) for d in declared if d[0] == x and d[:2] in known])
    return _weighed(inventory, capabilities, best)


def severity_floor(severity: Column, weight: Column, degrade: float = 0.30, critical: float = 0.55) -> Column:
    return F.when(severity == "CRITICAL", critical).when(severity == "DEGRADED", degrade).otherwise(0.0) * weight
