"""Settings with the default thresholds, and the scaled ones for thin test telemetry."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StateConfig:
    degrade_enter: float = 0.30
    degrade_exit: float = 0.10
    critical_enter: float = 0.55
    critical_exit: float = 0.30
    enter_windows: int = 2
    exit_windows: int = 5
    recover_windows: int = 3
    max_hold_windows: int = 200

    def __post_init__(self):
        if not (self.degrade_exit < self.degrade_enter < self.critical_enter and self.degrade_enter <= self.critical_exit < self.critical_enter):
            raise ValueError("thresholds must be ordered: degrade exit < enter <= critical exit < critical enter")
        if min(self.enter_windows, self.exit_windows, self.recover_windows) < 1:
            raise ValueError("dwell times must be at least one window")


@dataclass(frozen=True)
class Thresholds:
    num_cpus: int = 4
    irq_minimum: int = 10
    irq_pct: float = 70.0
    latency_minimum: int = 10
    latency_baseline_ns: int = 2000
    latency_factor: float = 5.0
    link_budget: int = 5
    link_ceiling: float = 0.05
    slab_minimum: int = 100
    slab_pressure: int = 5000
    trend_streak: int = 3
    z: float = 3.0
    drop_pct: float = 50.0
    napi_minimum: int = 10
    napi_pct: float = 85.0
    stall_minimum: int = 10
    pcie_stalls: int = 5
    pcie_allocs: int = 1000
    stall_ns: int = 50_000
    state: StateConfig = field(default_factory=StateConfig)


#: For the adapter's windows of about ten events.
SCALED = Thresholds(irq_minimum=2, latency_minimum=1, latency_baseline_ns=10_000, slab_minimum=1, slab_pressure=2, napi_minimum=1, stall_minimum=1, pcie_stalls=1, pcie_allocs=1)
