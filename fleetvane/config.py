"""Policies: the constants of the operators, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

#: Names of sensors and keys.
SENSORS = ("hp1", "lp1", "hp2", "lp2", "valve", "temphi", "templo")
PRESSURES = ("hp1", "lp1", "hp2", "lp2")
TEMPERATURES = ("temphi", "templo")
GROUP = ("machine_id", "module_id")


@dataclass(frozen=True)
class SequencePolicy:
    """Row filter, resampling and sliding windows at one row a second."""

    #: Limits, tokens and rates that results depend on.
    max_gap: int = 5
    window: int = 60
    step: int = 5
    excluded_modules: tuple[int, ...] = (7,)
    transition_states: tuple[str, ...] = ("ChangeValve", "AdjustValve", "MValveHome")
    normal_status: str = "On"
    smoothing: int = 12

    def __post_init__(self):
        if min(self.max_gap, self.window, self.step, self.smoothing) < 1:
            raise ValueError("gap, window, step and smoothing must be 1 or more")


@dataclass(frozen=True)
class AdaptivePolicy:
    """Dual-profile scoring and bounded adaptation."""

    #: Limits, tokens and rates that results depend on.
    golden_weight: float = 0.5
    rate: float = 0.1
    center_step_mad: float = 0.1
    scale_change: float = 0.1
    threshold_change: float = 0.1
    shrinkage: float = 0.1
    eligible_operational: float = 0.5
    eligible_golden: float = 0.8
    bands: tuple[float, float, float] = (0.5, 1.0, 1.5)
    synthetic_shift_mad: float = 3.0
    reference_alert: float = 0.05
    synthetic_detection: float = 0.8
    synthetic_drop: float = 0.05
    least_windows: int = 200
    least_days: int = 3
    buffer: int = 5000
    shadow_observations: int = 3

    def __post_init__(self):
        if not 0 < self.rate <= 1 or list(self.bands) != sorted(self.bands):
            raise ValueError("rate must be in (0, 1] and bands ascend")


@dataclass(frozen=True)
class MonitorPolicy:
    """Event-time windows, their gates, evidence and persistence."""

    #: Limits, tokens and rates that results depend on.
    window_s: int = 300
    max_gap_s: float = 15.0
    least_points: int = 30
    least_coverage: float = 0.90
    settling_s: float = 120.0
    reset_s: float = 600.0
    pressure: tuple[float, float] = (0.0, 1000.0)
    temperature: tuple[float, float] = (-150.0, 250.0)
    sentinel: float = -200.0
    transition_tokens: tuple[str, ...] = ("changevalve", "adjustvalve", "mvalvehome", "startup", "shutdown")
    running_tokens: tuple[str, ...] = ("on", "run", "running", "2")
    sv_on_tokens: tuple[str, ...] = ("on", "true", "1", "2")
    valve_bins: tuple[float, float, float] = (20.0, 50.0, 80.0)
    entry_z: float = 3.5
    exit_z: float = 2.5
    trend_s: float = 3600.0
    trend_entry: float = -3.0
    trend_exit: float = 2.0
    p1_s: float = 900.0
    p2_s: float = 1800.0
    least_context: int = 25
    least_posterior: float = 0.60
    likelihood_floor: float = -12.0
    least_sequences: int = 3
    error_quantile: float = 0.95

    def __post_init__(self):
        if self.window_s <= 0 or not 0 < self.exit_z <= self.entry_z:
            raise ValueError("window_s must be positive and exit_z at most entry_z")


#: The policy for the benchmark's sparse events: one row in minutes instead of one a second.
SPARSE = MonitorPolicy(window_s=86_400, max_gap_s=21_600.0, least_points=5, least_coverage=0.60, reset_s=172_800.0, trend_s=259_200.0, p1_s=259_200.0, p2_s=518_400.0)
