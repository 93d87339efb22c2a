"""Thresholds of a monitored model, validated once when the object is built."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the statistics.
BINS = 10
CATEGORICAL_LIMIT = 15
KS_ALPHA = 0.01
KS_FLOOR = 0.1
TEMPORAL_SLICES = 3
ROWS_PER_SLICE = 50
MIN_SEGMENT_ROWS = 30
DEFAULT_DECISION_THRESHOLD = 0.5


@dataclass(frozen=True)
class DriftConfig:
    """Bands and guards of one model; the defaults are the published operating point."""

    psi_warn: float = 0.10
    psi_alert: float = 0.25
    pred_warn: float = 0.10
    pred_alert: float = 0.25
    perf_drop_alert: float = 0.05
    min_samples: int = 100
    label_delay_days: int = 0
    retrain_enabled: bool = True
    retrain_dry_run: bool = False
    retrain_min_interval_minutes: int = 60

    def __post_init__(self) -> None:
        if not 0 < self.psi_warn < self.psi_alert:
            raise ValueError(f"need 0 < psi_warn < psi_alert, got {self.psi_warn}, {self.psi_alert}")
        if not 0 < self.pred_warn < self.pred_alert:
            raise ValueError(f"need 0 < pred_warn < pred_alert, got {self.pred_warn}, {self.pred_alert}")
        if not 0 < self.perf_drop_alert < 1:
            raise ValueError(f"need 0 < perf_drop_alert < 1, got {self.perf_drop_alert}")
        if self.min_samples < 1:
            raise ValueError(f"need min_samples >= 1, got {self.min_samples}")
        if self.label_delay_days < 0:
            raise ValueError(f"need label_delay_days >= 0, got {self.label_delay_days}")
