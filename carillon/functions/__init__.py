"""Column helpers that every operator shares."""

from .columns import (
    METRIC_BEGINNINGS,
    METRIC_NAMES,
    amplitude_distance,
    close_to,
    cosine_window,
    dbfs,
    frequency_change,
    frequency_distance,
    is_finite,
    le_tol,
    linear_amplitude,
    linear_power,
    mad,
    ratio,
    recognised_metric,
    robust_slope,
    rounded,
    rounded_pairs,
    short_id,
    track_unit,
    variation,
)

__all__ = [
    "METRIC_BEGINNINGS", "METRIC_NAMES", "amplitude_distance", "close_to", "cosine_window", "dbfs", "frequency_change", "frequency_distance", "is_finite", "le_tol", "linear_amplitude",
    "linear_power", "mad", "ratio", "recognised_metric", "robust_slope", "rounded", "rounded_pairs", "short_id", "track_unit", "variation",
]
