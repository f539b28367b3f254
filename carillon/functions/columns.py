"""Scalar and aggregate expressions; missing stays missing, thresholds are inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def close_to(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Relative or absolute closeness."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def le_tol(a: Column, b: Column) -> Column:
    return (a <= b) | close_to(a, b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is 0."""
    return F.when(b != 0, a / b)


def dbfs(x: Column) -> Column:
    """20·log10, -inf for 0."""
    return F.when(x > 0, 20 * F.log10(x)).when(x == 0, F.lit(float("-inf")))


def linear_amplitude(x: Column, unit: Column | str) -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.when(unit == "dbfs", F.pow(F.lit(10.0), x / 20)).otherwise(x)


def linear_power(x: Column, unit: str) -> Column:
    """Power of a linear amplitude, of a level in dB, or of a declared power."""
    return {"amplitude": x * x, "dbfs": F.pow(F.lit(10.0), x / 10), "power": x}[unit]


def frequency_distance(a: Column, b: Column, unit: str = "relative") -> Column:
    """In Hz, relative to the larger one, or in cents."""
    if unit == "hz":
        return F.abs(a - b)
    if unit == "relative":
        return F.abs(a - b) / F.greatest(a, b)
    return F.abs(1200 * F.log2(a / b))


def amplitude_distance(a: Column, b: Column, unit: str = "amplitude") -> Column:
    return F.abs(a - b) / 20 if unit == "dbfs" else ratio(F.abs(a - b), F.greatest(a, b))


def frequency_change(low: Column, high: Column, preserved_hz: float, missing: Column | None = None) -> Column:
    """preserved / shifted_up / shifted_down, or indeterminate where one is missing."""
    change = high - low
    known = F.when(le_tol(F.abs(change), F.lit(preserved_hz)), "preserved").when(change > 0, "shifted_up").when(change < 0, "shifted_down")
    return F.coalesce(known, F.lit("indeterminate"))


def track_unit(unit: Column) -> Column:
    """The canonical name of an amplitude unit; an unknown one is an error."""
    name = F.lower(F.trim(unit))
    return (
        F.when(name.isin("linear", "linear_amplitude", "amplitude"), "linear_amplitude")
        .when(name.isin("db", "dbfs"), "dbfs")
        .otherwise(F.raise_error(F.concat(F.lit("unknown amplitude unit "), F.coalesce(unit, F.lit("null")))))
    )


def cosine_window(n: Column, size: Column) -> Column:
    """Symmetric Hann window."""
    return F.when(size == 1, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(2 * F.pi() * n / (size - 1)))


def variation(x: str) -> Column:
    """Coefficient of variation: population deviation over the mean."""
    return F.when(F.avg(x) != 0, F.stddev_pop(x) / F.abs(F.avg(x)))


def mad(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """Median absolute deviation from the group's median, as ``by`` plus ``name``."""
    centre = df.groupBy(*by).agg(F.median(x).alias("__m"))
    return df.join(centre, by).groupBy(*by).agg(F.median(F.abs(F.col(x) - F.col("__m"))).alias(name))


def robust_slope(y: str, x: str) -> Column:
    """Least-squares slope; missing with fewer than two distinct x."""
    return F.when(F.regr_sxx(y, x) > 0, F.regr_slope(y, x))


def short_id(*parts: Column, bits: str = "sha1") -> Column:
    """16 hex characters of the hash of the parts joined by ``|``."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary")
    return F.substring(F.sha1(text) if bits == "sha1" else F.sha2(text, 256), 1, 16)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that sums in another order compare equal."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_pairs(df: DataFrame, digits: int = 6) -> DataFrame:
    """``rounded`` for tables of very many rows.

    ``F.round`` goes through decimal text; here it does so only for what is almost half way, large or not finite, and all
    else is rounded by arithmetic, to the same double.  The code for it is long, and the JVM compiles no method beyond
    8,000 bytes: ``coalesce`` to more partitions than there are merges none, but rows before it get a method of their own.
    """

    def quick(c: str) -> Column:
        y = F.col(c) * 10.0**digits
        clear = (F.abs(y) < 1e11) & (F.abs(y - F.rint(y)) < 0.4999)  # the product is off by less than 2e-16 of it
        return (F.when(clear, F.rint(y) / 10.0**digits).otherwise(F.round(c, digits)) + F.lit(0.0)).alias(c)

    return df.coalesce(1 << 20).select(*(quick(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Names of condition metrics, and the beginnings of names by region, band and change point.
METRIC_NAMES = (
    "excitation_peak_absolute_amplitude", "excitation_rms_amplitude", "excitation_signal_energy", "excitation_equivalent_level_dbfs", "excitation_crest_factor", "excitation_impulse_duration_s",
    "excitation_attack_duration_s", "excitation_signal_to_background_db", "excitation_clipped_recording_fraction", "excitation_near_clipped_recording_fraction", "excitation_clipped_sample_fraction",
    "excitation_near_clipping_sample_fraction", "global_total_spectral_energy", "global_spectral_centroid_hz", "global_spectral_spread_hz", "global_spectral_rolloff_50_hz", "global_spectral_rolloff_85_hz",
    "global_spectral_rolloff_95_hz", "global_spectral_flatness", "global_spectral_entropy", "global_spectral_crest_factor", "global_significant_peak_count", "global_peak_density_per_hz",
    "global_peak_density_per_octave", "global_median_peak_spacing_hz", "global_tonal_energy_fraction", "global_residual_energy_fraction", "global_occupied_bandwidth_hz", "global_occupied_frequency_fraction",
    "time_energy_db_slope_per_s", "time_spectral_centroid_hz_slope_per_s", "time_spectral_spread_hz_slope_per_s", "time_spectral_flatness_slope_per_s", "time_spectral_entropy_slope_per_s",
    "time_significant_peak_count_slope_per_s", "time_peak_density_per_hz_slope_per_s", "time_tonal_energy_fraction_slope_per_s", "time_residual_energy_fraction_slope_per_s",
    "time_occupied_bandwidth_hz_slope_per_s", "time_change_point_count", "time_temporal_coverage_fraction",
)
METRIC_BEGINNINGS = ("early_", "middle_", "late_", "region_middle_minus_early_", "region_late_minus_early_", "region_late_minus_middle_", "global_band_", "time_band_", "time_first_change_point_")


def recognised_metric(name: Column) -> Column:
    """Whether a name is one of a condition's metrics."""
    return name.isin(*METRIC_NAMES) | name.rlike("^(" + "|".join(METRIC_BEGINNINGS) + ")")
