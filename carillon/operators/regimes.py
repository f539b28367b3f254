"""Response regimes: a catalogue of weighted criteria scored against each condition's metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Descriptor, criterion, metric, operator, threshold (and upper bound), whether density-weighted.
CRITERIA = (
    ("line_dominated", "line_flatness_low", "global_spectral_flatness", "<=", 0.25, None, False),
    ("line_dominated", "line_entropy_low", "global_spectral_entropy", "<=", 0.55, None, False),
    ("line_dominated", "line_tonal_fraction_high", "global_tonal_energy_fraction", ">=", 0.65, None, False),
    ("line_dominated", "line_spectral_crest_high", "global_spectral_crest_factor", ">=", 5.0, None, False),
    ("line_dominated", "line_peak_density_sparse", "global_peak_density_per_hz", "<=", 0.010, None, True),
    ("line_dominated", "line_occupied_fraction_narrow", "global_occupied_frequency_fraction", "<=", 0.35, None, False),
    ("broadband", "broadband_flatness_high", "global_spectral_flatness", ">=", 0.55, None, False),
    ("broadband", "broadband_entropy_high", "global_spectral_entropy", ">=", 0.75, None, False),
    ("broadband", "broadband_tonal_fraction_low", "global_tonal_energy_fraction", "<=", 0.35, None, False),
    ("broadband", "broadband_residual_fraction_high", "global_residual_energy_fraction", ">=", 0.65, None, False),
    ("broadband", "broadband_occupied_fraction_high", "global_occupied_frequency_fraction", ">=", 0.65, None, False),
    ("broadband", "broadband_spectral_crest_low", "global_spectral_crest_factor", "<=", 3.0, None, False),
    ("broadband", "broadband_peak_density_dense", "global_peak_density_per_hz", ">=", 0.020, None, True),
    ("dense", "dense_peak_density_high", "global_peak_density_per_hz", ">=", 0.020, None, True),
    ("dense", "dense_peak_count_high", "global_significant_peak_count", ">=", 8.0, None, True),
    ("dense", "dense_occupied_fraction_high", "global_occupied_frequency_fraction", ">=", 0.65, None, False),
    ("dense", "dense_tonal_fraction_present", "global_tonal_energy_fraction", ">=", 0.25, None, False),
    ("mixed", "mixed_tonal_fraction_intermediate", "global_tonal_energy_fraction", "between", 0.25, 0.75, False),
    ("mixed", "mixed_residual_fraction_present", "global_residual_energy_fraction", ">=", 0.25, None, False),
    ("mixed", "mixed_flatness_intermediate", "global_spectral_flatness", "between", 0.20, 0.60, False),
    ("mixed", "mixed_density_intermediate_or_dense", "global_peak_density_per_hz", ">=", 0.010, None, False),
    ("broadband_to_tonal", "b2t_flatness_drop", "region_late_minus_early_spectral_flatness", "<=", -0.15, None, False),
    ("broadband_to_tonal", "b2t_entropy_drop", "region_late_minus_early_spectral_entropy", "<=", -0.15, None, False),
    ("broadband_to_tonal", "b2t_tonal_fraction_increase", "region_late_minus_early_tonal_energy_fraction", ">=", 0.20, None, False),
    ("broadband_to_tonal", "b2t_residual_fraction_drop", "region_late_minus_early_residual_energy_fraction", "<=", -0.20, None, False),
    ("broadband_to_tonal", "b2t_change_points", "time_change_point_count", ">=", 1.0, None, False),
    ("broadband_to_tonal", "b2t_density_drop", "region_late_minus_early_peak_density_per_hz", "<=", -0.005, None, True),
    ("tonal_to_broadband", "t2b_flatness_increase", "region_late_minus_early_spectral_flatness", ">=", 0.15, None, False),
    ("tonal_to_broadband", "t2b_entropy_increase", "region_late_minus_early_spectral_entropy", ">=", 0.15, None, False),
    ("tonal_to_broadband", "t2b_tonal_fraction_drop", "region_late_minus_early_tonal_energy_fraction", "<=", -0.20, None, False),
    ("tonal_to_broadband", "t2b_residual_fraction_increase", "region_late_minus_early_residual_energy_fraction", ">=", 0.20, None, False),
    ("tonal_to_broadband", "t2b_density_increase", "region_late_minus_early_peak_density_per_hz", ">=", 0.005, None, True),
    ("densification", "densification_density_increase", "region_late_minus_early_peak_density_per_hz", ">=", 0.005, None, True),
    ("densification", "densification_peak_count_increase", "region_late_minus_early_significant_peak_count", ">=", 1.0, None, True),
    ("sparsification", "sparsification_density_drop", "region_late_minus_early_peak_density_per_hz", "<=", -0.005, None, True),
    ("sparsification", "sparsification_peak_count_drop", "region_late_minus_early_significant_peak_count", "<=", -1.0, None, True),
    ("stable", "stable_flatness_change_small", "region_late_minus_early_spectral_flatness", "abs<=", 0.05, None, False),
    ("stable", "stable_entropy_change_small", "region_late_minus_early_spectral_entropy", "abs<=", 0.05, None, False),
    ("stable", "stable_tonal_fraction_change_small", "region_late_minus_early_tonal_energy_fraction", "abs<=", 0.08, None, False),
    ("stable", "stable_density_change_small", "region_late_minus_early_peak_density_per_hz", "abs<=", 0.003, None, True),
    ("line_identity", "identity_temporal_coverage_high", "time_temporal_coverage_fraction", ">=", 0.50, None, False),
    ("line_identity", "identity_centroid_slope_small", "time_spectral_centroid_hz_slope_per_s", "abs<=", 10.0, None, False),
    ("line_identity", "identity_late_tonal_fraction_high", "late_tonal_energy_fraction", ">=", 0.50, None, False),
    ("line_identity", "identity_valid_repeats", "valid_repeat_count", ">=", 1.0, None, False),
    ("line_identity", "identity_variability_low", "within_condition_coefficient_of_variation", "<=", 0.50, None, False),
    # without a threshold unless one is given
    ("dense", "dense_peak_spacing_low", "global_median_peak_spacing_hz", "<=", None, None, True),
    ("broadband_to_tonal", "b2t_bandwidth_drop", "region_late_minus_early_occupied_bandwidth_hz", "<=", None, None, False),
    ("tonal_to_broadband", "t2b_bandwidth_increase", "region_late_minus_early_occupied_bandwidth_hz", ">=", None, None, False),
    ("densification", "densification_bandwidth_increase", "region_late_minus_early_occupied_bandwidth_hz", ">=", None, None, False),
    ("sparsification", "sparsification_bandwidth_drop", "region_late_minus_early_occupied_bandwidth_hz", "<=", None, None, False),
    ("stable", "stable_bandwidth_change_small", "region_late_minus_early_occupied_bandwidth_hz", "abs<=", None, None, False),
)
_SCHEMA = "descriptor string, criterion string, metric string, op string, threshold double, upper double, density boolean"


def catalogue(spark: SparkSession, thresholds: dict[str, float] | None = None) -> DataFrame:
    """thresholds: other values by criterion."""
    given = thresholds or {}
    return spark.createDataFrame([(d, c, m, o, given.get(c, t), u, w) for d, c, m, o, t, u, w in CRITERIA], _SCHEMA)


def evaluate(metrics: DataFrame, limited: DataFrame | None = None, factor: float = 0.25, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Every criterion against every condition of (label_idx, metric, value); one without a metric or a threshold does not apply.

    limited: labels whose peak spacing is near the resolution; there density criteria weigh ``factor``.
    """
    cat = catalogue(metrics.sparkSession, thresholds)
    # a label's values in one row, so that the metrics are read once and not joined with their own labels
    held = metrics.groupBy("label_idx").agg(F.collect_list(F.struct("metric", "value")).alias("held"))
    rows = held.join(F.broadcast(cat))  # a fixed catalogue for each label
    rows = rows.select("*", F.explode_outer(F.filter("held", lambda m: m.metric == F.col("metric"))).alias("m")).select("*", "m.value").drop("held", "m")
    v, t = F.col("value"), F.col("threshold")
    op = F.col("op")
    passed = (
        F.when(op == "<=", v <= t + 1e-12)
        .when(op == ">=", v >= t - 1e-12)
        .when(op == "abs<=", F.abs(v) <= t + 1e-12)
        .when(op == "abs>=", F.abs(v) >= t - 1e-12)
        .when(op == "==", F.abs(v - t) <= 1e-12)
        .when(op == "present", v.isNotNull())
        .otherwise((v >= t - 1e-12) & (v <= F.col("upper") + 1e-12))
    )
    weight = F.lit(1.0)
    if limited is not None:
        rows = rows.join(F.broadcast(limited.select("label_idx", F.lit(True).alias("limited"))), "label_idx", "left")
        weight = F.when(F.coalesce("limited", F.lit(False)) & F.col("density"), factor).otherwise(1.0)
    return rows.select("label_idx", "descriptor", "criterion", "metric", "value", (v.isNotNull() & (t.isNotNull() | (op == "present"))).alias("applicable"), passed.alias("passed"), weight.alias("weight"))


def score(criteria: DataFrame, support: float = 0.55, opposition: float = 0.45, least: float = 3.0) -> DataFrame:
    s = criteria.groupBy("label_idx", "descriptor").agg(F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)).alias("support"), F.sum(F.when(~F.col("passed"), F.col("weight")).otherwise(0.0)).alias("opposition"))
    total = F.col("support") + F.col("opposition")
    s = s.select("*", total.alias("available"), F.when(total > 0, F.col("support") / total).alias("support_fraction"))
    chosen = (F.col("available") + 1e-12 >= least) & (F.col("support_fraction") + 1e-12 >= support) & (1 - F.col("support_fraction") <= opposition + 1e-12)
    return s.select("*", F.coalesce(chosen, F.lit(False)).alias("selected"))


def describe(scores: DataFrame) -> DataFrame:
    """Structure, course over time and line identity of each condition."""
    on = lambda d: F.coalesce(F.max(F.when(F.col("descriptor") == d, F.col("selected"))), F.lit(False)).alias(d)
    names = sorted({c[0] for c in CRITERIA})
    m = scores.groupBy("label_idx").agg(
        *(on(d) for d in names), F.max(F.when(F.col("descriptor") == "line_identity", F.col("available"))).alias("identity_weight"), F.max(F.when(F.col("descriptor") == "line_identity", F.col("support_fraction"))).alias("identity_support")
    )
    c = F.col
    structure = F.when(c("mixed"), "mixed").when(c("line_dominated") & c("broadband"), "indeterminate").when(c("broadband"), "broadband").when(c("dense"), "dense").when(c("line_dominated"), "line_dominated").otherwise("indeterminate")
    b2t, t2b, dense, sparse = c("broadband_to_tonal"), c("tonal_to_broadband"), c("densification"), c("sparsification")
    course = (
        F.when(b2t & ~t2b, "broadband_to_tonal")
        .when(t2b & ~b2t, "tonal_to_broadband")
        .when(dense & ~sparse, "densification")
        .when(sparse & ~dense, "sparsification")
        .when(c("stable") & ~(b2t | t2b | dense | sparse), "stable")
        .when(b2t | t2b | dense | sparse, "mixed")
        .otherwise("indeterminate")
    )
    identity = F.when(F.coalesce(c("identity_weight"), F.lit(0.0)) == 0, "not_evaluated").when(c("line_identity"), "preserved").when((c("identity_weight") >= 2) & (c("identity_support") >= 0.35), "partially_preserved").otherwise("not_resolved")
    return m.select("label_idx", structure.alias("structure"), course.alias("course"), identity.alias("identity"))


def segments(described: DataFrame, dimension: str) -> DataFrame:
    """Runs of equal descriptors over the labels in order."""
    w = Window.orderBy("label_idx")  # five labels at most
    d = described.select("label_idx", F.col(dimension).alias("descriptor"))
    run = F.row_number().over(w) - F.row_number().over(Window.partitionBy("descriptor").orderBy("label_idx"))
    return d.withColumn("run", run).groupBy("descriptor", "run").agg(F.min("label_idx").alias("start_idx"), F.max("label_idx").alias("end_idx"), F.count("*").alias("conditions")).drop("run")


def limitations(summary: DataFrame, least_repeats: int = 1, least_snr_db: float | None = None, least_coverage: float | None = 0.50, most_missing: float = 0.50, most_variation: float | None = 0.50, reject_clipped: bool = False, need_comparable: bool = False) -> DataFrame:
    """label_idx, limitations: what stands against each condition's evidence, in a fixed order.

    summary: label_idx, valid, valid_repeat_count, clipped_fraction, near_clipped_fraction, snr_db, coverage, incomparable
    (whether any comparability check failed), missing_fraction, max_variation; values may be missing.
    """
    c = F.col
    clipped, near = F.coalesce(c("clipped_fraction"), F.lit(0.0)) > 0, F.coalesce(c("near_clipped_fraction"), F.lit(0.0)) > 0
    tests = [
        (~c("valid"), "condition_summary_invalid"),
        (c("valid_repeat_count") < least_repeats, "insufficient_valid_repeats"),
        (clipped, "spectral_metrics_potentially_distorted_by_clipping"),
        (near & ~clipped, "spectral_metrics_potentially_affected_by_near_clipping"),
        (clipped & F.lit(reject_clipped), "clipped_condition_rejected_by_configuration"),
    ]
    if least_snr_db is not None:
        tests += [(c("snr_db").isNull(), "signal_to_background_unavailable"), (c("snr_db") < least_snr_db, "low_signal_to_background_ratio")]
    if least_coverage is not None:
        tests += [(c("coverage").isNull(), "temporal_coverage_unavailable"), (c("coverage") < least_coverage, "low_valid_temporal_coverage")]
    tests += [
        (c("incomparable"), "comparability_limitations_present"),
        (c("incomparable") & F.lit(need_comparable), "spectral_comparability_required_but_unavailable"),
        (c("missing_fraction") > most_missing, "many_descriptor_metrics_unavailable"),
    ]
    if most_variation is not None:
        tests.append((c("max_variation") > most_variation, "high_within_condition_variability"))
    listed = F.array_compact(F.array(*(F.when(t, name) for t, name in tests)))
    return summary.select("*", listed.alias("limitations"))


def confidence(limited: DataFrame, scores: DataFrame, criteria: DataFrame, support: float = 0.55, high: float = 0.70, most_missing: float = 0.50, reject_clipped: bool = False) -> DataFrame:
    """label_idx, confidence (high, moderate, low, insufficient) from the limitations and the selected descriptors.

    limited: as ``limitations`` gives it, with has_unavailable (whether any metric is missing).
    """
    chosen = scores.filter("selected").select("label_idx", "descriptor", "support_fraction")
    best = chosen.groupBy("label_idx").agg(F.max("support_fraction").alias("best"), F.sum(1 - F.col("support_fraction")).alias("conflicts"))
    gaps = criteria.join(chosen.select("label_idx", "descriptor"), ["label_idx", "descriptor"], "left_semi").groupBy("label_idx").agg(F.avg((~F.col("applicable")).cast("double")).alias("gaps"))
    c = F.col
    has = lambda name: F.array_contains("limitations", name)
    clipped = F.coalesce(c("clipped_fraction"), F.lit(0.0)) > 0
    #: Limitations that rule out moderate confidence.
    heavy = ("spectral_metrics_potentially_distorted_by_clipping", "spectral_metrics_potentially_affected_by_near_clipping", "high_within_condition_variability", "density_metrics_resolution_limited")
    level = (
        F.when(~c("valid") | (clipped & F.lit(reject_clipped)), "insufficient")
        .when(has("low_signal_to_background_ratio") | has("signal_to_background_unavailable") | has("low_valid_temporal_coverage") | has("spectral_metrics_potentially_affected_by_near_clipping"), "low")
        .when(has("spectral_comparability_required_but_unavailable"), "insufficient")
        .when(c("best").isNull(), F.when(c("has_unavailable"), "low").otherwise("insufficient"))
        .when((c("best") >= high) & (F.size("limitations") == 0) & (c("gaps") <= 0.25) & (c("conflicts") <= 0.25), "high")
        .when((c("best") >= support) & (c("gaps") <= most_missing) & ~F.arrays_overlap("limitations", F.array(*map(F.lit, heavy))), "moderate")
        .otherwise("low")
    )
    return limited.join(best, "label_idx", "left").join(gaps, "label_idx", "left").select("label_idx", level.alias("confidence"))


def patterns(described: DataFrame) -> DataFrame:
    """pattern, start_idx, end_idx, conditions: what several conditions of (label_idx, structure, course, confidence) show together."""
    c = F.col
    #: Pattern, the conditions that show it, how many there must be.
    kinds = (
        ("tonal_structure_preserved_over_multiple_conditions", c("structure") == "line_dominated", 2),
        ("increased_density_or_broadband_character_over_dynamic_order", c("structure").isin("dense", "broadband"), 2),
        ("broadband_attack_followed_by_more_tonal_tail", c("course") == "broadband_to_tonal", 1),
        ("increased_uncertainty_or_limited_evidence", c("confidence").isin("low", "insufficient"), 1),
    )
    shown = described.select("label_idx", F.explode(F.array_compact(F.array(*(F.when(t, F.struct(F.lit(n).alias("pattern"), F.lit(k).alias("least"))) for n, t, k in kinds)))).alias("p"))
    g = shown.groupBy("p.pattern", "p.least").agg(F.min("label_idx").alias("start_idx"), F.max("label_idx").alias("end_idx"), F.count("*").alias("conditions"))
    return g.filter("conditions >= least").drop("least")
