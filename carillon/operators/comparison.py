"""Metrics of recordings compared between dynamic conditions, over one long table (label_idx, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_finite, ratio

LEVELS = 5


def aggregate(values: DataFrame) -> DataFrame:
    """Counts, location, spread and median absolute deviation by label and metric; missing and non-finite values are counted and left out."""
    by = ["label_idx", "metric"]
    v = values.withColumn("fine", F.when(is_finite(F.col("value")), F.col("value")))
    v = v.withColumn("middle", F.median("fine").over(Window.partitionBy(*by)))
    return v.groupBy(*by).agg(
        F.count("*").alias("available"), F.count("fine").alias("used"), F.median("fine").alias("median"), F.avg("fine").alias("mean"), F.stddev_pop("fine").alias("std"), F.min("fine").alias("least"), F.max("fine").alias("largest"),
        (F.max("fine") - F.min("fine")).alias("range"), F.when(F.avg("fine") != 0, F.stddev_pop("fine") / F.abs(F.avg("fine"))).alias("variation"), F.median(F.abs(F.col("fine") - F.col("middle"))).alias("mad"),
    )


def _direction(a: Column, b: Column, tolerance: float) -> Column:
    return F.when(a.isNull() | b.isNull(), "unavailable").when(F.abs(b - a) <= tolerance, "unchanged").when(b > a, "increase").otherwise("decrease")


def _compare(pairs: DataFrame, tolerance: float) -> DataFrame:
    a, b = F.col("lower_value"), F.col("higher_value")
    r = F.when((a > 0) & (b >= 0), b / a)
    reason = F.when(F.col("low_here").isNull() | F.col("high_here").isNull(), "metric_missing_in_one_condition").when(a.isNull() | b.isNull(), "representative_value_unavailable")
    return pairs.select(
        "lower_idx", "higher_idx", "metric", "lower_value", "higher_value", (b - a).alias("change"), F.when(F.abs(a) > 1e-12, (b - a) / F.abs(a)).alias("relative_change"), r.alias("ratio"), F.when(r > 0, 20 * F.log10(r)).alias("change_db"),
        F.when(reason == "metric_missing_in_one_condition", "not_comparable").otherwise(_direction(a, b, tolerance)).alias("direction"), reason.alias("not_applicable_reason"), F.abs(ratio(b - a, F.greatest("low_std", "high_std"))).alias("change_to_variability"),
    )


def _side(agg: DataFrame, side: str, column: str) -> DataFrame:
    name = "lower" if side == "low" else "higher"
    return agg.select(F.col("label_idx").alias(f"{name}_idx"), "metric", F.col(column).alias(f"{name}_value"), F.col("std").alias(f"{side}_std"), F.lit(True).alias(f"{side}_here"))


def adjacent_pairs(agg: DataFrame, statistic: str = "median", tolerance: float = 1e-12) -> DataFrame:
    """Every metric of each two neighbouring conditions that are there; one side may lack it."""
    labels = agg.select("label_idx").distinct()
    steps = labels.select(F.col("label_idx").alias("lower_idx"), F.lead("label_idx").over(Window.orderBy("label_idx")).alias("higher_idx")).filter("higher_idx IS NOT NULL")  # five labels at most
    low = steps.join(_side(agg, "low", statistic), "lower_idx")
    high = steps.join(_side(agg, "high", statistic), "higher_idx")
    return _compare(low.join(high, ["lower_idx", "higher_idx", "metric"], "full"), tolerance)


def reference_pairs(agg: DataFrame, reference: int = 0, statistic: str = "median", tolerance: float = 1e-12) -> DataFrame:
    """Every higher condition against the reference condition."""
    high = _side(agg, "high", statistic).filter(F.col("higher_idx") > reference)
    low = _side(agg, "low", statistic).filter(F.col("lower_idx") == reference).drop("lower_idx")
    return _compare(high.join(low, "metric", "left").withColumn("lower_idx", F.lit(reference)), tolerance)


def sequences(agg: DataFrame, statistic: str = "median") -> DataFrame:
    """One row a metric with a slot for each label, missing where there is none."""
    slots = [F.max(F.when(F.col("label_idx") == i, F.col(statistic))).alias(f"level_{i}") for i in range(LEVELS)]
    return agg.groupBy("metric").agg(*slots, F.count(statistic).alias("filled"))


def monotonicity(agg: DataFrame, statistic: str = "median", tolerance: float = 1e-12) -> DataFrame:
    """How each metric's sequence goes over the labels that it has."""
    w = Window.partitionBy("metric").orderBy("label_idx")
    s = agg.filter(F.col(statistic).isNotNull()).select("metric", "label_idx", F.col(statistic).alias("v"), (F.col(statistic) - F.lag(statistic).over(w)).alias("d"))
    m = s.groupBy("metric").agg(
        F.count("*").alias("n"), F.count_if(F.col("d") > tolerance).alias("up"), F.count_if(F.col("d") < -tolerance).alias("down"), F.count_if(F.abs("d") <= tolerance).alias("ties")
    )
    up, down, ties = F.col("up"), F.col("down"), F.col("ties")
    kind = (
        F.when(F.col("n") < 2, "insufficient")
        .when((up == 0) & (down == 0), "constant")
        .when((down == 0) & (ties == 0), "monotonic_increasing")
        .when((up == 0) & (ties == 0), "monotonic_decreasing")
        .when(down == 0, "non_decreasing")
        .when(up == 0, "non_increasing")
        .otherwise("non_monotonic")
    )
    return m.select("metric", "n", "up", "down", "ties", F.least("up", "down").alias("inversions"), kind.alias("kind"))
