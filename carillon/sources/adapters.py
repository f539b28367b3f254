"""Recordings, series and candidate references out of plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dynamic labels from soft to loud.
LABELS = ("pp", "p", "mf", "f", "ff")
RATE = 64


def label_of(index):
    return F.element_at(F.array(*map(F.lit, LABELS)), (index + 1).cast("int"))


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label_idx int, dynamic_label string")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a recording: recording_id, label_idx, dynamic_label, sample_rate_hz, samples."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    idx = (F.col("label") % 5).cast("int")
    return e.select(
        F.col("vec_id").alias("recording_id"), idx.alias("label_idx"), label_of(idx).alias("dynamic_label"), F.lit(RATE).alias("sample_rate_hz"), F.col("embedding").cast("array<double>").alias("samples")
    )


def samples(recs: DataFrame) -> DataFrame:
    """The long form: recording_id, label_idx, dynamic_label, n, t_s, x."""
    return recs.select("recording_id", "label_idx", "dynamic_label", "sample_rate_hz", F.posexplode("samples").alias("n", "x")).select(
        "recording_id", "label_idx", "dynamic_label", F.col("n").cast("long").alias("n"), (F.col("n") / F.col("sample_rate_hz")).alias("t_s"), "x"
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(recordings(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series, one a user: recording_id, n, t_s, x, label_idx."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    all_of = Window.partitionBy("user_id")
    types = e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).alias("label_idx"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        e.withColumn("us", us)
        .select(
            F.col("user_id").alias("recording_id"),
            (F.row_number().over(w) - 1).cast("long").alias("n"),
            ((F.col("us") - F.min("us").over(all_of)) / 1e6).alias("t_s"),
            F.col("value").alias("x"),
            "event_type",
        )
        .join(types, "event_type")
        .select("recording_id", "n", "t_s", "x", "label_idx")
    )


def candidate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate references with missing quality values among them."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    return p.select(
        (F.col("p_size") % 5).cast("int").alias("label_idx"),
        F.col("p_brand").alias("recording_id"),
        k.alias("candidate_id"),
        F.col("p_retailprice").alias("frequency_hz"),
        ((k % 11) != 3).alias("accepted"),
        F.when(k % 7 != 0, 0.5 + (k % 13) / 10).alias("tau_s"),
        F.when(k % 5 != 0, (k % 17) / 1000).alias("stability"),
        F.when(k % 9 != 0, 0.9 + (k % 10) / 100).alias("r_squared"),
        F.when(k % 6 != 0, (k % 4) == 1).alias("impact_excited"),
        (0.5 + (k % 6) / 10).alias("coverage"),
    )


#: The same adapters in SQL, as common table expressions.
SIG_SQL = f"""sig AS (SELECT vec_id AS recording_id, (label % 5)::INTEGER AS label_idx, t.i - 1 AS n, (t.i - 1) / {RATE}.0::DOUBLE AS t_s, embedding[t.i]::DOUBLE AS x
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))"""
SER_SQL = """ser AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t_s, value AS x,
  (SELECT count(DISTINCT f.event_type) FROM events f WHERE f.event_type < e.event_type)::INTEGER AS label_idx FROM events e)"""
REF_SQL = """ref AS (SELECT (p_size % 5)::INTEGER AS label_idx, p_brand AS recording_id, p_partkey AS candidate_id, p_retailprice AS frequency_hz, (p_partkey % 11) <> 3 AS accepted,
  CASE WHEN p_partkey % 7 <> 0 THEN 0.5::DOUBLE + (p_partkey % 13) / 10.0::DOUBLE END AS tau_s, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 17) / 1000.0::DOUBLE END AS stability,
  CASE WHEN p_partkey % 9 <> 0 THEN 0.9::DOUBLE + (p_partkey % 10) / 100.0::DOUBLE END AS r_squared, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 4 = 1 END AS impact_excited,
  0.5::DOUBLE + (p_partkey % 6) / 10.0::DOUBLE AS coverage FROM part)"""
