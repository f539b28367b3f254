"""Result tables in their published column order, checks on them, and files."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import short_id

#: Columns of the exported tables, in order.
TABLES = {
    name: tuple(columns.split())
    for name, columns in {
        "experiment_summary": """analysis_id experiment_id name status valid requires_review recording_count condition_count candidate_count chain_count hypothesis_count
            parameter_estimate_count q_estimate_count energy_pair_count failure_reason engine_version settings_fingerprint""",
        "recordings": """recording_id experiment_id dynamic_label take_index file_path file_fingerprint sample_rate_hz channel_count selected_channel original_duration_s
            analyzed_duration_s offsets_applied candidate_count accepted_candidate_count valid failure_reason diagnostics""",
        "conditions": """dynamic_label selected_reference_recording_id recording_count valid_recording_count invalid_recording_count candidate_reference_count
            within_condition_cluster_count valid failure_reason diagnostics""",
        "candidates": """recording_id dynamic_label candidate_id source_track_id representative_frequency_hz frequency_stability frequency_drift_hz frequency_fit_rmse_hz amplitude_tau_s
            amplitude_fit_r_squared coverage_fraction accepted impact_excited preimpact_classification ambiguous_assignment_fraction near_threshold_assignment_fraction
            minimum_assignment_margin acceptance_reasons rejection_reasons diagnostics""",
        "within_condition_associations": """dynamic_label association_kind cluster_id recording_id candidate_id source_track_id representative_frequency_hz member_count recording_count
            accepted ambiguous reason minimum_cost_observed diagnostics""",
        "cross_condition_matches": """match_id lower_dynamic_label higher_dynamic_label lower_recording_id lower_candidate_id higher_recording_id higher_candidate_id frequency_change_hz
            frequency_change_relative frequency_change_classification association_cost ambiguous near_threshold accepted diagnostics""",
        "candidate_chains": """chain_id start_dynamic_label end_dynamic_label condition_count match_count complete_across_requested_sequence partial_chain isolated_candidate
            initial_frequency_hz final_frequency_hz total_frequency_change_hz maximum_association_cost contains_ambiguous_match contains_near_threshold_match
            contains_possible_split_context contains_possible_merge_context diagnostics""",
        "candidate_chain_nodes": """chain_id node_index dynamic_label recording_id candidate_id source_track_id representative_frequency_hz incoming_match_id outgoing_match_id
            incoming_association_cost outgoing_association_cost diagnostics""",
        "modal_hypotheses": """hypothesis_id source_chain_id status accepted requires_review score condition_coverage_fraction maximum_step_change_hz mean_match_cost
            mean_tracking_coverage_fraction tau_available_count supporting_reasons reservation_reasons rejection_reasons missing_evidence_reasons diagnostics""",
        "pipeline_stages": """stage status started completed input_ids output_ids dependency_stages supporting_reasons reservation_reasons skipped_reasons blocked_reasons failure_reasons
            insufficient_evidence_reasons diagnostics""",
        "diagnostics": "scope source_id diagnostic_index diagnostic",
    }.items()
}


def in_order(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in published order; ones that are not there are missing values."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in TABLES[table]))


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def content_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """A stable id from the content of each row."""
    return df.select(*columns, short_id(*(F.col(c) for c in columns), bits="sha256").alias("content_id"))


def decimate(points: DataFrame, by: str, block: int) -> DataFrame:
    """The first least and the first largest point of every block of ``block`` points of (by, n, x)."""
    b = points.withColumn("block", F.floor(F.col("n") / block))
    low, high = (b.groupBy(by, "block").agg(F.min(F.struct(x.alias("o"), "n", "x")).alias("p")) for x in (F.col("x"), -F.col("x")))
    return low.unionByName(high).select(by, F.col("p.n").alias("n"), F.col("p.x").alias("x")).distinct()


def cells(df: DataFrame, missing: str = "NA", digits: int = 6) -> DataFrame:
    """Every column as text, with a word for missing values and a fixed precision."""
    shown = [F.coalesce((F.format_string(f"%.{digits}f", F.col(c)) if t == "double" else F.col(c).cast("string")), F.lit(missing)).alias(c) for c, t in df.dtypes]
    return df.select(*shown)


def ranked_replicates(quality: DataFrame) -> DataFrame:
    """The best replicate of each label: highest quality, then lowest id."""
    w = Window.partitionBy("label_idx").orderBy(F.desc("quality"), "recording_id")
    return quality.withColumn("place", F.row_number().over(w)).withColumn("reference", F.col("place") == 1)


def fingerprint(settings) -> str:
    """SHA-256 of settings as canonical JSON."""
    plain = asdict(settings) if is_dataclass(settings) else settings
    return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def write_csv(df: DataFrame, path: str, missing: str = "", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("nullValue", missing).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def to_markdown(df: DataFrame, limit: int = 50) -> str:
    """A preview of at most ``limit`` rows."""
    rows = cells(df).limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(v.replace("|", "\\|") for v in row) + " |" for row in rows]) + "\n"


def to_latex(df: DataFrame, limit: int = 50) -> str:
    """A booktabs preview of at most ``limit`` rows."""
    #: Characters that LaTeX reads as commands.
    escapes = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    safe = lambda s: "".join(escapes.get(c, c) for c in s)
    rows = [" & ".join(map(safe, r)) + r" \\" for r in cells(df).limit(limit).collect()]
    head = " & ".join(map(safe, df.columns)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}"]) + "\n"


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and an order-free checksum of each table."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, df in tables.items():
        one = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("row_count"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("checksum"))
        one = one.select(F.lit(name).alias("table"), "row_count", "checksum")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "table string, row_count long, checksum string")
