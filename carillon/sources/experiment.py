"""Experiment definitions: configuration files and checks on the recordings they name."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adapters import LABELS

#: Sections of a configuration.
SECTIONS = ("experiment", "recordings", "pipeline")


def load_configuration(path: str) -> dict:
    """JSON or TOML by the file's ending; unknown sections are an error."""
    text = Path(path).read_text()
    config = json.loads(text) if path.endswith(".json") else tomllib.loads(text)
    if unknown := sorted(set(config) - set(SECTIONS)):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    return config


def merged(*configs: dict) -> dict:
    """Later mappings over earlier ones, nested mappings by key."""
    out: dict = {}
    for config in configs:
        for key, value in config.items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def recording_spec(spec: str) -> tuple[str, str | None, str]:
    """LABEL=PATH or LABEL:TAKE=PATH."""
    m = re.fullmatch(r"([^:=]+)(?::([^=]+))?=(.+)", spec)
    if m is None or m[1] not in LABELS:
        raise ValueError(f"no recording specification: {spec}")
    return m[1], m[2], m[3]


def problems(recordings: DataFrame) -> DataFrame:
    """recording_id, reason: repeated ids and paths, unknown labels, rates that differ, recordings that are too short.

    recordings: recording_id, path, dynamic_label, sample_rate_hz, duration_s, minimum_s.
    """
    r = recordings
    several = lambda c: r.groupBy(c).agg(F.count("*").alias("k")).filter("k > 1").select(c)
    usual = r.groupBy("sample_rate_hz").count().orderBy(F.desc("count"), "sample_rate_hz").limit(1).select(F.col("sample_rate_hz").alias("usual"))
    found = [
        r.join(several("recording_id"), "recording_id", "left_semi").select("recording_id", F.lit("duplicate_recording_id").alias("reason")),
        r.join(several("path"), "path", "left_semi").select("recording_id", F.lit("duplicate_path").alias("reason")),
        r.filter(~F.coalesce(F.col("dynamic_label").isin(*LABELS), F.lit(False))).select("recording_id", F.lit("unknown_dynamic_label").alias("reason")),
        r.join(F.broadcast(usual)).filter(F.col("sample_rate_hz") != F.col("usual")).select("recording_id", F.lit("sample_rate_differs").alias("reason")),  # one row
        r.filter(F.col("duration_s") < F.col("minimum_s")).select("recording_id", F.lit("too_short").alias("reason")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def serialised(config: dict) -> str:
    """Canonical JSON of a configuration."""
    return json.dumps(config, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def _toml_value(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml_value, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else repr(value)


def write_configuration(path: str, config: dict) -> None:
    """JSON or TOML by the file's ending; a missing value has no place in TOML and is left out."""
    if path.endswith(".json"):
        Path(path).write_text(serialised(config))
        return
    lines: list[str] = []
    for section, value in config.items():
        for table in value if isinstance(value, list) else [value]:
            lines.append(f"[[{section}]]" if isinstance(value, list) else f"[{section}]")
            lines += [f"{k} = {_toml_value(v)}" for k, v in table.items() if v is not None]
            lines.append("")
    Path(path).write_text("\n".join(lines))
