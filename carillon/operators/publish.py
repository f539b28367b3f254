"""Exports that appear whole or not at all.

The tables of an export are written side by side into a staging folder, counted and summed up while
they are written, checked for rows without a parent, and only then moved to a version's folder in one rename.
A pointer file, replaced in one rename too, names the version that readers take.  Whatever ends a writer
before that leaves the former version as it was; the next export clears what was staged.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .export import orphans

#: What happens where an export is there already: an error, nothing, a new version instead of it, or one beside it.
POLICIES = ("error", "skip", "replace", "versioned")
#: Child table → (its columns, parent table, the parent's columns).
FOREIGN_KEYS = {
    "candidates": [(("recording_id",), "recordings", ("recording_id",))],
    "within_condition_associations": [(("recording_id", "candidate_id"), "candidates", ("recording_id", "candidate_id"))],
    "cross_condition_matches": [
        (("lower_recording_id", "lower_candidate_id"), "candidates", ("recording_id", "candidate_id")),
        (("higher_recording_id", "higher_candidate_id"), "candidates", ("recording_id", "candidate_id")),
    ],
    "candidate_chain_nodes": [(("chain_id",), "candidate_chains", ("chain_id",)), (("recording_id", "candidate_id"), "candidates", ("recording_id", "candidate_id"))],
    "modal_hypotheses": [(("source_chain_id",), "candidate_chains", ("chain_id",))],
}


class _Files:
    """The file system that a root lies in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = at.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(at).toString()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        stream = self.fs.create(self.path(*parts), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        """One rename, over what is there."""
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf)
        context.rename(self.path(*source), self.path(*target), how)

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def _point(files: _Files, version: str) -> None:
    mark = f"_pointer-{uuid.uuid4().hex}"
    files.write(version, mark)
    files.replace((mark,), ("CURRENT",))


def current_version(spark: SparkSession, root: str) -> str | None:
    files = _Files(spark, root)
    return files.read("CURRENT").strip() if "CURRENT" in files.names() else None


def versions(spark: SparkSession, root: str) -> list[str]:
    return [n for n in _Files(spark, root).names() if n.startswith("v") and n[1:].isdigit()]


def missing_parents(tables: dict[str, DataFrame], keys: dict | None = None) -> dict[str, int]:
    """Rows without a parent by ``child(columns)``, where there are any; keys to tables that are not given, or missing ones, count for nothing."""
    found = {}
    for child, rules in (FOREIGN_KEYS if keys is None else keys).items():
        for columns, parent, theirs in rules:
            if child in tables and parent in tables:
                own = tables[child].select(*columns).na.drop()
                n = orphans(own, tables[parent].select(*(F.col(t).alias(c) for t, c in zip(theirs, columns, strict=True))), list(columns)).count()
                if n:
                    found[f"{child}({','.join(columns)})"] = n
    return found


def publish(tables: dict[str, DataFrame], root: str, policy: str = "error", kind: str = "parquet", about: dict | None = None, keys: dict | None = None) -> str | None:
    """The version under which ``tables`` are readable now; nothing where the policy skips.

    A table's manifest has its columns, its rows and an order-free sum, taken while it is written.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    spark = next(iter(tables.values())).sparkSession
    files = _Files(spark, root)
    before = current_version(spark, root)
    if before is not None and policy == "error":
        raise FileExistsError(f"an export is there already: {root}")
    if before is not None and policy == "skip":
        return None
    files.delete("_staging")
    stage = f"_staging/{uuid.uuid4().hex}"
    listed = []
    staged = {}
    for name, table in tables.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        total = F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
        counted = table.observe(seen, F.count(F.lit(1)).alias("row_count"), total.alias("checksum"))
        counted.write.format(kind).option("header", True).save(f"{files.root}/{stage}/{name}")
        listed.append({"table": name, "columns": table.columns} | {k: seen.get.get(k, d) for k, d in (("row_count", 0), ("checksum", "0"))})
        staged[name] = spark.read.schema(table.schema).parquet(f"{files.root}/{stage}/{name}") if kind == "parquet" else table
    lost = missing_parents(staged, keys)
    if lost:
        files.delete("_staging")
        raise ValueError("rows without a parent: " + ", ".join(f"{k}: {n}" for k, n in sorted(lost.items())))
    files.write(json.dumps({"format": kind, "about": about or {}, "tables": listed}, sort_keys=True), stage, "manifest.json")
    version = f"v{max([int(v[1:]) for v in versions(spark, root)], default=0) + 1:06d}"
    if not files.fs.rename(files.path(stage), files.path(version)):
        raise OSError(f"could not move the export to {version}")
    _point(files, version)
    if policy == "replace" and before is not None:
        files.delete(before)
    return version


def manifest_of(spark: SparkSession, root: str, version: str | None = None) -> dict:
    version = version or current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no export at {root}")
    return json.loads(_Files(spark, root).read(version, "manifest.json"))


def published(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of the one named."""
    version = version or current_version(spark, root)
    kind = manifest_of(spark, root, version)["format"]
    return spark.read.format(kind).option("header", True).load(f"{_Files(spark, root).root}/{version}/{table}")


def published_summary(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """table, columns, row_count, checksum, from the manifest alone."""
    rows = [(t["table"], len(t["columns"]), int(t["row_count"]), str(t["checksum"])) for t in manifest_of(spark, root, version)["tables"]]
    return spark.createDataFrame(rows, "table string, columns int, row_count long, checksum string")


def publication_problems(spark: SparkSession, root: str, version: str | None = None) -> list[str]:
    """What of a Parquet version is not as its manifest says."""
    found = []
    for t in manifest_of(spark, root, version)["tables"]:
        table = published(spark, root, t["table"], version)
        if table.columns != t["columns"]:
            found.append(f"{t['table']}: other columns")
            continue
        now = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
        if now.n != t["row_count"]:
            found.append(f"{t['table']}: {now.n} rows, not {t['row_count']}")
        elif now.s != t["checksum"]:
            found.append(f"{t['table']}: other content")
    return found
