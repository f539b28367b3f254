"""A training corpus in five stages, each reading what the one before has written.

quality → line dedup → MinHash near-dedup → personal data → packing.  All but the last
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carillon.llm import near_dup, packing, pii, quality, templates
from carillon.llm.common import materialise, table
from carillon.llm.registry import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble predicts as good; it learns from the labelled ones among them."""
    return quality.keep_good(docs, quality.learn_quality(docs, table(spark, sf_dir, "labels")))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates, save for each template's first; near copies of its document keep theirs for the next stage."""
    return templates.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id; of rows equal in id and text one stays."""
    first = near_dup.near_duplicates(docs).filter("first").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    keyed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("__id"), near_dup.text_key().alias("__key"))
    kept = keyed.join(first, keyed["__id"].eqNullSafe(first["__id"]) & (keyed["__key"] == first["__key"]), "left_semi")
    return kept.dropDuplicates(["__id", "__key"]).select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts each span's kind in its place."""
    return pii.redact_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: The classifier's fit, the field's decoding and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
