"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, exact_topk, exponion, ivf_pq, near_dup, ngram_join, packing, pieces, pii, quality, templates, token_files, warc
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.line_digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.learn_quality(docs, table(spark, sf_dir, "labels")))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf_pq.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4).select("doc_id", "n_shingles", "component_id", "kept")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_query(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster_digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_line_templates": op2_line_templates,
    "op3_quality": op3_quality,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_pieces": op5_pieces,
    "op6_ivf_pq": op6_ivf_pq,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_pii": op8_pii,
    "op9_near_dup": op9_near_dup,
    "op10_token_files": op10_token_files,
    "op11_ngram_join": op11_ngram_join,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_exponion": op13_exponion,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_templates": templates.DIGEST_SQL,
    "op4_exact_top_k": exact_topk.TOP_SQL,
    "op7_warc_fixity": warc.FIXITY_SQL,
    "op9_near_dup": near_dup.LINK_SQL,
    "op11_ngram_join": ngram_join.JOIN_SQL,
    "op12_conversation_repair": conversations.REPAIR_SQL,
    "op13_exponion": exponion.CLUSTER_SQL,
}
