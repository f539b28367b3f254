"""Token-ID files: Parquet list columns with encodings, row groups and page indexes under control.

``write_token_files`` sorts documents by id, encodes every whole text and writes one row a
document: the id list is delta-packed (or dictionary-encoded), the scalar columns are
delta-packed by the version-2 writer, and small pages give the page index something to
skip by, so a reader of a few documents or of lengths alone touches few pages.
``read_token_files`` gives each document's ids and their place in the whole stream.

Defined results: a null text is an empty one; an empty text has the end id alone; null ids
come first; rows with equal ids are ordered by a hash of their text and repeated rows stay;
a text of any length is one row's list; an empty table gives empty files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty, trimmed
from .tokens import encoder, text_groups

#: Smaller than elsewhere: the task also sorts texts and writes files.
CACHE_CHARS = 4_000_000
FILE_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>"


def with_end(ids: pa.ListArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of the lists, each with the end id put after it."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy()[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    return np.insert(flat, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))


def _encode(path: str, end_id: int):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        coder = encoder(path, CACHE_CHARS)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for i, j in text_groups(texts):
                flat, offsets = with_end(coder.encode(texts[i:j]), end_id)
                n = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(j - i, part, np.int32)),
                        docs[i:j],
                        pa.array(start + offsets[:-1]),
                        pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32))),
                    ],
                    ["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    out: str,
    end_id: int = 0,
    encoding: str = "delta",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 1000,
    compression: str = "snappy",
) -> None:
    """Write ``docs(doc_id, text)`` to Parquet files at ``out`` in ascending ``doc_id`` order.

    encoding: "delta" (ids packed as differences) or "dictionary" (bit-packed against a page of distinct ids).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding must be 'dictionary' or 'delta'")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key = F.xxhash64("text")  # splits rows that share an id, and fixes their order
    placed = rows.withColumn("tie", key).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    coded = placed.select("doc_id", "text").mapInArrow(trimmed(_encode(tokenizer_path, end_id)), FILE_SCHEMA)
    (
        coded.write.option("compression", compression)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.row.count.limit", str(page_rows))
        .parquet(out)
    )


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """part, base: how many ids the parts before it hold.  Reads lengths only, no ids."""
    sums = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with ``doc_ids`` the page index skips other documents' pages."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(token_positions(spark, path), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column(3)
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        offsets = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B")
        sums = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        lengths = pc.list_value_length(ids).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lengths, pa.array(sums, pa.int64())], ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, each from what the files hold."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).select("part", "doc_id", "start_in_part", "ids")
    sums = rows.mapInArrow(trimmed(_checksums), "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    return sums.join(token_positions(spark, path), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_file_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    out = scratch_path(spark, "tokens")
    write_token_files(docs, tokenizer_path, out, end_id=0)
    return token_digest(spark, out)
