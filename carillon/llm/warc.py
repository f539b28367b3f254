"""WARC files of web pages and a Merkle audit of their replicas.

``write_warc`` writes pages as WARC/1.1 resource records, ``read_warc`` reads files back.
``leaves_of_files`` hashes every record as it stands in its file; the audit builds a tree for
each file: a node is the hash of its ordered offset range and of its children's hashes.
Replicas are compared at the roots; only children of differing nodes are looked at further,
down to the records.  ``fixity`` writes both replicas, reads the files back and audits what
was read.

Files are numbered by a hash of page id and url and hold about a bounded number of records
whatever hosts the pages have (rows that agree in both are in one file); beyond the write only
hashes, lengths and ids are shuffled.

Defined results: null urls and texts are empty ones, line ends in a url are
%0D and %0A; a null page_id is an id of its own;
records of one file are ordered by page_id (nulls first), url and digest, so repeated rows
stand side by side; a record that one replica lacks or has changed is damaged; in a file,
what follows a place where no record begins is not read; a file is unpacked whole by one task, so its
bound is 512 records, however long their texts; texts are strings, so bytes that are no UTF-8 are not kept as they
are by a copy; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, trimmed

FILE_RECORDS = 512
FAN_OUT = 16
#: Fixed by the format.
HEAD = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"
#: A field of our own: the page's id in decimal, empty for a null one.
PAGE_FIELD = "X-Page-Id"


def _field(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def record_text() -> Column:
    """Head and block of a page's record; in a file ``\\r\\n\\r\\n`` follows it."""
    line = F.lit("\r\n")
    md5 = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), _field("url")).cast("binary"))
    name = F.regexp_replace(md5, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(
        F.lit(f"{HEAD}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.replace(F.replace(_field("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit(f"\r\n{PAGE_FIELD}: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(_field("html")).cast("string"), line, line, _field("html"),
    )


def file_number(files: int) -> Column:
    key = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), _field("url")).cast("binary"))
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(files)).cast("int")


def file_count(pages: DataFrame, records: int = FILE_RECORDS) -> int:
    return max(1, -(-pages.count() // records))


def write_warc(pages: DataFrame, path: str, files: int | None = None) -> None:
    """WARC files under ``path/file=N/``, packed with gzip, records in the audit's order."""
    files = files or file_count(pages)
    rows = pages.select(file_number(files).alias("file"), "page_id", "url", record_text().alias("value"))
    ordered = rows.repartition("file").sortWithinPartitions("file", "page_id", F.coalesce("url", F.lit("")), F.sha2(F.col("value").cast("binary"), 256))
    ordered.select("file", "value").write.partitionBy("file").option("lineSep", _END).option("compression", "gzip").text(path)


def copy_warc(spark: SparkSession, path: str, copy: str, change: Callable[[int | None, str], str] = lambda page_id, block: block) -> None:
    """Writes every file of ``path`` again; ``change`` gives the block that stands in a record's place.  No shuffle."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = _unpacked(content)
                out = []
                for a, b, e, head in _records(content):
                    old = content[b:e].decode("utf-8", "replace")
                    new = change(_page_id(head), old)
                    if new == old:
                        out.append(content[a:e].decode("utf-8", "replace"))
                    else:
                        fields = content[a:b].decode("utf-8", "replace")
                        out.append(re.sub(r"(\r\nContent-Length: )[0-9]+(\r\n\r\n)\Z", rf"\g<1>{len(new.encode())}\g<2>", fields) + new)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array(["".join(r + _END for r in out)], pa.string())], ["file", "value"])

    files = _files(spark, path).mapInArrow(trimmed(run), "file int, value string")
    files.write.partitionBy("file").option("lineSep", "\n").option("compression", "gzip").text(copy)


_RECORD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.DOTALL)


def _records(content: bytes):
    """(start, end of the head, end, fields) of each record, up to a place where none begins."""
    at = 0
    while at < len(content):
        m = _RECORD.match(content, at)
        if m is None:
            return
        head = dict(line.partition(b": ")[::2] for line in m[1].split(b"\r\n"))
        size = head.get(b"Content-Length", b"")
        if not size.isdigit():
            return
        end = min(m.end() + int(size), len(content))
        yield at, m.end(), end, head
        at = end + len(_END)


def _page_id(head: dict[bytes, bytes]) -> int | None:
    name = head.get(PAGE_FIELD.encode(), b"")
    return int(name) if re.fullmatch(rb"-?[0-9]{1,19}", name) else None


def _unpacked(content: bytes) -> bytes:
    """A file's bytes; of a damaged packed file what can be unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":  # one member after the other
        reader = zlib.decompressobj(31)
        try:
            out.append(reader.decompress(content))
        except zlib.error:
            break
        content = reader.unused_data
    return b"".join(out)


def _parse(batches):
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            content = _unpacked(content)
            rows = [(a, e - a, h.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), content[b:e]) for a, b, e, h in _records(content)]
            offsets, lengths, urls, blocks = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(urls), pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(urls, pa.string()), pa.array(blocks, pa.binary())], ["file", "offset", "length", "url", "block"])


def _digests(batches):
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            content = _unpacked(content)
            rows = [(_page_id(h), a, e - a, hashlib.sha256(memoryview(content)[a:e]).hexdigest()) for a, _, e, h in _records(content)]
            ids, offsets, lengths, digests = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(ids), pa.int32()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())],
                ["file", "record_no", "page_id", "offset", "length", "digest"],
            )


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("int").alias("file"), "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, url, block of every record of the files that ``write_warc`` wrote."""
    return _files(spark, path).mapInArrow(trimmed(_parse), "file int, offset long, length long, url string, block binary")


def leaves_of_files(spark: SparkSession, path: str) -> DataFrame:
    """file, record_no, page_id, offset, length, digest: one leaf for each record of the files."""
    return _files(spark, path).mapInArrow(trimmed(_digests), "file int, record_no long, page_id long, offset long, length long, digest string")


# ---- trees --------------------------------------------------------------------------


def tree(leaf: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of (file, at, start, stop, hash) from the records up to one root for each file."""
    level = leaf.select("file", F.col("record_no").alias("at"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.col("digest").alias("hash"))
    levels = [level]
    for _ in range(depth):
        level = (
            level.groupBy("file", F.floor(F.col("at") / FAN_OUT).alias("at"))
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("children"))
            .select("file", "at", "start", "stop", F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), F.concat_ws("", "children.hash")).cast("binary"), 256).alias("hash"))
        )
        level = materialise(level, "warc-level")
        levels.append(level)
    return levels


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    """file, at of nodes that the two do not have alike."""
    both = one.select("file", "at", F.col("hash").alias("h1")).join(two.select("file", "at", F.col("hash").alias("h2")), ["file", "at"], "full")
    return both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "at")


def audit(first: list[DataFrame], second: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(file of each differing root), (file, at of each differing record)."""
    roots = _differing(first[-1], second[-1])
    odd = roots
    for one, two in zip(first[-2::-1], second[-2::-1], strict=True):
        parent = odd.select("file", F.col("at").alias("parent"))
        near = [x.withColumn("parent", F.floor(F.col("at") / FAN_OUT)).join(parent, ["file", "parent"], "left_semi") for x in (one, two)]
        odd = _differing(*near)
    return roots.select("file").distinct(), odd


def fixity(pages: DataFrame, records: int = FILE_RECORDS, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """Writes ``pages`` as WARC files and a copy of the files with ``change``, and audits what both hold; see ``fixity_of_files``."""
    spark = pages.sparkSession
    first, second = scratch_path(spark, "warc-first"), scratch_path(spark, "warc-second")
    write_warc(pages, first, file_count(pages, records))
    copy_warc(spark, first, second, change or damaged)
    return fixity_of_files(spark, first, second)


def fixity_of_files(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Every record of the files at ``first`` with its place, hash, whether its file's root agrees, and whether it is damaged at ``second``."""
    one, two = (materialise(leaves_of_files(spark, p), "warc-leaves") for p in (first, second))
    most = one.unionByName(two).agg(F.max("record_no")).first()[0] or 0
    depth, reach = 1, FAN_OUT
    while reach <= most:
        depth, reach = depth + 1, reach * FAN_OUT
    roots, damaged = audit(tree(one, depth), tree(two, depth))
    return (
        one.join(roots.withColumn("odd_root", F.lit(True)), "file", "left")
        .join(damaged.select("file", F.col("at").alias("record_no"), F.lit(True).alias("odd")), ["file", "record_no"], "left")
        .select(
            "page_id", F.col("file").alias("warc_file"), "record_no", "offset", "length", F.col("digest").alias("record_sha256"),
            F.col("odd_root").isNull().alias("root_agrees"), F.col("odd").isNotNull().alias("damaged"),
        )
    )


def damaged(page_id: int | None, block: str) -> str:
    """The query's damage: a wrong first character in some pages, a lost last one in others."""
    if page_id is None:
        return block
    if page_id % 37 == 5:
        return "?" + block[1:]
    return block[:-1] if page_id % 101 == 7 else block


def _sql_leaves(source: str) -> str:
    record = (
        f"'{HEAD}' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || "
        "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) || '>' || chr(13) || chr(10) || "
        f"'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(u, chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || '{PAGE_FIELD}: ' || coalesce(page_id::VARCHAR, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || "
        "'Content-Length: ' || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h"
    )
    return f"""
      SELECT f, page_id, row_number() OVER w - 1 AS record_no, coalesce(sum(n + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, n, d
      FROM (SELECT f, page_id, u, strlen(r)::BIGINT AS n, sha256(r) AS d FROM (
        SELECT page_id, u, {record} AS r, ('0x' || substr(m, 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {FILE_RECORDS}.0)::BIGINT) FROM pages) AS f
        FROM (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h, md5(coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')) AS m FROM {source})))
      WINDOW w AS (PARTITION BY f ORDER BY page_id NULLS FIRST, u, d)"""


FIXITY_SQL = f"""
WITH replica AS (
  SELECT page_id, url, CASE WHEN page_id % 37 = 5 THEN '?' || substr(coalesce(html, ''), 2) WHEN page_id % 101 = 7 THEN substr(html, 1, greatest(length(html) - 1, 0)) ELSE html END AS html FROM pages
), one AS ({_sql_leaves("pages")}), two AS ({_sql_leaves("replica")}), odd AS (
  SELECT coalesce(one.f, two.f) AS f, coalesce(one.record_no, two.record_no) AS record_no, one.d IS DISTINCT FROM two.d AS differs, (one.d IS DISTINCT FROM two.d OR one.off IS DISTINCT FROM two.off) AS apart
  FROM one FULL JOIN two ON one.f = two.f AND one.record_no = two.record_no
), files AS (SELECT f, bool_or(apart) AS apart FROM odd GROUP BY f)
SELECT page_id, one.f::INTEGER AS warc_file, one.record_no, off AS "offset", n AS length, d AS record_sha256, NOT files.apart AS root_agrees, differs AS damaged
FROM one JOIN odd ON odd.f = one.f AND odd.record_no = one.record_no JOIN files ON files.f = one.f
"""
