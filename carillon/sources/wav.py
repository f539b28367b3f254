"""WAV files as recordings: RIFF decoding inside Arrow batches over Spark's binary file reader.

Anything that Spark can list is read where it lies; a file that can't be decoded is a row
with its reason, not an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, file_sha256 string, sample_rate_hz int, channels int, subtype string, least_significant_bit double, channel int, samples array<double>, failure string"

#: Format tag and bits → name, NumPy type, full scale, least significant bit.
SUBTYPES = {
    (1, 8): ("PCM_U8", "u1", 128.0, 1.0),
    (1, 16): ("PCM_16", "<i2", 32768.0, 1.0),
    (1, 24): ("PCM_24", None, 8388608.0, 1.0),
    (1, 32): ("PCM_32", "<i4", 2147483648.0, 1.0),
    (3, 32): ("FLOAT", "<f4", 1.0, 0.0),
    (3, 64): ("DOUBLE", "<f8", 1.0, 0.0),
}


class WavFormatError(ValueError):
    """A file that is no WAV file, or of a subtype that is not supported."""


def decode(content: bytes) -> tuple[int, str, float, np.ndarray]:
    """Sample rate, subtype, least significant bit over full scale, samples (channels, n) within ±1."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise WavFormatError("not a RIFF WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = struct.unpack_from("<4sI", content, at)
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE and len(body) >= 26:  # the extensible form names its tag later
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise WavFormatError("no format or no data chunk")
    tag, channels, rate, _, _, bits = form
    if (tag, bits) not in SUBTYPES:
        raise WavFormatError(f"unsupported subtype: tag {tag}, {bits} bits")
    name, kind, scale, lsb = SUBTYPES[tag, bits]
    if name == "PCM_24":
        raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = (raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16).astype(np.float64)
        x -= (raw[:, 2] >= 128) * float(1 << 24)
    else:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(data[: len(data) // size * size], kind).astype(np.float64)
        x = x - 128 if name == "PCM_U8" else x
    x = x[: len(x) // channels * channels].reshape(-1, channels).T / scale
    return rate, name, lsb / scale, x


def encode(samples: np.ndarray, rate: int, bits: int = 16, float_format: bool = False) -> bytes:
    """(channels, n) samples within ±1 as a WAV file."""
    flat = np.atleast_2d(samples).T.reshape(-1)
    if float_format:
        body = flat.astype("<f4" if bits == 32 else "<f8").tobytes()
    else:
        top = float(1 << (bits - 1))
        whole = np.clip(np.round(flat * top), -top, top - 1).astype(np.int64)
        body = {8: lambda: (whole + 128).astype("u1").tobytes(), 16: lambda: whole.astype("<i2").tobytes(), 32: lambda: whole.astype("<i4").tobytes(), 24: lambda: whole.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()}[bits]()
    channels = np.atleast_2d(samples).shape[0]
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3 if float_format else 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + 8 + len(body)) + b"WAVE" + form + struct.pack("<4sI", b"data", len(body)) + body


def _decode(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for path, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rate, subtype, lsb, x = decode(content)
                rows += [(path, digest, rate, len(x), subtype, lsb, c, x[c].tolist(), None) for c in range(len(x))]
            except (WavFormatError, struct.error) as e:
                rows.append((path, digest, None, None, None, None, None, None, str(e)))
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_wav(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """One row a channel of every file under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("digest"), "content").mapInArrow(_decode, SCHEMA)


def select_and_trim(recs: DataFrame, channel: int = 0, polarity: int = 1, start_s: float = 0.0, end_s: float | None = None, longest_s: float | None = None) -> DataFrame:
    """One channel, flipped if asked for, cut at rounded offsets; an empty cut is a failure."""
    rate = F.col("sample_rate_hz")
    first = F.round(F.lit(start_s) * rate).cast("int")
    last = F.size("samples") if end_s is None else F.least(F.round(F.lit(end_s) * rate).cast("int"), F.size("samples"))
    if longest_s is not None:
        last = F.least(last, first + F.round(F.lit(longest_s) * rate).cast("int"))
    cut = F.transform(F.slice("samples", first + 1, F.greatest(last - first, F.lit(0))), lambda x: x * polarity)
    one = recs.filter((F.col("channel") == channel) | F.col("failure").isNotNull())
    return one.withColumn("samples", cut).withColumn("failure", F.coalesce("failure", F.when(F.size("samples") == 0, "empty after trimming")))


def channel_metrics(recs: DataFrame) -> DataFrame:
    """Peak, rms, DC offset and clipping of each channel, clipping being a sample within one step of full scale."""
    a = F.transform("samples", lambda x: F.abs(x))
    n = F.size("samples")
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x)
    return recs.filter("failure IS NULL").select(
        "path", "channel", F.array_max(a).alias("peak"), F.sqrt(square / n).alias("rms"), (F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / n).alias("dc_offset"), F.exists(a, lambda x: x >= 1 - F.col("least_significant_bit")).alias("clipping")
    )
