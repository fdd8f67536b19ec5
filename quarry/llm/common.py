"""What the operators share: the folder all executors see, written tables, text columns and word hashes."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Broadcast sides stay below these; beyond them the operators shuffle instead.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Bytes of an Arrow batch that Python gets at once, unless the session says otherwise. One row can be longer.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that a worker's memory does not follow the length of texts; a lower bound stays."""
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark takes it to be in, so that Python looks in the same place."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, qualified. Where it is unset, a temporary one if all runs on one machine,
    else an error: a folder of the driver's own would not be seen by the executors."""
    context = spark.sparkContext
    found = context._conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = context.getCheckpointDir()
    return qualified(spark, found).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: cuts lineage and outlives any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect what ended jobs left: their plans, and so their shuffle files on the executors, which Spark
    removes only once the driver has collected the plans. Else both grow over an operator of many jobs."""
    gc.collect()
    spark._jvm.System.gc()


def small(table: DataFrame, width: Column | None = None) -> bool:
    """Whether a written table may be broadcast: rows and, where given, the bytes that `width` sums up are within bounds."""
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(width if width is not None else F.lit(0)), F.lit(0)).alias("bytes")).first()
    return size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the quick way where a text has one byte a character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def record_batches(batch) -> Iterator[tuple]:
    """The rows of an Arrow batch as tuples."""
    yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)


# Hashes by numpy over the bytes of a whole batch of texts.
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads a 64-bit value over all bits; one-to-one."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts: text i is bytes[offsets[i]:offsets[i + 1]]; null counts as empty."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words [^\\x20\\x09-\\x0D]+ of all texts of a buffer, and the number of each text's first word,
    with the number of all words at the end. A word never spans two texts."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= _SPACE[data[:-1]]
    text = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[text] = inside[text]
    ends = inside
    ends[:-1] &= ~inside[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice data[starts[i]:ends[i]]: eight bytes at a time, mixed after each, so that it has no
    algebraic structure which some words would share; long slices by BLAKE2b. Seeds give independent hashes."""
    size = (ends - starts).astype(np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) * _ODD + np.uint64(int(_ODD2) * (2 * seed + 1) % 2**64))
    at = np.flatnonzero(size <= LONG_WORD) if len(size) and size.max() > LONG_WORD else np.arange(len(size))
    done = 0
    while len(at):
        left = size[at] - done
        lane = lanes[starts[at] + done]
        short = left < 8
        if short.any():
            lane = np.where(short, lane & ((np.uint64(1) << (np.uint64(8) * left.clip(0, 7).astype(np.uint64))) - np.uint64(1)), lane)
        out[at] = mix((out[at] ^ lane) * _ODD + _ODD2)
        at = at[left > 8]
        done += 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes; every word is mixed in by itself."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(_ODD2) * k % 2**64, np.uint64)
    for i in range(k):
        out = mix((out ^ words[i : i + n]) * _ODD + _ODD2)
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive bytes; k is a power of two."""
    out, span = mix(data.astype(np.uint64) + _ODD), 1
    while span < k:
        if len(out) <= span:
            return np.zeros(0, np.uint64)
        out = out[:-span] * _ODD + out[span:]
        out ^= out >> np.uint64(29)
        span *= 2
    return mix(out)
