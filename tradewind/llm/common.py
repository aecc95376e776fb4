"""Helpers that every training-data operator shares."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows in one Arrow batch: long documents must not fill a Python worker.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Before Python work: bound Arrow batches by rows and bytes, as texts may be very long; ship the package."""
    ship_package(spark)
    # The session keeps these bounds, as plans are run after this returns; a lower one of its own is left alone.
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one in local mode alone."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which an execution deletes its shuffle files at its end, rather than whenever the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage and outlives executors. What was
    shuffled for it is deleted at once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that written() gave, once nothing reads it any more."""
    spark = df.sparkSession
    shared = shared_dir(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared).toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; null texts become empty. Other columns, of whatever name, are left out."""
    # No cast where none is needed: equal plans then share one shuffle.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks the held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over unsigned longs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; a longer word is hashed on its own.
PIECE = 1 << 18


@functools.cache
def _polynomial() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte (none for white space), and the powers of an odd factor and of its inverse, modulo 2^64."""
    factor, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values[SPACE] = 0
    powers = [np.cumprod(np.r_[np.uint64(1), np.full(PIECE - 1, x, np.uint64)], dtype=np.uint64) for x in (factor, inverse)]
    return values, *powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and where each starts (one more at the end)."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of a batch of texts starts among the bytes, the number of the first word of each text (one more
    at the end), and the bytes."""
    raw, at = text_bytes(texts)
    gap = SPACE[raw]
    before = np.empty(len(raw), bool)
    before[1:] = gap[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(before & ~gap)
    return starts, np.searchsorted(starts, at), raw


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' 64-bit hashes, then as from word_starts. Equal words have equal hashes anywhere; lower: so do A-Z and a-z."""
    starts, first, raw = word_starts(texts)
    values, powers, inverse = _polynomial()
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    out = np.empty(len(starts), np.uint64)
    ends = np.r_[starts[1:], len(raw)]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        piece = raw[starts[i] : ends[j - 1]]
        if len(piece) > PIECE:
            # One word with what follows it: cut into runs of PIECE bytes, whose hashes are hashed again.
            word = values[piece[: np.argmax(np.r_[SPACE[piece], True])]]
            runs = [(word[k : k + PIECE] * powers[: len(word[k : k + PIECE])]).sum(dtype=np.uint64) for k in range(0, len(word), PIECE)]
            out[i] = (mix64(np.array(runs, np.uint64)) * powers[: len(runs)]).sum(dtype=np.uint64) if len(runs) > 1 else runs[0]
        else:
            local = starts[i:j] - starts[i]
            out[i:j] = np.add.reduceat(values[piece] * powers[: len(piece)], local) * inverse[local]
        i = j
    return mix64(out), starts, first, raw


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = mix64(g + h[i : i + n]) if i % 4 == 3 else (g + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
    return mix64(g)
