"""Pieces that several corpus operators share: durable cuts of lineage, and word hashing in bulk."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every operator here: space, and U+0009 to U+000D.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a character class for Java's and Python's regular expressions.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: the session's spark.checkpoint.dir, or the one that its context was given.
    Where neither is set, a local master, as in tests, gets one in the temp folder; on a cluster that would be a folder of
    one machine, so it raises."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"peakloom-{uuid.uuid4().hex}"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs no more
    than its running tasks. Spark removes the files when the frame is no longer referenced, if
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but as a Parquet table, for wide rows of which later steps read a few columns."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most rows of a few narrow columns that are broadcast.
LIGHT_ROWS = 500_000


def light(df: DataFrame, most: int = LIGHT_ROWS) -> DataFrame:
    """Of a kept frame of few narrow columns: marked for broadcast if it has at most so many rows (some 16 MB of two
    numbers each), so that the other side of a join, which may hold texts, isn't shuffled; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices, so that a task's Python objects are those of a few rows; gives memory back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    pa.default_memory_pool().release_unused()


#: Rows of an Arrow batch. Texts can be megabytes, and each task holds a batch on both sides of its Python worker.
BATCH_ROWS = 1_000


def _narrow(df: DataFrame) -> DataFrame:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS, unless it has a value other than Spark's own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, "10000") == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def map_arrow(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS."""
    return _narrow(df).mapInArrow(work, schema)


def map_pandas(df: DataFrame, work, schema) -> DataFrame:
    """mapInPandas with batches of BATCH_ROWS."""
    return _narrow(df).mapInPandas(work, schema)


def text_of(name: str) -> Column:
    """The column, with null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def crc_fold(name: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))) % F.lit(folds)


# ---------------------------------------------------------------- word hashes without a Python object per word

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS.encode())] = True


_BLOCK = 1 << 22
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; made once, and again only for a longer block."""
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(max(n, 1 << 16), _BASE, np.uint64), np.full(max(n, 1 << 16), _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order. Works in blocks that end at a blank, so that
    memory stays bounded by the longest word and the block."""
    if len(data) > _BLOCK:
        arr, parts, at = np.frombuffer(data, np.uint8), [], 0
        while at < len(data):
            stop = at + _BLOCK
            while stop < len(data) and not _IS_BLANK[arr[stop]]:
                stop += 1
            parts.append(_block_hashes(arr[at:stop]))
            at = stop
        return np.concatenate(parts)
    return _block_hashes(np.frombuffer(data, np.uint8))


def _block_hashes(arr: np.ndarray) -> np.ndarray:
    if not len(arr):
        return np.empty(0, np.uint64)
    blank = _IS_BLANK[arr]
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(arr))
    total = np.empty(len(arr) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[arr] * up[: len(arr)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 bytes whose A-Z are taken as a-z. With fewer
    words than size, the whole sequence is the one shingle; without words the result is empty."""
    w = word_hashes(data.lower())
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        out = (out ^ w[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    if len(w) < size:
        out += np.uint64(len(w))
    return np.unique(mix64(out))
