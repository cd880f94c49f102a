"""Shared helpers: the shared scratch folder, table materialisation, UTF-8 columns as numpy arrays."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests) a temporary folder is made, which goes when Python ends; a cluster raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_usagelens_dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="usagelens-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext._usagelens_dir = where
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def clear_scratch(spark: SparkSession) -> None:
    """Removes everything that operators have written below the shared folder. Results that read it must have been written or gathered before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/usagelens")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/usagelens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs a reread only."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def pieces(offsets: np.ndarray, most: int):
    """Runs of whole documents (first, past last) of at most ``most`` bytes; a longer document is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# Polynomial hashing modulo 2^64: an odd base has an inverse, so sums over prefixes can be shifted to a common origin.
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n at least, modulo 2^64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
PIECE = 1 << 20


def _placed(code: np.ndarray) -> np.ndarray:
    """The random number of (place in a word) * 256 + byte."""
    return mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))


_NEAR = _placed(np.arange(1 << 14))


def _terms(part: np.ndarray, place: np.ndarray) -> np.ndarray:
    code = place << 8 | part
    out = _NEAR[np.minimum(code, len(_NEAR) - 1)]
    far = np.flatnonzero(code >= len(_NEAR))
    out[far] = _placed(code[far])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each document, A-Z lower-cased: sums of one random number for each byte at
    each place, so no family of words meets in one hash as under a polynomial modulo 2^64.

    Returns (hash of each word, offset of each document's first word). Works through pieces of about a
    megabyte, cut at white space, so that temporary arrays stay small for texts of any length.
    """
    n, out, begins = len(data), [], []
    a = 0
    edge = np.zeros(n + 1, bool)  # a word can't go on past the end of a document
    edge[offsets] = True
    while a < n:
        b = min(n, a + PIECE)
        if b < n:
            gap = np.flatnonzero(_SPACE[data[a:b]])
            inner = offsets[(offsets > a) & (offsets <= b)]
            cut = max(a + int(gap[-1]) + 1 if len(gap) else 0, int(inner[-1]) if len(inner) else 0)
            if cut <= a:  # a word longer than a piece
                rest = np.flatnonzero(_SPACE[data[b:]])
                cut = min(b + int(rest[0]) if len(rest) else n, int(offsets[np.searchsorted(offsets, b)]))
            b = cut
        part = _LOWER[data[a:b]]
        blank = _SPACE[part]
        start = ~blank
        start[1:] &= blank[:-1] | edge[a + 1 : b]
        s = np.flatnonzero(start)
        stop = ~blank
        stop[:-1] &= blank[1:] | edge[a + 1 : b]
        e = np.flatnonzero(stop) + 1
        begin = np.zeros(b - a, np.int64)
        begin[s] = s
        place = np.arange(b - a) - np.maximum.accumulate(begin)
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_terms(part, place), out=prefix[1:])
        out.append(mix(prefix[e] - prefix[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        begins.append(s + a)
        a = b
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    starts = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return hashes, np.searchsorted(starts, offsets)


def _release() -> None:
    """Gives freed memory back to the system: workers live on after a task, and what they keep is lost to the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """run, a function from batches to batches, giving memory back after each batch that it gives and at its end."""

    def go(batches):
        try:
            for out in run(batches):
                yield out
                del out
                _release()
        finally:
            _release()

    return go


def count_of(rows: DataFrame) -> int:
    return rows.agg(F.count(F.lit(1))).first()[0]
