"""What several operators need: packed text, word and n-gram ids, keys, shared storage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end words: space and the controls from tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Python works through a batch in pieces of about this many bytes, so that its arrays stay small.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly; one to one."""
    x = x.astype(np.uint64, copy=True)
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= _MIX
    x ^= x >> np.uint64(32)
    return x


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each begins, with the end at last; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about size bytes; a longer text is alone."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of packed texts: start and end bytes, text number, 64-bit id."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        inside = ~WHITE[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < n]] = False
        first = inside & ~before
        self.start = np.flatnonzero(first)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:] & ~first[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.count = np.diff(np.searchsorted(self.start, at))
        self.text = np.repeat(np.arange(len(at) - 1), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.id = spans_id(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def spans_id(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit ids of the byte strings data[start:end], which ascend, are apart or touch, and are not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    inner = ragged(start, size)
    place = np.arange(len(inner)) - np.repeat(np.cumsum(size) - size, size)
    power = np.full(int(size.max()), _ODD).cumprod(dtype=np.uint64)
    sums = np.add.reduceat((data[inner].astype(np.uint64) + np.uint64(1)) * power[place], np.cumsum(size) - size)
    return mix(sums)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions start..start+size-1 of every run, in a row."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of the values."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    sorted_ = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
    return rank


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over each text's part."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share. Where that is unset a local
    master takes a temporary one; on a cluster it is an error, as executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/provlake"
    return f"{base.rstrip('/')}/provlake-{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: lost executors cost no earlier work."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def mark() -> int:
    """A place in the order of written tables, for forget."""
    return len(_written)


def forget(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables written since the mark, but for the last ones. Only for tables that nothing reads any more."""
    done = _written[since : len(_written) - but]
    del _written[since : len(_written) - but]
    for path in done:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def named(frame: DataFrame, *wanted: str) -> str:
    """A name that no column has, by any case, made from the wanted parts."""
    have = {c.lower() for c in frame.columns}
    name = "_".join(("provlake", *wanted))
    while name.lower() in have:
        name = "_" + name
    return name


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that follows from the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
