"""Shared helpers: tables, the shared scratch folder, hashing of words in whole batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortry.session import scratch_dir

#: Bytes of text that one numpy pass works on; bounds the temporary arrays of a task.
SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the shared folder that belong to one operator call.

    ``keep`` writes a frame and reads it back: lineage ends in files every executor can
    read, so a lost executor costs no earlier work. ``drop`` removes tables nothing
    reads any more; the last tables stay, since the returned frame reads them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/cohortry/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._hold = getattr(self, "_hold", []) + [out]
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every white-space separated word, and the first word of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~WHITE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts[cuts > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word; A-Z counts as a-z when ``lower``."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    symbols = _BYTE[LOWER] if lower else _BYTE
    powers = _powers(int((ends - starts).max()), 0x9FB21C651E98DF25)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        lens = ends[i:j] - starts[i:j]
        at = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(at, lens)
        values = symbols[data[within + np.repeat(starts[i:j], lens)]] * powers[within]
        out[i:j] = np.add.reduceat(values, at)
        i = j
    return mix64(out)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles.

    Fewer than k words make one shingle of them all; no words make an empty set.
    """
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        part = data[offsets[row]:offsets[stop]]
        starts, ends, first = word_bounds(part, offsets[row:stop + 1] - offsets[row])
        words = word_hashes(part, starts, ends)
        places = [np.uint64(0xC2B2AE3D27D4EB4F * (2 * i + 1) & (2**64 - 1)) for i in range(k)]
        n = len(words) - k + 1
        whole = np.zeros(max(n, 0), np.uint64)
        for i, c in enumerate(places):
            if n > 0:
                whole += mix64(words[i:i + n] * c)
        whole = mix64(whole)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(whole[a:b - k + 1])
            elif b > a:
                short = int(b - a)
                for i, w in enumerate(words[a:b]):
                    short += int(mix64(np.array([w]) * places[i])[0])
                yield mix64(np.array([short & (2**64 - 1)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        row = stop


def signature(values: np.ndarray) -> int:
    """Signed 64-bit signature of a set of hashes, equal for equal sets."""
    with np.errstate(over="ignore"):
        total = mix64(values).sum(dtype=np.uint64) + np.uint64(len(values)) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])
