"""Line dedup: two Bloom filters find the lines that may repeat, only those are shuffled.

Every task folds the line keys of its documents into two filters over the same bits: keys
seen in one document, and keys seen in two. Merging keeps that meaning: a key that two tasks
saw once each has all its bits in both, so it enters the second filter. Filters travel as
compressed segments and are merged by segment, one pass over the arriving rows with two
small arrays a segment. The second filter misses no repeated key, so lines outside it are
unique and stay where they are; the others are grouped by their whole key, which settles
false positives and finds the smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import Scratch, mix64

#: Shorter keys (in code points) never count as repeated.
LEAST_CHARACTERS = 10
#: Bits of a filter for each line of the input, before rounding up to a power of two.
BITS_PER_LINE = 8
#: Largest filter: 2^29 bits are 64 MB, which bounds what is broadcast. Beyond it more lines
#: are suspected and shuffled; the result stays the same. A large cluster may pass more.
MOST_BITS = 29
#: Bits of one segment.
SEGMENT = 17

_SPACE = " \t\n\x0b\x0c\r"


def line_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, line number and key of every line whose key is long enough."""
    texts = column.cast(pa.large_string()).fill_null("")
    lines = pc.split_pattern(texts, "\n")
    keys = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(lines), characters=_SPACE))
    row = pc.list_parent_indices(lines).to_numpy()
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    long = pc.greater_equal(pc.utf8_length(keys), LEAST_CHARACTERS)
    at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    return row[at], number[at], keys.take(pa.array(at))


def _hashes(keys: pa.Array) -> np.ndarray:
    data = keys.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))


class Pair:
    """The filters of keys seen in one document and in two; two bits a key."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return (hashes >> shift).astype(np.int64), (mix64(hashes.copy()) >> shift).astype(np.int64)

    @staticmethod
    def put(bitmap: np.ndarray, places: np.ndarray) -> None:
        np.bitwise_or.at(bitmap, places >> 3, (1 << (places & 7)).astype(np.uint8))

    @staticmethod
    def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1

    def add(self, rows: np.ndarray, hashes: np.ndarray) -> None:
        """Keys of some documents; a key that one document repeats counts once."""
        order = np.lexsort((rows, hashes))
        rows, hashes = rows[order], hashes[order]
        other = np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])] if len(hashes) else np.zeros(0, bool)
        found, counts = np.unique(hashes[other], return_counts=True)
        a, b = self.places(found)
        again = (counts > 1) | (self.has(self.once, a) & self.has(self.once, b))
        for places in (a, b):
            self.put(self.twice, places[again])
            self.put(self.once, places)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        return self.has(self.twice, a) & self.has(self.twice, b)


def build_filter(texts: DataFrame, most_bits: int = MOST_BITS) -> Pair:
    """The merged filters of all documents of ``texts`` (text).

    The number of bits follows the number of lines, which a count finds first.
    """
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).head()[0] or 0
    bits = min(max(SEGMENT, int(lines * BITS_PER_LINE - 1).bit_length()), max(most_bits, SEGMENT))
    width = 1 << (SEGMENT - 3)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bits)
        for batch in batches:
            row, _, keys = line_keys(batch.column(0))
            pair.add(row, _hashes(keys))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        once, twice = pair.once.reshape(-1, width), pair.twice.reshape(-1, width)
        used = np.flatnonzero(once.any(axis=1))
        for i in range(0, len(used), 256):
            part = used[i:i + 256]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array([squeeze(once[s].tobytes()) for s in part], pa.binary()),
                                   pa.array([squeeze(twice[s].tobytes()) for s in part], pa.binary())],
                                  names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = np.frombuffer(expand(once), np.uint8), np.frombuffer(expand(twice), np.uint8)
                if segment in segments:
                    all_once, all_twice = segments[segment]
                    all_twice |= twice | (all_once & once)
                    all_once |= once
                else:
                    segments[segment] = once.copy(), twice.copy()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for segment, (_, twice) in segments.items():
            if twice.any():
                yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([squeeze(twice.tobytes())], pa.binary())],
                                      names=["segment", "twice"])

    parts = texts.select("text").mapInArrow(fold, "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(merge, "segment int, twice binary")
    pair = Pair(bits)
    pair.once = None  # only the second filter is asked from here on
    expand = zstandard.ZstdDecompressor().decompress
    for found in merged.collect():  # 64 MB at most
        pair.twice[found.segment * width:][:width] = np.frombuffer(expand(found.twice), np.uint8)
    return pair


def _row_key(key: str) -> Column:
    """One value for equal rows (key, text); rows that share it also share their result."""
    named = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    return F.unhex(F.md5(F.concat(named, F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary")))


def repeated_lines(docs: DataFrame, scratch: Scratch, key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """(row_key, lines): for each row of ``docs`` that loses lines, their numbers from 0."""
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(build_filter(docs, most_bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = twice.value
        for batch in batches:
            row, number, keys = line_keys(batch.column("text"))
            at = np.flatnonzero(pair.suspects(_hashes(keys)))
            rows = pa.array(row[at])
            yield pa.record_batch([batch.column("row_key").take(rows), batch.column("document").take(rows),
                                   pa.array(number[at], pa.int32()), keys.take(pa.array(at))],
                                  schema=pa.schema([("row_key", batch.schema.field("row_key").type),
                                                    ("document", batch.schema.field("document").type),
                                                    ("line", pa.int32()), ("line_key", pa.large_string())]))

    keyed = docs.select(_row_key(key).alias("row_key"), F.col(key).alias("document"), "text")
    schema = T.StructType([*keyed.schema.fields[:2], T.StructField("line", T.IntegerType()), T.StructField("line_key", T.StringType())])
    suspects = scratch.keep(keyed.mapInArrow(probe, schema))
    # rows without a key are one document, the last one
    groups = suspects.groupBy("line_key").agg(F.min("document").alias("first"), F.max("document").alias("last"),
                                              F.count("document").alias("named"), F.count("*").alias("n"))
    repeated = scratch.keep(groups.filter("first < last or (named between 1 and n - 1)").select("line_key", "first"))
    lost = suspects.join(repeated, "line_key").filter(~F.col("document").eqNullSafe(F.col("first")))
    return scratch.keep(lost.groupBy("row_key").agg(F.array_sort(F.collect_set("line")).alias("lines")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with repeated lines kept only in the document of the smallest key, and n_lines, n_dropped.

    Lines are cut at line feeds. A line's key is the line without outer white space and
    with A-Z in lower case; keys of fewer than 10 code points never repeat. Repeats within
    one document stay. Null and empty texts are one empty line and come back empty. Rows
    that share a key of ``docs`` are one document, and so are all rows without one, which
    comes last. Other columns pass through; columns named n_lines or n_dropped are replaced.
    No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    lines = repeated_lines(docs.select(key, "text"), scratch, key, most_bits)

    @F.pandas_udf("string")
    def without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, dropped):
            if text is None or numbers is None:
                out.append(text)
                continue
            parts = np.array(text.split("\n"), object)
            keep = np.ones(len(parts), bool)
            keep[numbers] = False
            out.append("\n".join(parts[keep]))
        return pd.Series(out, dtype=object)

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(key).alias("row_key")).join(
        lines, "row_key", "left")
    text = F.coalesce("row.text", F.lit(""))
    kept = F.coalesce(without(F.when(F.col("lines").isNotNull(), text), F.col("lines")), text)
    others = [kept.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns
              if c not in ("n_lines", "n_dropped")]
    return found.select(*others, (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"))


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number
  FROM documents),
keyed AS (
  SELECT doc_id, line, number,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
repeated AS (
  SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE r.first_id IS NOT NULL AND r.first_id <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.number)
                       FILTER (WHERE r.first_id IS NULL OR r.first_id = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN repeated r ON k.line_key = r.line_key
GROUP BY k.doc_id
"""
