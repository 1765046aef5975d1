"""Best-fit packing into fixed-length sequences, first locally, then by tree merging.

Every task tokenises its documents and packs their pieces by best fit (longest first,
each into the fullest bin it still fits), a window of pieces at a time. Nearly full bins
are final. Underfull bins become items themselves: groups of neighbouring windows merge
them by best fit, level by level up a tree, until one group is left.

After best fit a group holds at most one bin that is half full or less, and bins over
half can only take such small bins. So a group hands up its small bin and its emptiest
KEEP others: more than all small bins it can ever meet on the way up (FAN per level).
The hand-over is bounded and loses no merge.

Null and empty texts are the end id alone. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch
from cohortry.llm.words import encoder

#: Tokens of a sequence; bins with at most SLACK free tokens are final.
LENGTH, SLACK = 2048, 8
#: Pieces packed together in a task; bounds its memory.
WINDOW = 200_000
#: Groups merged per level, and emptiest bins handed up beside the small one.
FAN, KEEP = 8, 512


def best_fit(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds; longest items first."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free_spaces = 0  # bit r: some open bin has r tokens free
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = free_spaces >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free_spaces &= ~(1 << room)
        else:
            room, b = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left = room - size
        if left:
            open_bins[left].append(b)
            free_spaces |= 1 << left
    return bins, offsets, np.array(used, np.int64)


def _pieces(ids: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and crc32 of each piece of one document's ids."""
    for a in range(0, len(ids), 4 * length):
        part = ids[a:a + 4 * length]
        yield a // 4, len(part) // 4, zlib.crc32(part)


def _packed(doc_type: str, tokenizer: str, length: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def flush(rows: list[tuple], window: int) -> pa.RecordBatch:
        bins, offsets, _ = best_fit(np.array([r[3] for r in rows], np.int64), length)
        base = (TaskContext.get().partitionId() << 36) + (window << 24)
        at = pa.array([r[0] for r in rows], pa_type)
        cols = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()), (4, pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [at, *cols, pa.array(bins + base), pa.array(offsets)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset"])

    pa_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[doc_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        window = 0
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(texts)):
                    rows += [(doc, k, a, n, crc) for k, (a, n, crc) in enumerate(_pieces(ids + end, length))]
                if len(rows) >= WINDOW:
                    yield flush(rows, window)
                    rows, window = [], window + 1
        if rows:
            yield flush(rows, window)

    return run


def _merge(length: int, final: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        sizes = frame["used"].to_numpy(np.int64)
        bins, offsets, used = best_fit(sizes, length)
        items = frame["item"].to_numpy()
        parent = np.zeros(len(used), np.int64)
        parent[bins[offsets == 0]] = items[offsets == 0]
        room = length - used
        small = used * 2 <= length
        emptiest = np.zeros(len(used), bool)
        emptiest[np.argsort(-room, kind="stable")[:KEEP]] = True
        carried = (small | emptiest) & (room > SLACK) & (not final)
        return pd.DataFrame({"item": items, "parent": parent[bins], "shift": offsets,
                             "used": used[bins], "carried": carried[bins], "grp": frame["grp"].to_numpy() // FAN})

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[key].dataType.simpleString()
    pieces = scratch.keep(
        docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
        .mapInArrow(_packed(kind, tokenizer, length, end_id),
                    f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long"))
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("used"))
    items = scratch.keep(bins.filter(F.col("used") < length - SLACK)
                         .select(F.col("bin").alias("item"), "used", F.shiftright("bin", 36).alias("grp")))
    groups = items.agg(F.max("grp")).head()[0]
    roots = items.select("item", F.col("item").alias("root"), F.lit(0).cast("long").alias("shift"))
    moved = False
    while groups is not None:
        groups //= FAN
        merged = scratch.keep(
            items.withColumn("grp", F.floor(F.col("grp") / FAN)).groupBy("grp")
            .applyInPandas(_merge(length, groups == 0),
                           "item long, parent long, shift long, used long, carried boolean, grp long"))
        step = merged.filter("item != parent").select(F.col("item").alias("root"), "parent", F.col("shift").alias("more"))
        roots = scratch.keep(roots.join(step, "root", "left").select(
            "item", F.coalesce("parent", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        moved = True
        items = merged.filter("carried and item = parent").select(
            "item", "used", (F.col("grp") * FAN).alias("grp"))
        if groups == 0:
            break
    out = pieces
    if moved:
        changed = roots.filter("item != root").select(F.col("item").alias("bin"), "root", "shift")
        out = pieces.join(changed, "bin", "left")
    else:
        out = pieces.withColumns({"root": F.lit(None).cast("long"), "shift": F.lit(0).cast("long")})
    return out.select(F.col("doc_id").alias(key), "piece", "start", "length", "ids_crc32",
                      F.coalesce("root", "bin").alias("sequence_id"),
                      (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
