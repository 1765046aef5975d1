"""Token counts by a separator scan of flat token files.

A flat file is ids without any index; only an end-of-document id tells where documents
end. It is read in blocks of fixed size, cut anywhere. Each block is searched for the
separator in one vector operation, which gives the lengths between its separators. What
is open at a block's start is stitched by a prefix scan over block summaries: running
sums of ids and separators and a running maximum of the last separator's position, first
within runs of SCAN blocks, then over the runs, so no window holds a whole large file.

Empty blocks and blocks without separators are passed through; ids after a file's last
separator are an unfinished document and are reported with ``closed`` false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch
from cohortry.llm.words import encoder

#: Ids of a block, and blocks of one run of the scan.
BLOCK, SCAN = 1 << 16, 1024


def write_flat_files(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch, key: str = "doc_id",
                     text: str = "text", dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """Flat files of ids, as (file, block, ids), with the documents whose end lies in each
    block in ``docs`` (a manifest that the scan does not read). One file per partition."""
    kind = docs.schema[key].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    limit = np.iinfo(np.dtype(dtype)).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number = TaskContext.get().partitionId(), 0
        rest, ends = np.zeros(0, dtype), []  # ids not yet in a block, and (position after its end, document)

        def rows(final: bool):
            nonlocal rest, ends, number
            whole = len(rest) // block + (final and len(rest) % block > 0)
            stops = np.array([e[0] for e in ends], np.int64)
            out = []
            for i in range(whole):
                a, b = np.searchsorted(stops, [i * block, (i + 1) * block], "right")
                out.append((number + i, rest[i * block:(i + 1) * block].tobytes(), [e[1] for e in ends[a:b]]))
            done = min(whole * block, len(rest))
            ends = [(p - done, d) for p, d in ends if p > done]
            rest, number = rest[done:], number + whole
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(out), pa.int32()), pa.array([r[0] for r in out], pa.int64()),
                 pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(key_type))],
                names=["file", "block", "ids", "docs"])

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                pieces, at = [rest], len(rest)
                for doc, raw in zip(part.column(0).to_pylist(), encoder(tokenizer, plain_marks=True).encode(texts)):
                    ids = np.frombuffer(raw, "<u4")
                    if len(ids) and int(ids.max()) > limit:
                        raise ValueError("an id does not fit the file's type")
                    pieces += [ids.astype(dtype), np.array([end_id], dtype)]
                    at += len(ids) + 1
                    ends.append((at, doc))
                rest = np.concatenate(pieces)
                if len(rest) >= block:
                    yield rows(False)
        if len(rest):
            yield rows(True)

    return scratch.keep(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"file int, block long, ids binary, docs array<{kind}>"), compression="zstd")


def separator_scan(files: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """One row per document of flat files (file, block, ids): file, block and number ``k`` of
    its separator there, ``ordinal`` in the file, ``start`` in the file, ``n_tokens`` with
    the separator, ``closed``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n, last = [], [], []
            for raw in batch.column(2).to_pylist():
                ids = np.frombuffer(raw or b"", dtype)
                stops = np.flatnonzero(ids == end_id)
                found.append(stops)
                n.append(len(ids))
                last.append(int(stops[-1]) if len(stops) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(last, pa.int64()),
                 pa.array([len(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["file", "block", "n", "last", "seps", "stops"])

    found = Scratch(files.sparkSession).keep(files.select("file", "block", "ids").mapInArrow(
        search, "file int, block long, n long, last long, seps long, stops array<long>"))
    summary = found.select("file", "block", "n", "last", "seps", F.floor(F.col("block") / SCAN).alias("run"))

    def scan(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({"ids0": F.coalesce(F.sum("n").over(w), F.lit(0)),
                                 "seps0": F.coalesce(F.sum("seps").over(w), F.lit(0))})
        return rows.withColumn("last0", F.max(F.col("last") + F.col("ids0")).over(w))

    inner = scan(summary, ["file", "run"], "block")
    runs = inner.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"),
                                            F.max(F.col("last") + F.col("ids0")).alias("last"))
    outer = scan(runs, ["file"], "run").select("file", "run", F.col("ids0").alias("ids1"), F.col("seps0").alias("seps1"),
                                               F.col("last0").alias("last1"))
    placed = inner.join(outer, ["file", "run"]).select(
        "file", "block", (F.col("ids0") + F.col("ids1")).alias("before"), (F.col("seps0") + F.col("seps1")).alias("docs_before"),
        (F.coalesce(F.col("last0") + F.col("ids1"), F.col("last1"), F.lit(-1)) + 1).alias("open"))
    stops = found.select("file", "block", F.posexplode("stops").alias("k", "stop"), "stops")
    stops = stops.withColumn("previous", F.when(F.col("k") > 0, F.element_at("stops", F.col("k"))))
    closed = stops.join(placed, ["file", "block"]).select(
        "file", "block", "k", (F.col("docs_before") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") > 0, F.col("before") + F.col("previous") + 1).otherwise(F.col("open")).alias("start"),
        (F.col("before") + F.col("stop") + 1).alias("end"), F.lit(True).alias("closed"))
    total = runs.groupBy("file").agg(F.sum("n").alias("end"), F.sum("seps").alias("ordinal"))
    ends = outer.join(runs, ["file", "run"]).groupBy("file").agg(
        (F.coalesce(F.max(F.coalesce(F.col("last") + F.col("ids1"), F.col("last1"))), F.lit(-1)) + 1).alias("start"))
    left = total.join(ends, "file").filter("start < end").select(
        "file", F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("k"), "ordinal", "start", "end",
        F.lit(False).alias("closed"))
    return closed.unionByName(left).select("file", "block", "k", "ordinal", "start",
                                           (F.col("end") - F.col("start")).alias("n_tokens"), "closed")
