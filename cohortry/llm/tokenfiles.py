"""Token-id output: documents in key order, as files of range-coded blocks, and back.

A file is one partition of the key-sorted documents. Its rows are blocks: the coded
bytes, the ids before the block in its file, and the segments of documents it holds.
Files are written by Spark's own committed writer, so a lost task leaves no half file.

Null and empty texts are the end id alone. Rows with equal keys are ordered by text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch
from cohortry.llm.rangecoder import BLOCK, decode_block, encode_block, join_crc32
from cohortry.llm.words import encoder

_ROWS = "file int, block int, first long, ids binary, first_doc long, keys array<{kind}>, lengths array<long>"


def _writer(kind: str, tokenizer: str, end_id: int, vocabulary: int):
    end = int(end_id).to_bytes(4, "little")
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        parts: list[bytes] = []
        keys, lengths, held = [], [], 0
        first, block, doc = 0, 0, 0  # ids before the block, its number, number of its first document

        def flush():
            nonlocal parts, keys, lengths, held, first, block, doc
            coded = encode_block(np.frombuffer(b"".join(parts), "<u4"), vocabulary)
            row = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([coded], pa.binary()), pa.array([doc], pa.int64()),
                 pa.array([keys], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int64()))],
                names=["file", "block", "first", "ids", "first_doc", "keys", "lengths"])
            first, block, doc = first + held, block + 1, doc + len(keys)
            parts, keys, lengths, held = [], [], [], 0
            return row

        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), encoder(tokenizer).encode(texts)):
                    ids += end
                    while len(ids) // 4 > BLOCK - held:  # the document goes on in the next block
                        cut = BLOCK - held
                        if cut:
                            parts.append(ids[:4 * cut])
                            keys.append(key)
                            lengths.append(cut)
                            held, ids = BLOCK, ids[4 * cut:]
                        yield flush()
                        if cut:
                            doc -= 1  # its rest belongs to the same document
                    parts.append(ids)
                    keys.append(key)
                    lengths.append(len(ids) // 4)
                    held += len(ids) // 4
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, scratch: Scratch, key: str = "doc_id",
                      text: str = "text", end_id: int = 0) -> DataFrame:
    """The written files as a table of blocks."""
    kind = docs.schema[key].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text"))
    return scratch.keep(ordered.mapInArrow(_writer(kind, tokenizer, end_id, vocabulary), _ROWS.format(kind=kind)),
                        compression="none")


def read_token_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key, start, n_tokens, ids_crc32, all from the decoded files."""
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = decode_block(r["ids"]).tobytes()
                lengths = np.array(r["lengths"], np.int64)
                at = np.cumsum(lengths) - lengths
                if int(lengths.sum()) * 4 != len(raw):
                    raise ValueError("the segments do not fill the block")
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist())]
                size = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]] * size, pa.int32()), pa.array(r["first_doc"] + np.arange(size)),
                     pa.array(r["keys"], batch.schema.field("keys").type.value_type),
                     pa.array([r["block"]] * size, pa.int32()), pa.array(r["first"] + at), pa.array(lengths),
                     pa.array(crc, pa.int64())],
                    names=["file", "doc", "doc_id", "block", "first", "n", "crc"])

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for doc in parts:
            crc = 0
            for p in () if doc is None else doc:
                crc = join_crc32(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    segments = files.mapInArrow(run, f"file int, doc long, doc_id {kind}, block int, first long, n long, crc long")
    docs = segments.groupBy("file", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"),
        F.count("*").alias("pieces"), F.min("crc").alias("crc"),
        F.sort_array(F.collect_list(F.struct("block", "crc", "n"))).alias("parts"))
    # sizes of the files, one row each, give the ids before a file
    sizes = files.select("file", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = sizes.groupBy("file").agg(F.sum("n").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("before"))
    crc = F.when(F.col("pieces") == 1, F.col("crc")).otherwise(
        joined(F.when(F.col("pieces") > 1, F.col("parts"))))  # Spark runs it for every row: others bring no parts
    return docs.join(before, "file").select(
        F.col("doc_id").alias(key), (F.col("before") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32"))
