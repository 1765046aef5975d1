"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, in Arrow arrays.

Documents are cut into blocks by size. In a block, token lists are flattened, parent indices
say whose they are, token byte lengths are summed up within each document, and an Acero hash
join on (document, end) finds the ends that both have. ``Table.group_by`` counts the linked id
pairs of the block, Spark adds the blocks' counts. A block keeps its links as numbers into
its own list of pairs, packed by byte planes; the totals of that list come back to it with a
join on the pair. Texts and single links are never shuffled, a task sees one block at a time,
and no table of pairs has to fit in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import Scratch
from cohortry.llm.words import _SHOWN, WordEncoder

#: Bytes of text after which a block ends; one task holds one block, or one longer document.
BLOCK_BYTES = 1 << 20

#: Words whose ids a worker remembers.
REMEMBER = 150_000

_LOADED: dict[tuple[str, str], "Aligner"] = {}


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


class Aligner:
    """Both tokenizers of one worker, and the bytes of their entries as Arrow arrays."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        words = WordEncoder(byte_path, plain_marks=True)
        vocabulary = words.tokenizer.get_vocab(with_added_tokens=True)
        byte_of = {c: b for b, c in _SHOWN.items()}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            entries[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_a = pa.array(entries, pa.large_binary())
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_b = pa.array([_piece_bytes(self.pieces, i) for i in range(self.pieces.get_piece_size())], pa.large_binary())
        most = max(len(self.bytes_a), len(self.bytes_b))
        #: decimal id and the mark after it: 3 * id + 0 for ",", 1 for "|", 2 for ";"
        self.shown = pa.array([f"{i}{mark}" for i in range(most) for mark in ",|;"], pa.large_string())
        # a letter before the space lets the word memory serve the first word too
        samples = ["one two", " x", "\nx", "'s", "", "é  é", "1 "]
        self.words = words
        self.lead = "a" if all(words.encode(["a " + t])[0][4:] == words._whole([" " + t])[0] for t in samples) else ""

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of space + text by the first tokenizer and of text by the second, as lists."""
        skip = 4 * len(self.lead)
        if len(self.words.known) > REMEMBER:
            self.words.known.clear()
            self.words.parts.clear()
        a = [np.frombuffer(x, "<u4")[skip // 4:] for x in self.words.encode([f"{self.lead} {t}" for t in texts])]
        b = [np.array(self.pieces.encode(t), np.int64) for t in texts]
        return _lists(a), _lists(b)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values.astype(np.int32)))


def aligner(byte_path: str, piece_path: str) -> Aligner:
    at = byte_path, piece_path
    if at not in _LOADED:
        _LOADED[at] = Aligner(*at)
    return _LOADED[at]


def _ends(lists: pa.Array, entries: pa.Array) -> tuple[pa.Table, pa.Array]:
    """(document, end, token) of every token, ends counted within the document, and the tokens' bytes."""
    ids, document = pc.list_flatten(lists), pc.list_parent_indices(lists)
    spelled = entries.take(ids)
    running = pc.cumulative_sum(pc.binary_length(spelled).cast(pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running])
    end = pc.subtract(running, before.take(lists.offsets.take(document)))
    return pa.table({"document": document, "end": end, "token": pa.array(np.arange(len(ids)))}), spelled


def _same_bytes(spelled: pa.Array, lists: pa.Array, wanted: list[bytes]) -> np.ndarray:
    data = spelled.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    at = np.frombuffer(spelled.buffers()[1], np.int64)[lists.offsets.to_numpy()] if len(spelled) else np.zeros(len(lists) + 1, int)
    return np.array([bytes(data[i:j]) == w for i, j, w in zip(at[:-1], at[1:], wanted)], bool)


def align_block(own: Aligner, texts: list[str | None]) -> dict:
    """Counts, group digests and links of some texts; see ``align`` for the rules."""
    known = [i for i, t in enumerate(texts) if t]
    a, b = own.encode([texts[i] for i in known])
    (ta, spelled_a), (tb, spelled_b) = _ends(a, own.bytes_a), _ends(b, own.bytes_b)
    wanted = [b" " + texts[i].encode() for i in known]
    good = _same_bytes(spelled_a, a, wanted) & _same_bytes(spelled_b, b, wanted)
    if not good.all():  # a text that one tokenizer rewrites has no tokens
        known = [i for i, g in zip(known, good) if g]
        a, b = a.filter(pa.array(good)), b.filter(pa.array(good))
        (ta, _), (tb, _) = _ends(a, own.bytes_a), _ends(b, own.bytes_b)
    del spelled_a, spelled_b, wanted
    links = ta.join(tb, ["document", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    links = links.sort_by("token").combine_chunks()
    last_a, last_b = (links[c].to_numpy().astype(np.int64) for c in ("token", "token_b"))
    ids_a, ids_b = (pc.list_flatten(x).to_numpy().astype(np.int64) for x in (a, b))
    pairs = pc.dictionary_encode(pa.array(ids_a[last_a] << 32 | ids_b[last_b]))
    codes = pairs.indices
    counts = pa.table({"code": codes}).group_by("code", use_threads=False).aggregate([([], "count_all")])
    n = np.zeros(len(pairs.dictionary), np.int64)
    n[counts["code"].to_numpy()] = counts["count_all"].to_numpy()
    # texts of all groups: A ids, then B ids, each with the mark that follows it
    marked = np.empty(len(ids_a) + len(ids_b), np.int64)
    size_a, size_b = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])
    place_a = np.arange(len(ids_a)) + np.repeat(np.r_[0, last_b[:-1] + 1] if len(last_b) else last_b, size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(last_a + 1, size_b)
    marked[place_a] = ids_a * 3
    marked[place_a[last_a]] += 1
    marked[place_b] = ids_b * 3
    marked[place_b[last_b]] += 2
    shown = own.shown.take(pa.array(marked))
    at = np.frombuffer(shown.buffers()[1], np.int64)[a.offsets.to_numpy() + b.offsets.to_numpy()] if len(marked) else np.zeros(1, int)
    data = memoryview(shown.buffers()[2]) if len(marked) else memoryview(b"")
    out = {"n_a": np.zeros(len(texts), np.int64), "n_b": np.zeros(len(texts), np.int64), "n_links": np.zeros(len(texts), np.int64),
           "groups": [""] * len(texts)}
    if known:
        out["n_a"][known] = np.diff(a.offsets.to_numpy())
        out["n_b"][known] = np.diff(b.offsets.to_numpy())
        out["n_links"][known] = np.bincount(links["document"].to_numpy(), minlength=len(known))
        for i, x, y in zip(known, at[:-1], at[1:]):
            out["groups"][i] = hashlib.sha256(data[x:y - 1]).hexdigest()
    return out | {"codes": codes, "pairs": pairs.dictionary, "counts": n}


def align(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Alignment of every text by a byte-level tokenizer (A) and a piece model (B).

    A encodes space + text and B text, both without special tokens. Groups end where tokens
    of both end; each such end links one A token with one B token. Returns key, n_a, n_b,
    n_groups, n_links, n_best (links whose pair is, in all of ``docs``, the most frequent of
    its B id, ties included), count_sum (their pairs' counts, summed over links) and
    groups_sha256. Null and empty texts, and texts whose tokens do not spell them, have
    zeros and an empty digest. Each row counts, also repeated ones and those without a key;
    other columns are not read; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    key_type = docs.schema[key].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0

        def row(keys, texts, kind):
            found = align_block(own, texts)
            lists = [pa.array(keys, kind), *(found[c] for c in ("n_a", "n_b", "n_links", "groups", "pairs", "counts"))]
            lists = [pa.array(x) if not isinstance(x, pa.Array) else x for x in lists]
            codes = zstandard.compress(found["codes"].to_numpy().astype("<u4").view("<u1").reshape(-1, 4).T.tobytes(), 1)
            return pa.record_batch([pa.array([part << 32 | k]), pa.array([codes], pa.binary()),
                                    *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists)],
                                   names=["block", "codes", "keys", "n_a", "n_b", "n_links", "groups", "pairs", "counts"])

        keys, texts, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column("key").type
            sizes = pc.binary_length(batch.column("text")).fill_null(0).to_pylist()
            for one, text, size in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), sizes):
                if texts and held + size > block_bytes:
                    yield row(keys, texts, kind)
                    keys, texts, held, k = [], [], 0, k + 1
                keys.append(one)
                texts.append(text)
                held += size
        if texts:
            yield row(keys, texts, kind)

    longs = T.ArrayType(T.LongType())
    fields = [("block", T.LongType()), ("codes", T.BinaryType()), ("keys", T.ArrayType(key_type)), ("n_a", longs), ("n_b", longs),
              ("n_links", longs), ("groups", T.ArrayType(T.StringType())), ("pairs", longs), ("counts", longs)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    found = scratch.keep(docs.select(F.col(key).alias("key"), "text").mapInArrow(blocks, schema), "zstd")
    totals = scratch.keep(found.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
                          .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("total")))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = totals.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    ranked = scratch.keep(totals.withColumn("b", b_id).join(best, "b")  # the total, doubled, and whether it is the B id's highest
                          .select("pair", (F.col("total") * 2 + (F.col("total") == F.col("most")).cast("long")).alias("total")))
    asked = found.select("block", F.posexplode("pairs").alias("code", "pair")).join(ranked, "pair")
    told = asked.groupBy("block").agg(F.collect_list(F.struct("code", "total")).alias("told")).select(
        F.col("block").alias("told_block"), F.col("told.code").alias("code"), F.col("told.total").alias("total"))

    def sums(documents: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The documents of one block, and the totals of its pairs."""
        r, codes = documents.iloc[0], np.zeros(0, np.int64)
        if len(told):
            doubled = np.zeros(len(told["code"].iloc[0]), np.int64)
            doubled[np.asarray(told["code"].iloc[0])] = told["total"].iloc[0]
            planes = np.frombuffer(zstandard.decompress(r["codes"]), "<u1").reshape(4, -1)
            codes = np.ascontiguousarray(planes.T).view("<u4").ravel()
        link = doubled[codes] if len(codes) else codes
        upto = np.cumsum(np.r_[0, r["n_links"]])
        best_upto, count_upto = (np.r_[0, np.cumsum(x)] for x in (link & 1, link >> 1))
        return pd.DataFrame({key: list(r["keys"]), "n_a": r["n_a"], "n_b": r["n_b"], "n_groups": r["n_links"], "n_links": r["n_links"],
                             "n_best": np.diff(best_upto[upto]), "count_sum": np.diff(count_upto[upto]), "groups_sha256": r["groups"]})

    out = T.StructType([T.StructField(key, key_type), *[T.StructField(c, T.LongType()) for c in
                                                       ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])
    return found.drop("pairs", "counts").groupBy("block").cogroup(told.groupBy("told_block")).applyInPandas(sums, out)
