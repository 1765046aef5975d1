"""Conversation prefix trie by van Emde Boas recursion.

Every sequence is cut at half its (power of two) depth. The upper half's content and the
prefix above it give the cut prefix its name, and the name is the root of the forest that
the lower half belongs to; both halves are cut again in the same way. All pieces of one
size are one step: blocks of two are named first, then blocks of four and so on (each step
folds half as many rows), and on the way down every piece hands the name of its cut prefix
to its lower half. At size one, pieces are the nodes. Totals are grafted back by size: the
trees of a lower forest hang below one cut prefix, and their sums are added to the nodes of
the upper half above it, which one conversation through the cut prefix lists. A trie of
depth d takes log2(d) such steps, however many conversations it has.

Only 128-bit digests of turns travel, texts stay where they are. Sequences are rows, never
lists, so that one conversation may be as long as it likes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch

#: Conversations are rebuilt in families of this many, on at most ``HEADS - 1`` turns of the first.
FAMILY, HEADS = 5, 9
#: Digits of conversation ids that one row carries to the digest of a node's ends.
CHUNK_BYTES = 1 << 20


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces role and text by 128 bits of their digest and the length of the text."""
    for batch in batches:
        out, sizes = bytearray(), []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            role, text = (role or "").encode(), (text or "").encode()
            out += hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()
            sizes.append(len(text))
        names = np.frombuffer(bytes(out), np.int64).reshape(-1, 2)
        yield pa.record_batch([batch.column("conv"), batch.column("turn"), pa.array(names[:, 0]), pa.array(names[:, 1]),
                               pa.array(sizes, pa.int64())], names=["conv", "turn", "a", "b", "bytes"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each conversation within a sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        place = np.arange(len(conv)) - np.repeat(first, np.diff(np.r_[first, len(conv)]))
        if last is not None and conv[0] == last:
            place[:first[1] if len(first) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.record_batch([batch.column("conv"), pa.array(np.full(len(conv), part), pa.int32()), pa.array(place),
                               *(batch.column(c) for c in ("a", "b", "bytes"))],
                              names=["conv", "part", "place", "a", "b", "bytes"])


def number_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, a, b, bytes): digests of the turns of each conversation, numbered from 0.

    Turns are dealt by ranges and numbered within them; a conversation that spans ranges
    adds what the ranges before hold of it.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", "text").filter("conv is not null")
    turn = rows.schema["turn"].dataType.simpleString()
    turns = scratch.keep(rows.mapInArrow(_digests, f"conv long, turn {turn}, a long, b long, bytes long"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    dealt = turns.repartitionByRange(*order, F.rand(11)).sortWithinPartitions(*order)  # equal rows may part
    kept = scratch.keep(dealt.mapInArrow(_runs, "conv long, part int, place long, a long, b long, bytes long"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", before.alias("before"))
    return kept.join(offsets.filter("before > 0"), ["conv", "part"], "left").select(
        "conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "a", "b", "bytes")


def rebuild(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, length), and their turns (conv, pos, a, b, bytes)."""
    turns = scratch.keep(turns)
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    found = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", head.alias("head"),
                                                                      (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    bases = found.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    own = F.greatest(F.col("n") - F.col("head"), F.lit(0))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = scratch.keep(found.join(bases, "base", "left")
                         .select("conv", "base", "head", taken.alias("taken"), (taken + own).alias("length")))
    heads = turns.filter(F.col("pos") < HEADS - 1).withColumnRenamed("conv", "base").join(convs, "base").filter("pos < head")
    tails = turns.join(convs, "conv").filter("pos >= head").withColumn("pos", F.expr("taken + pos - head"))
    columns = ["conv", "pos", "a", "b", "bytes"]
    return convs.select("conv", "length"), scratch.keep(heads.select(*columns).unionByName(tails.select(*columns)))


def _name(*parts: str) -> list[Column]:
    """128 bits that name a list of names."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5851F42D4C957F2D), *reversed(parts))]


def name_prefixes(turns: DataFrame, convs: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """``turns`` with the node (na, nb) of each prefix that a turn ends and its parent (pa, pb).

    A prefix has one name: it is given by the largest cut that it ends at. Pieces therefore
    know the names of the prefixes before their first and, once given, after their last turn.
    """
    blocks = [turns.select("conv", F.col("pos").alias("block"), "a", "b")]
    size = 1
    while size < height:  # names of blocks of 2, 4, ... turns
        side = lambda odd, c: F.max(F.when(F.col("block") % 2 == odd, F.col(c)))
        halves = blocks[-1].groupBy("conv", F.floor(F.col("block") / 2).alias("block")).agg(
            side(0, "a").alias("la"), side(0, "b").alias("lb"), side(1, "a").alias("ra"), side(1, "b").alias("rb"))
        a, b = _name("la", "lb", "ra", "rb")
        blocks.append(scratch.keep(halves.withColumn("a", a).withColumn("b", b)))
        size *= 2
    a, b = _name("pa", "pb", "a", "b")
    end = F.when(F.col("length") == size, F.struct(a.alias("a"), b.alias("b")))
    above = blocks[-1].join(convs, "conv").select("conv", "block", "length", "a", "b", *[F.lit(0).cast("long").alias(c) for c in ("pa", "pb")])
    above = above.select("conv", "block", "length", "pa", "pb", end.alias("end"))
    for level in reversed(blocks[1:]):  # each piece names its cut prefix and is cut in two
        size //= 2
        a, b = _name("pa", "pb", "la", "lb")
        cut = F.when((F.col("block") * 2 + 1) * size <= F.col("length"), F.struct(a.alias("a"), b.alias("b")))
        piece = above.join(level.drop("a", "b"), ["conv", "block"]).withColumn("cut", cut)
        upper = F.struct((F.col("block") * 2).alias("block"), "pa", "pb", F.coalesce("cut", "end").alias("end"))
        lower = F.when(F.col("ra").isNotNull(), F.struct((F.col("block") * 2 + 1).alias("block"), F.col("cut.a").alias("pa"),
                                                         F.col("cut.b").alias("pb"), "end"))
        above = scratch.keep(piece.select("conv", "length", F.explode(F.array_compact(F.array(upper, lower))).alias("x"))
                             .select("conv", "length", "x.*"))
    named = turns.join(above.withColumnRenamed("block", "pos"), ["conv", "pos"])
    return scratch.keep(named.select("conv", "pos", F.col("end.a").alias("na"), F.col("end.b").alias("nb"), "pa", "pb", "bytes",
                                     F.expr("pos = length - 1").alias("last")))


def graft_totals(nodes: DataFrame, paths: DataFrame, height: int, scratch: Scratch) -> DataFrame:
    """(na, nb, leaves, saved): sums of each node's subtree, the root's under (0, 0)."""
    columns = ["na", "nb", "pa", "pb", "conv", "pos", "leaves", "saved"]
    total = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    parts = nodes.select(*columns)
    size = 2
    while size < 2 * height:
        half = size // 2
        # the trees of the lower halves, summed under the cut prefix they hang from
        trees = parts.filter(F.col("pos") % size == half).groupBy("pa", "pb").agg(
            F.min("conv").alias("conv"), F.min(F.floor(F.col("pos") / size)).alias("block"), *total)
        trees = scratch.keep(trees.select("conv", "block", "leaves", "saved"))
        upper = paths.filter(F.col("pos") % size < half).withColumn("block", F.floor(F.col("pos") / size))
        grafts = upper.join(trees, ["conv", "block"]).groupBy("na", "nb").agg(
            *[F.min(c).alias(c) for c in ("pa", "pb", "conv", "pos")], *total)
        parts = parts.unionByName(scratch.keep(grafts.select(*columns)))
        size *= 2
    top = parts.filter("pos = 0").agg(*total).select(F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), "leaves", "saved")
    return parts.groupBy("na", "nb").agg(*total).unionByName(top.filter("leaves is not null"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node's ends in a sorted partition, joined by commas to rows of bounded size."""
    names = ["na", "nb", "first", "ids"]
    open_row = None  # na, nb, first id, pieces, bytes
    out: list[tuple] = []

    def closed(row):
        return (*row[:3], ",".join(row[3]))

    for batch in batches:
        na, nb, conv = (batch.column(c).to_numpy() for c in ("na", "nb", "conv"))
        if not len(conv):
            continue
        first = np.flatnonzero(np.r_[True, (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])])
        for i, j in zip(first, np.r_[first[1:], len(conv)]):
            for k in range(i, j, 50_000):
                text = ",".join(map(str, conv[k:min(j, k + 50_000)].tolist()))
                if open_row and open_row[:2] == [na[i], nb[i]] and open_row[4] < CHUNK_BYTES:
                    open_row[3].append(text)
                    open_row[4] += len(text)
                else:
                    if open_row:
                        out.append(closed(open_row))
                    open_row = [na[i], nb[i], conv[k], [text], len(text)]
            if len(out) >= 1000 or sum(len(r[3]) for r in out[-3:]) > CHUNK_BYTES:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)
                out = []
    if open_row:
        out.append(closed(open_row))
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the rows of each node in a sorted partition, one row at a time."""
    node, digest, out = None, None, []
    for batch in batches:
        for na, nb, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if node != (na, nb):
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (na, nb), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["na", "nb", "ends"])
            out = []
    if node:
        out.append((*node, digest.hexdigest()))
    if out:
        yield pa.record_batch([pa.array(c) for c in zip(*out)], names=["na", "nb", "ends"])


def hash_ends(ends: DataFrame) -> DataFrame:
    """(na, nb, ends): digest of the ascending ids (conv) of the conversations that end in a node.

    The ids of one node are joined where ranges of them lie; a digest is a chain, so the
    joined rows of a node meet in one task, which reads them one by one.
    """
    order = ["na", "nb", "conv"]
    joined = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "na long, nb long, first long, ids string")
    return joined.repartition("na", "nb").sortWithinPartitions("na", "nb", "first").mapInArrow(_hashed, "na long, nb long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first, ties by a digest of role and text; null roles and
    texts count as empty; repeated rows are turns of their own. Rows without a conv_id are
    in no conversation. The first turns of the conversation that heads a family of five
    replace as many of each member. Other columns are not read. No rows give no nodes, not
    even a root. The columns are those of ``op12_prefix_trie``.
    """
    scratch = Scratch(conversations.sparkSession)
    convs, turns = rebuild(number_turns(conversations, scratch), scratch)
    height = convs.agg(F.max("length")).head()[0] or 0
    paths = name_prefixes(turns, convs, height, scratch)
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    found = paths.groupBy("na", "nb").agg(*[F.min(c).alias(c) for c in ("pa", "pb", "conv", "pos", "bytes")], F.count("*").alias("n"))
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n")).filter("n > 0").select(
        zero.alias("na"), zero.alias("nb"), none.alias("pa"), none.alias("pb"), "conv", F.lit(-1).cast("long").alias("pos"),
        zero.alias("bytes"), "n")
    found = scratch.keep(found.unionByName(root))
    children = found.filter("pos >= 0").groupBy(F.col("pa").alias("na"), F.col("pb").alias("nb")).agg(F.count("*").alias("children"))
    nodes = scratch.keep(found.join(children, ["na", "nb"], "left").na.fill(0, ["children"])
                         .withColumn("leaves", F.expr("if(children = 0, 1L, 0L)"))
                         .withColumn("saved", F.expr("(n - 1) * bytes")))
    totals = graft_totals(nodes, paths, height, scratch)
    ends = paths.filter("last").select("na", "nb", "conv").unionByName(
        convs.filter("length = 0").select(zero.alias("na"), zero.alias("nb"), "conv"))
    full = nodes.drop("leaves", "saved").join(totals.groupBy("na", "nb").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
                                              ["na", "nb"]).join(hash_ends(ends), ["na", "nb"], "left")
    above = nodes.select(F.col("na").alias("pa"), F.col("nb").alias("pb"), F.col("conv").alias("above"))
    return scratch.keep(full).join(above, ["pa", "pb"], "left").select(
        F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("above").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: crc32 of a decimal number, a byte and eight bits at a time; 3988292384 is the reversed polynomial.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, bit: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
         {{'name': md5(coalesce(role, '') || chr(0) || coalesce(text, '')),
           'bytes': octet_length(encode(coalesce(text, '')))::BIGINT}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
original AS (SELECT conv_id, list(turn ORDER BY pos) AS turns FROM turns GROUP BY conv_id),
headed AS (SELECT *, conv_id - conv_id % 5 AS base, ({_CRC} % 9)::INTEGER AS h FROM original),
rebuilt AS (
  SELECT o.conv_id, coalesce(b.turns[1:o.h], []) || o.turns[o.h + 1:] AS turns
  FROM headed o LEFT JOIN original b ON o.base = b.conv_id),
paths AS (
  SELECT conv_id, d, turns[1:d] AS path, d = len(turns) AS last
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM paths GROUP BY d, path),
children AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
         CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * n.path[n.d].bytes END AS saved
  FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.path = c.path),
totals AS (
  SELECT k AS d, path[1:k] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own) GROUP BY ALL)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children,
       t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN totals t ON o.d = t.d AND o.path = t.path
LEFT JOIN nodes p ON p.d = o.d - 1 AND p.path = o.path[1:o.d - 1]
"""
