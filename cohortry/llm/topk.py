"""Exact top-k inner products over a bit-sliced index.

Integer attributes are cut into bit slices: slice b of an attribute is a bitmap with one
bit per candidate row. A query's weighted sum is formed place by place with bitmap full
adders (negative digits of a weight take complements, which shifts all sums alike), which
leaves the scores of all rows of a block as bit slices. The top rows are then selected from the
most significant slice downward. The index holds quantised attributes (the lowest DROP
bits are left out), so the selection keeps every row whose error bound reaches the k-th
score; these boundary rows are resolved with exact integer products.

Vectors that are null, empty or hold null or non-finite components take no part; vectors
of different lengths are not compared. A query is not its own candidate: rows with its
id are left out. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate rows and queries of a block: a task sees one block of each.
ROWS, QUERIES = 16384, 512
#: Queries that share one pass over the slices, and low bits left out of the index.
TOGETHER, DROP = 16, 2


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))
                   | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantise(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class Slices:
    """Bit slices of a block of integer rows, shifted to be non-negative, low bits dropped."""

    def __init__(self, x: np.ndarray, drop: int = DROP):
        self.x, self.drop = x, drop
        coarse = x >> drop
        self.least = int(coarse.min())
        shifted = (coarse - self.least).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        rows = -(-len(x) // 64) * 64
        padded = np.zeros((rows, x.shape[1]), np.uint64)
        padded[:len(x)] = shifted
        self.words = rows // 64
        slices = np.stack([_bitmap((column >> np.uint64(b)) & np.uint64(1) != 0)
                           for column in padded.T.copy() for b in range(self.bits)])
        self.planes = np.concatenate([slices, ~slices])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of sum(weight * attribute), raised by a constant so that it is never negative.

        A weight is cut into signed digits, few of them not zero. A digit adds the attribute's
        slices at its place, a negative one their complements. The slices of a place are
        then added three at a time, all at once: a third stays, as many carries go on.
        """
        size = np.abs(query).astype(np.uint64)
        half = size >> np.uint64(1)
        odd = half ^ (size + half)
        more, less = (size + half) & odd, half & odd
        more, less = np.where(query < 0, less, more), np.where(query < 0, more, less)
        digits = np.concatenate([more, less])  # as in ``planes``: attributes, then their complements
        places = int(digits.max()).bit_length()
        at = [np.flatnonzero((digits >> np.uint64(p)) & np.uint64(1)) * self.bits for p in range(places)]
        out, carries, n = [], np.empty((0, self.words), np.uint64), 0
        while n or len(out) < max(1, places + self.bits - 1):
            level = len(out)
            own = [at[p] + (level - p) for p in range(max(0, level - self.bits + 1), min(level + 1, places))]
            own = np.concatenate(own) if own else np.zeros(0, int)
            held = np.empty((n + len(own), self.words), np.uint64)
            held[:n] = carries[:n]
            np.take(self.planes, own, axis=0, out=held[n:], mode="clip")
            left = len(held)
            carries, spare, n = np.empty((left // 2, self.words), np.uint64), np.empty((left // 3, self.words), np.uint64), 0
            while left > 2:
                k = left // 3
                a, b, c, x = held[:k], held[k:2 * k], held[2 * k:3 * k], spare[:k]
                np.bitwise_xor(a, b, out=x)  # full adder on bitmaps
                np.bitwise_and(a, b, out=b)
                np.bitwise_xor(x, c, out=a)
                np.bitwise_and(x, c, out=c)
                np.bitwise_or(b, c, out=carries[n:n + k])
                held[k:left - 2 * k] = held[3 * k:left].copy()
                left, n = left - 2 * k, n + k
            if left == 2:
                np.bitwise_and(held[0], held[1], out=carries[n])
                held[0] ^= held[1]
                n += 1
            out.append(held[0] if left else np.zeros(self.words, np.uint64))
        return out

    def candidates(self, queries: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Bitmaps of the rows that can be among each query's k best: queries x words."""
        sums = [self.sums(q) for q in queries]
        score = np.zeros((max(map(len, sums)), len(queries), self.words), np.uint64)
        for q, levels in enumerate(sums):
            score[:len(levels), q] = levels
        # select the k-th best from the most significant slice downward
        above = np.zeros_like(allowed)
        level = allowed.copy()
        kth = np.zeros(len(queries), object)
        want = np.minimum(k, np.bitwise_count(allowed).sum(axis=1)).astype(np.int64)
        for b in range(len(score) - 1, -1, -1):
            ones = level & score[b]
            n = np.bitwise_count(above).sum(axis=1).astype(np.int64) + np.bitwise_count(ones).sum(axis=1)
            enough = n >= want
            kth += np.where(enough, 1 << b, 0)
            above = np.where(enough[:, None], above, above | ones)
            level = np.where(enough[:, None], ones, level & ~score[b])
        # a coarse sum is off by (2^drop - 1) times the weights at most, up or down
        width = (np.abs(queries).sum(axis=1) * ((1 << self.drop) - 1)) >> self.drop
        return _at_least(score, kth - (width + 1), allowed)


def _bitmap(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little").view(np.uint64)


def _at_least(score: np.ndarray, bound: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Rows of ``allowed`` whose sliced value reaches each query's bound."""
    bound = np.array([max(0, int(x)) for x in bound], object)
    above, equal = np.zeros_like(allowed), allowed.copy()
    for b in range(len(score) - 1, -1, -1):
        one = np.array([bool((x >> b) & 1) for x in bound])[:, None]
        above = np.where(one, above, above | (equal & score[b]))
        equal &= np.where(one, score[b], ~score[b])
    return above | equal


def block_top(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query id, row id, score) of each query's k best rows of one block."""
    index = Slices(x)
    for i in range(0, len(queries), TOGETHER):
        some, names = queries[i:i + TOGETHER], query_ids[i:i + TOGETHER]
        own = names[:, None] == ids[None, :]
        padded = np.ones((len(some), index.words * 64), bool)
        padded[:, :len(ids)] = own
        allowed = ~np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        found = index.candidates(some, allowed, k)
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
        for q in range(len(some)):
            rows = np.flatnonzero(bits[q])
            exact = x[rows] @ some[q]
            best = np.lexsort((ids[rows], -exact))[:k]
            for r in best:
                yield int(names[q]), int(ids[rows[r]]), int(exact[r])


def sliced_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id",
                 vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, ``key``, score: each query's k best rows of ``vectors``.

    Rows and queries are dealt into blocks by a hash of the id; every block of queries
    meets every block of rows of the same length once, and only k rows a pair come back.
    """
    pick = lambda df: df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), quantise(F.col(vector), scale).alias("x"), F.size(vector).alias("dim"))
    rows, asked = pick(vectors), pick(queries)
    n_rows = max(1, -(-vectors.count() // ROWS))
    n_asked = max(1, -(-queries.count() // QUERIES))
    block = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    rows = (rows.withColumn("rb", block(n_rows, 3))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))))
    asked = (asked.withColumn("qb", block(n_asked, 5))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["query_id", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in cols})
        got = block_top(np.stack(left["x"].to_numpy()), left["id"].to_numpy(),
                        np.stack(right["x"].to_numpy()), right["id"].to_numpy(), k)
        return pd.DataFrame(list(got), columns=cols, dtype="int64")

    keys = ("dim", "rb", "qb")
    near = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(key), "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
