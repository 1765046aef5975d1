"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A bounded sample of unit vectors gives the mean, the principal axes and, by alternating sign codes and
orthogonal Procrustes steps, the rotation whose signs quantise the projected vectors
best: balanced binary codes. Every vector is coded. The code is cut into substrings, one
hash table each; two vectors meet when a substring agrees up to RADIUS bits. Vectors that
meet are compared by their exact cosine in double precision on the original components.
A pair that meets in several tables counts in the first of them only.

Equal vectors are one representative with a multiplicity, so copies cost nothing. Buckets
with more than BLOCK representatives are cut into blocks, and so are the probes that reach
a bucket; every block of probes meets every block of its bucket in a task of its own.

Vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and vectors of different lengths do not link; all stay in the result. Rows with
a repeated id count as different vectors, and share their id's component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch
from cohortry.llm.graph import components
from cohortry.llm.topk import usable

#: Vectors the rotation is fitted on, at most (in hash order), and rounds of fitting.
FIT_ROWS, ROUNDS = 8_000, 40
#: Representatives of one bucket block and of one probe block, about (blocks are dealt by hash).
BLOCK = 2048


#: Bits of a code. Recall hangs on the number of tables that a pair can meet in, so vectors
#: with fewer components are coded by several rotations until the code is full.
BITS = 64


class Rotation:
    """Codes of 64 bits: signs of rotated principal components of unit vectors.

    Fewer than 64 components are rotated several times, each time from another start.
    """

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        lead = axes[:BITS].T
        v = centred @ lead
        bits = v.shape[1]
        turned = []
        for start in range(-(-BITS // bits)):
            turn, _ = np.linalg.qr(np.random.default_rng(5 + start).standard_normal((bits, bits)))
            for _ in range(ROUNDS):
                signs = np.where(v @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(signs.T @ v)
                turn = (left @ right).T
            turned.append(lead @ turn)
        self.axes = np.concatenate(turned, axis=1)[:, :BITS]
        self.bits = BITS

    def code(self, x: np.ndarray) -> np.ndarray:
        signs = (x - self.mean) @ self.axes >= 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def plan(rows: int, bits: int) -> tuple[int, int]:
    """Bits of a substring and its search radius: buckets grow slowly as rows do."""
    width, radius = (8, 0) if rows <= 1 << 20 else (12, 1) if rows <= 1 << 27 else (16, 2)
    return min(width, bits), radius


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _joined(near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id each row and column is joined to by the links of this block."""
    most = np.iinfo(np.int64).max
    heads = cols.copy()
    while True:
        root = np.minimum(rows, np.where(near, heads[None, :], most).min(axis=1, initial=most))
        new = np.minimum(heads, np.where(near, root[:, None], most).min(axis=0, initial=most))
        if (new == heads).all():
            return root, heads
        heads = new


def _linker(width: int, radius: int, threshold: float):
    """Links between a bucket block and the probes that reach it.

    ``n`` counts a probe's direct links whose first table this is; ``b`` is the smallest
    id it is joined to within the block, which is all that components need.
    """

    def link(key: tuple, rows: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "n": []}
        if len(rows) and len(probes):
            table = int(key[1])
            x, ids, codes = unit(np.stack(rows["x"].to_numpy()).astype(float)), rows["rep"].to_numpy(), rows["code"].to_numpy().view(np.uint64)
            weight = rows["copies"].to_numpy()
            for i in range(0, len(probes), BLOCK):
                part = probes.iloc[i:i + BLOCK]
                y, names = unit(np.stack(part["x"].to_numpy()).astype(float)), part["rep"].to_numpy()
                near = (y @ x.T >= threshold) & (names[:, None] != ids[None, :])
                r, c = np.nonzero(near)
                apart = part["code"].to_numpy().view(np.uint64)[r] ^ codes[c]
                first = np.ones(len(r), bool)
                for t in range(table):
                    piece = (apart >> np.uint64(t * width)) & np.uint64((1 << width) - 1)
                    first &= np.bitwise_count(piece) > radius
                found = np.bincount(r[first], weight[c[first]], minlength=len(part)).astype(np.int64)
                root, heads = _joined(near, names, ids)
                seen = near.any(axis=1)
                out["a"] += [names[seen], ids[near.any(axis=0)]]
                out["b"] += [root[seen], heads[near.any(axis=0)]]
                out["n"] += [found[seen], np.zeros(int(near.any(axis=0).sum()), np.int64)]
        cols = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
        return pd.DataFrame(cols)

    return link


def embedding_near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                              threshold: float = 0.9) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    x = F.col(vector)
    good = usable(F.col(vector)) & F.col(key).isNotNull() & F.exists(vector, lambda v: v != 0)
    coded = vectors.select(F.col(key).cast("long").alias("id"), F.when(good, x).alias("x"))
    coded = coded.withColumns({"k1": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(1), "x")),
                               "k2": F.when(F.col("x").isNotNull(), F.xxhash64(F.lit(2), "x"))})
    reps = scratch.keep(coded.filter("x is not null").groupBy("k1", "k2").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
        .withColumn("dim", F.size("x")))
    ids = coded.select("id", "k1", "k2")
    dims = {r.dim: r["count"] for r in reps.groupBy("dim").count().collect()}
    link_parts = []
    for dim, size in dims.items():
        own = reps.filter(F.col("dim") == dim)
        share = min(1.0, FIT_ROWS / size)
        sample = own.filter(F.pmod(F.col("k1"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("k1", "x").toPandas()
        if not len(sample):
            sample = own.select("k1", "x").limit(1).toPandas()
        fitted = Rotation(unit(np.stack(sample.sort_values("k1")["x"].to_numpy()).astype(float)))
        link_parts.append(_links(own, fitted, size, threshold, scratch))
    if not link_parts:
        return vectors.select(F.col(key), F.lit(0).cast("long").alias("n_links"),
                              F.col(key).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    links = link_parts[0]
    for more in link_parts[1:]:
        links = links.unionByName(more)
    links = scratch.keep(links)  # a, b: signatures of representatives; n: direct links found
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(links.select("a", "b"), scratch)
    by_rep = (reps.select("k1", "k2", "least", "copies", F.xxhash64("k1", "k2").alias("rep"))
              .join(counts, F.col("rep") == F.col("a"), "left")
              .join(comp, F.col("rep") == F.col("node"), "left")
              .select("k1", "k2", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"),
                      F.coalesce("component", "rep").alias("group")))
    by_rep = scratch.keep(by_rep)
    tops = by_rep.groupBy("group").agg(F.min("least").alias("component_id"))
    by_rep = by_rep.join(tops, "group").select("k1", "k2", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = ids.join(by_rep, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, fitted: Rotation, n: int, threshold: float, scratch: Scratch) -> DataFrame:
    width, radius = plan(n, fitted.bits)
    tables = fitted.bits // width

    @F.pandas_udf("long")
    def code(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series(dtype="int64")
        return pd.Series(fitted.code(unit(np.stack(column.to_numpy()).astype(float))).view(np.int64))

    coded = scratch.keep(reps.select(F.xxhash64("k1", "k2").alias("rep"), "copies", "x", "dim").withColumn("code", code("x")))
    held, probes = _blocks(coded, width, radius, tables, scratch)
    return held.groupBy(*KEYS).cogroup(probes.groupBy(*KEYS)).applyInPandas(
        _linker(width, radius, threshold), "a long, b long, n long")


#: Keys of one task: a block of a table's bucket and a block of the probes that reach it.
KEYS = ("dim", "t", "p", "block", "asking")


def _blocks(coded: DataFrame, width: int, radius: int, tables: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Bucket rows and probes by KEYS; each pair of a row and a probe of its bucket meets once."""
    piece = lambda t: F.shiftrightunsigned("code", t * width).bitwiseAND(F.lit((1 << width) - 1))
    places = F.array(*[F.struct(F.lit(t).alias("t"), piece(t).alias("p")) for t in range(tables)])
    placed = coded.withColumn("at", F.explode(places)).select("*", "at.t", "at.p").drop("at")
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    reach = lambda df: df.withColumn("flip", F.explode(F.array(*map(F.lit, flips)))).withColumn(
        "p", F.col("p").bitwiseXOR(F.col("flip").cast("long"))).drop("flip") if radius else df
    sizes = placed.groupBy("t", "p").count()
    asked = reach(sizes).groupBy("t", "p").agg(F.sum("count").alias("asked"))
    cut = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = scratch.keep(sizes.join(asked, ["t", "p"]).select("t", "p", cut("count").alias("blocks"), cut("asked").alias("askings")))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = placed.join(sizes, ["t", "p"]).withColumn("block", own("blocks")).withColumn("asking", every("askings"))
    probes = reach(placed).join(sizes, ["t", "p"]).withColumn("asking", own("askings")).withColumn("block", every("blocks"))
    cols = (*KEYS, "rep", "copies", "code", "x")
    probes = probes.toDF(*[f"{c}_" for c in probes.columns]).select(*[F.col(f"{c}_").alias(c) for c in cols])
    return held.select(*cols), probes
