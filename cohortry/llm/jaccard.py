"""N-gram Jaccard join with prefix trees over globally ordered n-gram sets.

1. Every text becomes the set of its 5-word shingles (64-bit hashes). Texts with equal
   sets are one: all further work is on set signatures, copies cost nothing.
2. Shingles are dealt by hash. A shingle that occurs in one set only can link nothing and
   is dropped; the others go back to their set with their frequency class. A set that
   shares fewer than three quarters of its shingles with anybody is done.
3. The survivors' shingles are put in one global order, rare ones first. Two linked sets
   share a shingle among the first size - ceil(3 size / 4) + 1 of each, so linked sets are
   in one component of the graph of these prefixes: a block.
4. Each block builds a prefix tree of its ordered sets and walks it with every set,
   extending the overlaps of all paths together and leaving a subtree as soon as the
   shingles that remain in the set, or on the subtree's longest and shortest paths, can
   no longer reach the bound. Sets that are joined already are not compared again.
   Blocks above BLOCK_WORDS shingles are cut into shards and every pair of shards meets.
5. Components of the verified links give each document its class.

Two documents link when 100 * intersection >= 75 * union, which is 4 i >= 3 u.
Null and empty texts have no shingle and link with nothing; fewer than five words make
one shingle of them all. Rows with a null id take part; a class is named after its
smallest id, null if it has none. Equal rows link like copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch, shingle_sets, signature
from cohortry.llm.graph import components

#: Shingles a bucket of step 2 receives on average, and most buckets (17 bits of the order).
BUCKET_WORDS, MOST_BUCKETS = 3_000_000, 1 << 17
#: Shingles and sets a task deals at once; a set's number in its chunk takes 16 bits.
CHUNK_WORDS, CHUNK_SETS = 2_000_000, 60_000
#: Shingles of one prefix-tree task.
BLOCK_WORDS = 4_000_000
_ZSTD = pa.Codec("zstd")

#: Set signatures a task remembers to leave out copies it has already dealt out.
REMEMBER = 1_000_000

_LOW40 = np.uint64((1 << 40) - 1)


def _shrink(values: np.ndarray) -> bytes:
    """Small numbers, entropy-coded; their count in front."""
    raw = values.tobytes()
    return len(raw).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def _grow(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True), kind)


def least_overlap(n: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-3 * n // 4)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names = [], []
        for values in shingle_sets(batch.column(1)):
            sizes.append(len(values))
            names.append(signature(values))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], names=["doc_id", "n", "sig"])


def _deal(buckets: int):
    """Shingles of a chunk of sets, grouped by bucket, and the chunk's list of sets.

    A shingle names its set by the number in the chunk, so that the packed rows cost the
    same however many buckets there are. The list travels with one of the buckets.
    """

    def emit(chunk: int, sets: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets)
        bucket = ((values >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(bucket, kind="stable")
        bucket, owner, low = bucket[order], owner[order], values[order] & _LOW40
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        rows = [(chunk % buckets, None, None, None, np.array(names, "<i8").tobytes(), sizes.astype("<u4").tobytes())]
        for a, b in zip(cut, [*cut[1:], len(bucket)]):
            rows.append((int(bucket[a]), (low[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                         (low[a:b] >> np.uint64(32)).astype("u1").tobytes(),
                         _shrink(np.diff(owner[a:b], prepend=0).astype("<u2")), None, None))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
             *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))],
            names=["bucket", "chunk", "low", "high", "owners", "sigs", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        chunk = TaskContext.get().partitionId() << 32
        sets, names, held = [], [], 0
        for batch in batches:
            for values in shingle_sets(batch.column(0)):
                if not len(values):
                    continue
                sig = signature(values)
                if sig in seen:
                    continue
                if len(seen) < REMEMBER:
                    seen.add(sig)
                sets.append(values)
                names.append(sig)
                held += len(values)
                if held >= CHUNK_WORDS or len(sets) == CHUNK_SETS:
                    yield emit(chunk, sets, names)
                    sets, names, held, chunk = [], [], 0, chunk + 1
        if sets:
            yield emit(chunk, sets, names)

    return run


_DEALT = "bucket int, chunk long, low binary, high binary, owners binary, sigs binary, sizes binary"
_BACK = "chunk long, bucket int, owners binary, low binary, high binary, level binary, sigs binary, sizes binary"


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket, the shingles that two or more sets have, sent back to their chunks."""
    lists = frame[frame["low"].isna()]
    bucket = int(frame["bucket"].iloc[0])
    rows = [(int(r.chunk), bucket, None, None, None, None, r.sigs, r.sizes) for r in lists.itertuples()]
    frame = frame[frame["low"].notna()].sort_values("chunk")
    if len(frame):
        cat = lambda c, t: np.frombuffer(b"".join(frame[c]), t)
        owner = np.concatenate([np.cumsum(_grow(o, "<u2"), dtype=np.int64) for o in frame["owners"]])
        place = np.repeat(np.arange(len(frame)), [len(h) for h in frame["high"]])
        word = cat("low", "<u4").astype(np.int64) | (cat("high", "u1").astype(np.int64) << 32)
        order = np.argsort(word, kind="stable")
        inside = word[order]
        head = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]])
        count = np.diff(np.r_[head, len(inside)])
        times = np.empty(len(word), np.int64)
        times[order] = np.repeat(count, count)
        kept = times > 1
        # inside its bucket the number of a shared shingle names it as well as its 40 bits
        number = np.empty(len(word), np.int64)
        number[order] = np.repeat(np.cumsum(count > 1) - 1, count)
        level = np.log2(times[kept]).astype("u1")
        owner, place, number, chunks = owner[kept], place[kept], number[kept], frame["chunk"].to_numpy()
        low, high = (number & 0xFFFF).astype("<u2"), (number >> 16).astype("<u4")
        cut = np.searchsorted(place, np.arange(len(frame) + 1))
        rows += [(int(chunks[i]), bucket, _shrink(np.diff(owner[a:b], prepend=0).astype("<u2")), low[a:b].tobytes(),
                  _shrink(high[a:b]), _shrink(level[a:b]), None, None)
                 for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    return pd.DataFrame(rows, columns=["chunk", "bucket", "owners", "low", "high", "level", "sigs", "sizes"])


def _survivors(frame: pd.DataFrame) -> pd.DataFrame:
    """Sets that share three quarters of their shingles, in global order, with their prefix length."""
    known = frame[frame["sigs"].notna()].iloc[0]
    sigs, sizes = np.frombuffer(known["sigs"], "<i8"), np.frombuffer(known["sizes"], "<u4").astype(np.int64)
    frame = frame[frame["low"].notna()]
    none = [np.zeros(0, np.int64)]
    cat = lambda c, t: np.concatenate(none + [_grow(x, t).astype(np.int64) for x in frame[c]])
    owner = np.concatenate(none + [np.cumsum(_grow(o, "<u2"), dtype=np.int64) for o in frame["owners"]])
    bucket = np.repeat(frame["bucket"].to_numpy(np.int64), [len(x) // 2 for x in frame["low"]])
    low = np.frombuffer(b"".join(frame["low"]), "<u2").astype(np.int64)
    # the global order: frequency class first, then bucket and number of the shingle
    words = (cat("level", "u1") << 57) | (bucket << 40) | (cat("high", "<u4") << 16) | low
    order = np.lexsort((words, owner))
    owner, words = owner[order], words[order]
    cut = np.searchsorted(owner, np.arange(len(sigs) + 1))
    rows = []
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        n = int(sizes[i])
        need = least_overlap(n)
        if b - a >= need:
            own = np.unique(words[a:b])
            rows.append((int(sigs[i]), n, own, int(b - a - need + 1)))
    return pd.DataFrame(rows, columns=["sig", "n", "words", "prefix"])


class PrefixTree:
    """Compressed trie of ordered sets: a node is a run of shingles shared by its leaves."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.leaf_of = np.array(order)
        ordered = [sets[i] for i in order]
        starts, ends, parents, words, leaves, rests, most = [], [], [], [], [], [], []
        at = 0
        stack = [(0, len(ordered), 0, -1)]  # leaves a..b share their first `depth` shingles below node `parent`
        while stack:
            a, b, depth, parent = stack.pop()
            while a < b and len(ordered[a]) == depth:  # sets that end at the node itself
                leaves.append((parent, a))
                a += 1
            while a < b:
                first, end = ordered[a][depth], a + 1
                lo, hi = a, b
                while hi - lo > 1:  # leaves with the same next shingle are neighbours
                    mid = (lo + hi) // 2
                    if len(ordered[mid]) > depth and ordered[mid][depth] == first:
                        lo = mid
                    else:
                        hi = mid
                end = lo + 1
                left, right = ordered[a], ordered[end - 1]
                m = min(len(left), len(right))
                differ = np.flatnonzero(left[depth:m] != right[depth:m])
                stop = depth + int(differ[0]) if len(differ) else m
                node = len(starts)
                words.append(left[depth:stop])
                starts.append(at)
                at += stop - depth
                ends.append(at)
                parents.append(parent)
                rests.append(max(len(s) for s in ordered[a:end]) - stop)
                most.append(stop)
                stack.append((a, end, stop, node))
                a = end
        self.words = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.starts, self.ends, self.rests = (np.array(v, np.int64) for v in (starts, ends, rests))
        parents = np.array(parents, np.int64)
        by_parent = np.argsort(parents, kind="stable")
        self.children = by_parent
        self.first_child = np.searchsorted(parents[by_parent], np.arange(-1, len(starts) + 1))
        self.ending: dict[int, list[int]] = {}
        for node, leaf in leaves:
            self.ending.setdefault(node, []).append(order[leaf])

    def walk(self, member: np.ndarray, words: np.ndarray, need: int, alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Sets that share at least ``need`` of the ordered ``words``, and how many they share.

        ``member`` marks the words' ranks; ``alive`` (per node) leaves out subtrees.
        """
        found, overlap = [], []
        nodes = self.children[self.first_child[0]:self.first_child[1]]
        have = np.zeros(len(nodes), np.int64)
        while len(nodes):
            if alive is not None:
                keep = alive[nodes]
                nodes, have = nodes[keep], have[keep]
                if not len(nodes):
                    break
            sizes = self.ends[nodes] - self.starts[nodes]
            at = np.cumsum(sizes) - sizes
            places = np.arange(int(sizes.sum())) - np.repeat(at - self.starts[nodes], sizes)
            have = have + np.add.reduceat(member[self.words[places]].astype(np.int64), at)
            last = self.words[self.ends[nodes] - 1]
            ahead = len(words) - np.searchsorted(words, last, "right")  # the set's words after this node
            keep = have + np.minimum(ahead, self.rests[nodes]) >= need
            nodes, have = nodes[keep], have[keep]
            for node, h in zip(nodes.tolist(), have.tolist()):
                if h >= need and node in self.ending:
                    found += self.ending[node]
                    overlap += [h] * len(self.ending[node])
            a, b = self.first_child[nodes + 1], self.first_child[nodes + 2]
            below = b - a
            have = np.repeat(have, below)
            nodes = self.children[np.arange(int(below.sum())) - np.repeat(np.cumsum(below) - below - a, below)]
        return np.array(found, np.int64), np.array(overlap, np.int64)


def tree_links(names: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], asking: np.ndarray,
               answering: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between asking and answering sets of one block."""
    universe, ranks = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([0, *map(len, sets)])
    sets = [ranks[a:b] for a, b in zip(cut[:-1], cut[1:])]
    answers = np.flatnonzero(answering)
    tree = PrefixTree([sets[i] for i in answers])
    top = np.arange(len(sets))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    member = np.zeros(len(universe), bool)
    links = []
    group = len(answers) > 64  # worth leaving out subtrees that are joined already
    for q in np.argsort(-sizes, kind="stable"):
        if not asking[q]:
            continue
        own = find(q)
        alive = None
        if group:
            roots = _roots(top)
            other = roots[answers] != own
            if not other.any():
                continue
            alive = _alive(tree, other)
        member[sets[q]] = True
        hits, overlap = tree.walk(member, sets[q], least_overlap(int(sizes[q])), alive)
        member[sets[q]] = False
        if len(hits):
            hits = answers[hits]
            linked = 4 * overlap >= 3 * (sizes[q] + sizes[hits] - overlap)
            for h in hits[linked & (hits != q)]:
                a, b = find(q), find(h)
                if a != b:
                    top[max(a, b)] = min(a, b)
                    links.append((int(names[q]), int(names[h])))
    return links


def _roots(top: np.ndarray) -> np.ndarray:
    out = top.copy()
    while True:
        new = out[out]
        if (new == out).all():
            return out
        out = new


def _alive(tree: PrefixTree, wanted: np.ndarray) -> np.ndarray:
    """Nodes on the way to a wanted set."""
    if not hasattr(tree, "leaf_node"):
        tree.leaf_node = np.zeros(len(wanted), np.int64)
        for node, sets in tree.ending.items():
            tree.leaf_node[sets] = node
        tree.parent = np.full(len(tree.starts), -1, np.int64)
        for node in range(-1, len(tree.starts)):
            tree.parent[tree.children[tree.first_child[node + 1]:tree.first_child[node + 2]]] = node
    alive = np.zeros(len(tree.starts), bool)
    nodes = np.unique(tree.leaf_node[wanted])
    while len(nodes):
        nodes = nodes[(nodes >= 0)]
        nodes = nodes[~alive[nodes]]
        alive[nodes] = True
        nodes = np.unique(tree.parent[nodes])
        nodes = nodes[nodes >= 0]
    return alive


def _block_links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates("sig").sort_values("sig")  # copies from other chunks
    i, j = key[1], key[2]
    shard = frame["shard"].to_numpy()
    links = tree_links(frame["sig"].to_numpy(), frame["n"].to_numpy(), [np.asarray(w) for w in frame["words"]],
                       shard == i, shard == j) if len(frame) > 1 else []
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[key].dataType.simpleString()
    names = scratch.keep(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
                         .mapInArrow(_digest, f"doc_id {kind}, n long, sig long"))
    words = names.agg(F.sum("n")).head()[0] or 0
    buckets = int(min(MOST_BUCKETS, max(16, -(-words // BUCKET_WORDS))))
    dealt = docs.select(F.col(text).alias("text")).mapInArrow(_deal(buckets), _DEALT)
    back = dealt.groupBy("bucket").applyInPandas(_shared, _BACK)
    alive = scratch.keep(back.groupBy("chunk").applyInPandas(_survivors, "sig long, n long, words array<long>, prefix int"))
    posts = alive.select("sig", F.explode(F.slice("words", 1, F.col("prefix"))).alias("word"))
    hubs = posts.groupBy("word").agg(F.min("sig").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    near = posts.join(hubs, "word").select(F.col("sig").alias("a"), F.col("hub").alias("b")).filter("a != b").distinct()
    blocks = scratch.keep(components(near, scratch))
    held = alive.select("sig", "n", "words").join(blocks.withColumnRenamed("node", "sig"), "sig")
    weight = (held.groupBy("component").agg(F.sum("n").alias("total"))
              .select("component", F.ceil(F.col("total") / BLOCK_WORDS).cast("int").alias("shards")))
    held = held.join(scratch.keep(weight), "component")
    held = held.withColumn("shard", F.pmod(F.xxhash64("sig"), F.col("shards")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    held = held.select("component", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"),
                       "sig", "n", "words", "shard")
    links = scratch.keep(held.groupBy("component", "i", "j").applyInPandas(_block_links, "a long, b long"))
    joined = components(links, scratch).select(F.col("node").alias("sig"), F.col("component").alias("class"))
    named = names.join(joined, "sig", "left").withColumn(
        "class", F.when(F.col("n") > 0, F.coalesce("class", "sig")))
    tops = scratch.keep(named.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id")))
    out = named.join(tops, "class", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
