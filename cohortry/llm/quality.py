"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes it is written in: trigrams of character classes, word
lengths, words that repeat the word before, words per line. Square roots of their
shares, weighted by inverse document frequency, are projected on the leading singular
vectors of a bounded labelled sample. The sample's vectors are broadcast (FIT_ROWS x
RANK numbers, a fixed bound); every text's exact cosines with all of them are computed
in blocks, and its nearest neighbours vote with weights that rise with similarity.

Null and empty texts, and texts without terms, get score 0: nothing speaks for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import SLICE_BYTES, text_bytes, word_bounds, word_hashes

#: Labelled rows that vote, at most (in hash order), and the latent dimensions.
FIT_ROWS, RANK = 6_000, 48
#: Neighbours that vote; a neighbour's weight is exp((cosine - best cosine) / WARMTH).
NEIGHBOURS, WARMTH = 15, 0.05

_MARKS = b".,!?;:'\"-"


def _classes() -> np.ndarray:
    out = np.full(256, 13, np.int64)  # other marks
    out[[0x20, 0x09]] = 0
    out[[0x0A, 0x0B, 0x0C, 0x0D]] = 1
    for i in range(256):
        c = chr(i)
        if i >= 128:
            out[i] = 2
        elif c.islower():
            out[i] = 2
        elif c.isupper():
            out[i] = 3
        elif c.isdigit():
            out[i] = 4
        elif i in _MARKS:
            out[i] = 5 + {".": 0, ",": 1, "!": 2, "?": 2, ";": 3, ":": 3, "'": 4, '"': 4, "-": 4}[c]
    for i, c in enumerate("|<>"):
        out[ord(c)] = 10
    for c in "&$%#*@=+~^":
        out[ord(c)] = 11
    for c in "()[]{}/\\_":
        out[ord(c)] = 12
    return out


CLASS, KINDS = _classes(), 14
TRIGRAMS = KINDS ** 3
LENGTHS, LINES = 20, 14
TERMS = TRIGRAMS + LENGTHS + LINES + 2


def term_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of every term, one matrix of rows x TERMS per slice of text."""
    data, offsets = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        stop = min(stop, row + 512)
        part, at = data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        yield _counts(part, at)
        row = stop


def _add(out: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> None:
    out += np.bincount(rows * TERMS + terms, minlength=out.size).reshape(out.shape)


def _counts(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    out = np.zeros((n, TERMS))
    if not len(part):
        return out
    owner = np.repeat(np.arange(n), np.diff(at))
    kind = CLASS[part]
    if len(part) > 2:
        same = owner[:-2] == owner[2:]
        code = kind[:-2] * (KINDS * KINDS) + kind[1:-1] * KINDS + kind[2:]
        _add(out, owner[:-2][same], code[same])
    starts, ends, first = word_bounds(part, at)
    if len(starts):
        words = word_hashes(part, starts, ends)
        who = np.repeat(np.arange(n), np.diff(first))
        _add(out, who, TRIGRAMS + np.minimum(ends - starts, LENGTHS) - 1)
        repeats = np.zeros(len(words), bool)
        repeats[1:] = (words[1:] == words[:-1]) & (who[1:] == who[:-1])
        _add(out, who, TRIGRAMS + LENGTHS + LINES + repeats)
        line = np.cumsum(part == 10)[starts] * np.int64(1) + who * np.int64(len(part) + 1)
        _, head, size = np.unique(line, return_index=True, return_counts=True)
        length = np.minimum(np.log2(size).astype(np.int64), LINES - 1)
        _add(out, who[head], TRIGRAMS + LENGTHS + length)
    return out


_GROUPS = ((0, TRIGRAMS, 1.0), (TRIGRAMS, TRIGRAMS + LENGTHS, 0.5),
           (TRIGRAMS + LENGTHS, TRIGRAMS + LENGTHS + LINES, 0.5), (TERMS - 2, TERMS, 1.0))


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of each group's shares."""
    out = np.empty(counts.shape, np.float32)
    for a, b, weight in _GROUPS:
        total = np.maximum(counts[:, a:b].sum(axis=1, keepdims=True), 1)
        out[:, a:b] = weight * np.sqrt(counts[:, a:b] / total)
    return out


class Neighbours:
    """Latent vectors and labels of the voters, and the projection."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        seen = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
        self.base = _singular(x * self.idf, min(rank, *x.shape))
        self.labels = labels.astype(np.float32)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.base
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def vote(self, x: np.ndarray) -> np.ndarray:
        v = self.project(x)
        k = min(NEIGHBOURS, len(self.labels))
        cosines = v @ self.vectors.T
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(cosines, best, axis=1)
        weight = np.exp((near - near.max(axis=1, keepdims=True)) / WARMTH)
        score = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.where(np.abs(v).sum(axis=1) > 0, score, 0.0).astype(float)


def _singular(x: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rng = np.random.default_rng(7)
    q = rng.standard_normal((x.shape[1], min(rank + 8, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T[:, :rank]).astype(np.float32)


def fit_neighbours(labelled: DataFrame) -> Neighbours | None:
    """Voters from rows (key, text, label 0/1); None without any labelled row."""
    rows = labelled.filter("label in (0, 1)").select("key", "text", "label")
    n = rows.count()
    if n == 0:
        return None
    if n > FIT_ROWS:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(13), "key"), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for counts in term_counts(batch.column(1)):
                x = shares(counts)
                r, c = np.nonzero(x)
                cut = np.searchsorted(r, np.arange(len(x) + 1))
                blobs = [(c[a:b].astype("<u2").tobytes(), x[r[a:b], c[a:b]].astype("<f4").tobytes())
                         for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)).cast(pa.string()), batch.column(2).slice(at, len(x)).cast(pa.int32()),
                     pa.array([b[0] for b in blobs], pa.binary()), pa.array([b[1] for b in blobs], pa.binary())],
                    names=["key", "label", "terms", "shares"])
                at += len(x)

    got = (rows.select(F.col("key").cast("string").alias("key"), "text", "label")
           .mapInArrow(measure, "key string, label int, terms binary, shares binary")
           .toPandas().sort_values(["key", "label"], kind="stable"))
    x = np.zeros((len(got), TERMS), np.float32)
    for i, (terms, values) in enumerate(zip(got["terms"], got["shares"])):
        x[i, np.frombuffer(terms, "<u2")] = np.frombuffer(values, "<f4")
    return Neighbours(x, got["label"].to_numpy()) if len(got) else None


def score_quality(docs: DataFrame, voters: Neighbours | None, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher is better). A map over rows; without voters 0.5."""
    docs = docs.drop("score")
    if voters is None:
        return docs.withColumn("score", F.when(F.length(text) > 0, 0.5).otherwise(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            got = [shared.value.vote(shares(c)) for c in term_counts(column)]
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())],
                                             names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, f"{fields}, score double")
