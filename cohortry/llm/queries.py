"""The registered queries of the training-data operators, thin layers over their interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import (alignment, itq, jaccard, linededup, mixing, packing, prefixtrie, quality, secrets, separators,
                          tokenfiles, topk, toxicity)
from cohortry.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A document is predicted 1 from this score on.
THRESHOLD = 0.3


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: str, folds: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def labelled(spark: SparkSession, sf_dir: str, docs: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """Rows (key, text, label) outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("label"))
    labels = labels.filter(F.coalesce(remainder("doc_id", folds) != held, F.lit(False)))
    return (docs.select("doc_id", "text").join(labels, "doc_id")
            .select(F.col("doc_id").alias("key"), "text", "label"))


def held_out(folds: int, held: int):
    return F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out")


def predicted():
    return (F.col("score") >= THRESHOLD).cast("int").alias("predicted")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit_grammar(labelled(spark, sf_dir, docs, "toxic", 4, 2))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", held_out(4, 2), "score", predicted())


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voters = quality.fit_neighbours(labelled(spark, sf_dir, docs, "quality", 5, 0))
    scored = quality.score_quality(docs.select("doc_id", "text"), voters)
    return scored.select("doc_id", held_out(5, 0), "score", predicted())


@query("op3_mixing", mixing.SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


@query("op4_secrets")
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op6_sliced_top_k", topk.SQL)
def op6_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.sliced_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@query("op8_itq")
def op8_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.embedding_near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_jaccard")
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op7_range_coder")
def op7_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = tokenfiles.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), 50257, Scratch(spark))
    return tokenfiles.read_token_files(files)


@query("op10_separator_scan")
def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    end_id = 50256  # <|endoftext|> of the vocabulary
    docs = table(spark, sf_dir, "documents")
    files = separators.write_flat_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id, Scratch(spark))
    counts = separators.separator_scan(files, end_id).filter("closed")
    named = files.select("file", "block", F.posexplode("docs").alias("k", "doc_id"))
    return named.join(counts, ["file", "block", "k"]).select("doc_id", "file", "ordinal", "start", "n_tokens")


@query("op13_line_dedup", linededup.SQL)
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op12_prefix_trie", prefixtrie.SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))
