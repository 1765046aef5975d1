"""The corpus pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import mixing, packing, quality, secrets
from cohortry.llm.common import Scratch, table
from cohortry.llm.queries import THRESHOLD, labelled, tokenizer_path


def _whole(docs: DataFrame, without: str = "") -> Column:
    """A row's columns as one value, so that no name of theirs meets one that a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without]).alias("row")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours reject go; null and empty texts are rejected."""
    train = labelled(spark, sf_dir, table(spark, sf_dir, "documents"), "quality", 5, 0)
    scored = quality.score_quality(docs.select("text", _whole(docs, "text")), quality.fit_neighbours(train))
    kept = scored.filter(F.col("score") >= THRESHOLD)
    return kept.select(*[F.col(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: the smallest doc_id, nulls last, then the first by row number.

    Rows without words are in no group and stay.
    """
    from cohortry.llm import jaccard

    # the numbers are written with the rows, so that every reader sees the same ones
    rows = Scratch(spark).keep(docs.select(_whole(docs), F.monotonically_increasing_id().alias("number")), "zstd")
    place = F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("doc_id"), "number")
    links = jaccard.jaccard_components(rows.select(place.alias("place"), F.col("row.text").alias("text")), key="place")
    stay = links.filter("place = component_id").select("place.number")
    return rows.join(stay, "number", "left_semi").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text are replaced by their kind; no document goes."""
    found = secrets.scan_secrets(docs.select("text", _whole(docs, "text")))
    hit = F.col("spans") != ""
    changed = {"text": F.when(hit, F.col("redacted")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it, also rows with null or repeated ids.

    Rows are numbered, and the plan meets them by number. A row is drawn by its id and
    text, so that the mix does not depend on the numbers; rows equal in both are drawn by
    number as well.
    """
    rows = Scratch(spark).keep(docs.select(_whole(docs), F.monotonically_increasing_id().alias("number")), "zstd")
    named = F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")), F.lit("|"),
                           F.coalesce("row.text", F.lit(""))).cast("binary"))
    sized = rows.select("number", named.alias("digest"), F.col("row.source").alias("source"), F.col("row.text").alias("text"))
    again = sized.groupBy("digest").count().filter("count > 1").select("digest", F.lit(True).alias("again"))
    drawn = sized.join(again, "digest", "left").withColumn(
        "draw", F.when(F.col("again"), F.concat_ws("|", "digest", "number")).otherwise(F.col("digest")))
    plan = mixing.pareto_mix(drawn, key="number", draw="draw").filter("copies > 0").select("number", "copies")
    return rows.join(plan, "number").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the sequences."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates),
          ("secret scans", secret_scan), ("mixing sources", mix_sources), ("best-fit packing", pack_sequences)]

#: The classifier and the packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = before = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
        before = docs
    return docs
