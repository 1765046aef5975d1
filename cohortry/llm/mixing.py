"""Mixing sources to target weights by Pareto order sampling.

A source's target gives each of its documents target / source size expected copies. The
whole copies are certain; for the rest every document draws a uniform number from a hash
of its id, documents are ranked by its odds divided by the odds of the rest (Pareto
order), and are taken in this order until the words left to take are used up. A document
larger than what is left is passed over and the order goes on behind it, so a long
document does not end its source. One closing document, the one whose size comes nearest
to the gap, ends the source if that brings it nearer to its target; the miss is at most
half the smallest document left out. Copies are whole, so no document passes the cap.

No source is ever sorted as a whole: ranks are cut into about sqrt(n) ranges per source,
summed map-side, and only the range in which the words run out is ordered.

Null sources form a group of their own, last in order. Null and empty texts have size 0,
are never taken and count nothing. Rows equal in id and size are taken alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import Scratch

#: Weights of the sources in code point order, repeating; most copies of a document.
WEIGHTS, CAP = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point with nulls last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 bits from the md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: ``n``, ``source_size``, ``target``. Input columns: skey, size.

    The total is shared by weight; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight. Sources fill up in order of cap * size /
    weight, so the level at which it stops follows from running sums over the sources
    (one row per source; the only window that is not partitioned).
    """
    per = sizes.groupBy("skey").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", weight).withColumn("full", F.col("source_size") * cap)
    before = Window.orderBy(F.col("full") / F.col("w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("skey")
    per = (per.withColumn("total", F.sum("source_size").over(everything))
           .withColumn("total_w", F.sum("w").over(everything))
           .withColumn("full_before", F.coalesce(F.sum("full").over(before), F.lit(0)))
           .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
           .withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("total_w") - F.col("w_before"))))
    # the first source in filling order that stays below its cap sets the level for all
    filling = F.row_number().over(Window.orderBy(F.col("full") / F.col("w"), "skey"))
    per = per.withColumn("filling", filling)
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct("filling", "level"))).over(everything)["level"]
    target = F.least(F.col("full").cast("double"), F.col("w") * F.coalesce(level, F.lit(0.0)))
    return per.select("skey", "n", "source_size", target.alias("target"))


def place() -> Column:
    """Place of a document in its source's Pareto order."""
    return F.struct("q", F.col("key").isNotNull().alias("known"), "key", "size")


def _ended(drawn: DataFrame) -> DataFrame:
    """Sources whose drawn documents pass their ``words``: the first rank past them (``cut``) and the ``gap`` before it."""
    in_source = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (drawn.groupBy("skey", "range").agg(F.sum("size").alias("held"), F.first("words").alias("words"))
              .withColumn("before", F.coalesce(F.sum("held").over(in_source), F.lit(0))))
    last = (ranges.filter(F.col("before") + F.col("held") > F.col("words")).groupBy("skey")
            .agg(F.min_by(F.struct("range", "before"), "range").alias("edge"))
            .select("skey", F.col("edge.range").alias("edge_range"), F.col("edge.before").alias("edge_before")))
    running = F.sum("size").over(Window.partitionBy("skey").orderBy("q", "key", "size")
                                 .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = (drawn.join(last, "skey").filter(F.col("range") == F.col("edge_range"))
            .withColumn("running", running + F.col("edge_before")))
    return edge.groupBy("skey").agg(
        F.min(F.when(F.col("running") > F.col("words"), place())).alias("cut"),
        F.coalesce(F.max(F.when(F.col("running") <= F.col("words"), F.col("running"))), F.min("edge_before")).alias("filled"),
        F.first("words").alias("words")).withColumn("gap", F.col("words") - F.col("filled")).drop("words")


def _go_on(drawn: DataFrame, cut: DataFrame, scratch: Scratch) -> DataFrame:
    """``cut`` with the ``gap`` left after all later documents that fit, and the ``steps`` that take them.

    A step takes what ranks between ``after`` and ``before`` and has ``most`` words at
    most; behind its end the next one goes on with the smaller gap, until nothing fits.
    """
    rank = dict(drawn.select(place().alias("rank")).dtypes)["rank"]
    state = scratch.keep(cut.select("skey", "cut", "gap", F.col("cut").alias("at"), F.array().cast(
        f"array<struct<after:{rank},before:{rank},most:double>>").alias("steps")))
    while state.filter("at is not null").head() is not None:
        open_ = state.filter("at is not null").select("skey", "at", F.col("gap").alias("words"))
        left = drawn.drop("words").join(open_, "skey").filter((place() > F.col("at")) & (F.col("size") <= F.col("words"))).drop("at")
        held = left.groupBy("skey").agg(F.sum("size").alias("held"))
        ends = _ended(left).select("skey", F.col("cut").alias("next"), F.col("gap").alias("next_gap"))
        step = F.struct(F.col("at").alias("after"), F.col("next").alias("before"), F.col("gap").alias("most"))
        after = scratch.keep(state.join(held, "skey", "left").join(ends, "skey", "left").select(
            "skey", "cut", F.coalesce("next_gap", F.col("gap") - F.coalesce("held", F.lit(0))).alias("gap"),
            F.col("next").alias("at"),
            F.when(F.col("held").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array(step))).alias("steps")))
        scratch.drop(state)
        state = after
    return state.drop("at")


def pareto_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
               weights: tuple = WEIGHTS, cap: int = CAP, seed: int = 1, draw: str | None = None) -> DataFrame:
    """One row per document: key, size, source_size, target, copies, taken.

    The random number of a row is hashed from the column ``draw``, by default from ``key``.
    """
    scratch = Scratch(docs.sparkSession)
    sized = scratch.keep(docs.select(
        F.col(key).alias("key"), source_key(F.col(source)).alias("skey"),
        word_count(F.col(text)).alias("size"), uniform(F.col(draw or key), seed).alias("u")))
    per = scratch.keep(targets(sized, weights, cap))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("ratio", copies).withColumn("whole", F.floor("ratio"))
    per = per.withColumn("rest", F.col("ratio") - F.col("whole"))
    per = per.withColumn("words", F.col("rest") * F.col("source_size"))
    per = per.withColumn("ranges", F.ceil(F.sqrt("n")))
    # Pareto order: odds of the draw over odds of inclusion, as a share p of one again
    # (null where there is no rest: a capped source takes whole copies only)
    order = (F.col("u") / (1 - F.col("u"))) / F.nullif(F.col("rest") / (1 - F.col("rest")), F.lit(0.0))
    drawn = (sized.join(per, "skey").filter((F.col("rest") > 0) & (F.col("size") > 0))
             .withColumn("q", order)
             .withColumn("range", F.least(F.floor(F.col("u") * F.col("ranges")), F.col("ranges") - 1))
             .select("key", "skey", "size", "q", "range", "words"))
    drawn = scratch.keep(drawn)
    cut, held = _go_on(drawn, scratch.keep(_ended(drawn)), scratch), F.sum("size")
    later = F.exists("steps", lambda s: (place() > s["after"]) & (s["before"].isNull() | (place() < s["before"]))
                     & (F.col("size") <= s["most"]))
    after = drawn.join(cut, "skey").filter((place() >= F.col("cut")) & ~later)
    close = (after.groupBy("skey", place().alias("rank")).agg(held.alias("held"), F.first("gap").alias("gap"))
             .filter(F.col("held") < 2 * F.col("gap")).groupBy("skey").agg(F.min(F.struct(
                 F.abs(F.col("held") - F.col("gap")).alias("miss"), "rank")).alias("best"))
             .select("skey", F.col("best.rank").alias("closing")))
    plan = scratch.keep(per.join(cut, "skey", "left").join(close, "skey", "left"))
    out = sized.join(plan, "skey").withColumn("q", order)
    taken = (F.col("rest") > 0) & (F.col("size") > 0) & (
        F.col("cut").isNull() | (place() < F.col("cut")) | F.coalesce(later, F.lit(False))
        | F.coalesce(place() == F.col("closing"), F.lit(False)))
    out = out.withColumn("copies", F.col("whole") + F.when(taken, 1).otherwise(0))
    return out.select("key", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"),
                      (F.col("copies") * F.col("size")).cast("long").alias("taken")).withColumnRenamed("key", key)


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (CAST('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
per AS (
  SELECT skey, count(*) AS n, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
placed AS (
  SELECT *, [5.0, 2.0, 1.0][(((row_number() OVER (ORDER BY skey)) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w,
         source_size * 3 AS full_size FROM per),
filled AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER () AS total_w,
         coalesce(sum(full_size) OVER b, 0)::BIGINT AS full_before, coalesce(sum(w) OVER b, 0.0) AS w_before
  FROM placed
  WINDOW b AS (ORDER BY full_size::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (total - full_before)::DOUBLE / (total_w - w_before) AS level,
         row_number() OVER (ORDER BY full_size::DOUBLE / w, skey) AS filling FROM filled),
goal AS (
  SELECT skey, source_size, least(full_size::DOUBLE, w * coalesce(
           (SELECT arg_min(level, filling) FROM levels WHERE level * w <= full_size), 0.0)) AS target FROM levels),
ratio AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS r FROM goal),
rest AS (
  SELECT *, floor(r) AS whole, r - floor(r) AS rest FROM ratio),
drawn AS (
  SELECT s.doc_id, s.size, r.*, (u / (1 - u)) / (rest / (1 - rest)) AS q, rest * source_size AS words
  FROM sized s JOIN rest r USING (skey)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY q, doc_id) AS nth FROM drawn WHERE rest > 0 AND size > 0),
walk AS (
  SELECT skey, 0::BIGINT AS nth, any_value(words) AS room, FALSE AS early FROM ordered GROUP BY skey
  UNION ALL
  SELECT o.skey, o.nth, CASE WHEN o.size <= w.room THEN w.room - o.size ELSE w.room END, o.size <= w.room
  FROM walk w JOIN ordered o ON o.skey = w.skey AND o.nth = w.nth + 1),
gaps AS (
  SELECT skey, min(room) AS gap FROM walk GROUP BY skey),
closing AS (
  SELECT skey, nth FROM ordered JOIN walk USING (skey, nth) JOIN gaps USING (skey)
  WHERE NOT early AND size < 2 * gap
  QUALIFY row_number() OVER (PARTITION BY skey ORDER BY abs(size - gap), nth) = 1),
taken AS (
  SELECT o.doc_id, o.skey FROM ordered o JOIN walk USING (skey, nth) WHERE early
  UNION ALL SELECT o.doc_id, o.skey FROM ordered o JOIN closing USING (skey, nth)),
closed AS (
  SELECT d.*, whole + CASE WHEN t.doc_id IS NULL THEN 0 ELSE 1 END AS times
  FROM drawn d LEFT JOIN taken t ON d.doc_id = t.doc_id AND d.skey = t.skey)
SELECT doc_id, size, source_size, target, times::INTEGER AS copies, (times * size)::BIGINT AS taken
FROM closed
"""
