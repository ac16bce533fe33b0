"""Mixing sources to target weights by hash thresholds.

Native: DataFrame functions only. Words are summed by source and by the leading bits of a hash of doc_id; the
running sums of a source's buckets (4096 at most) show the bucket in which the budget ends, and only that
bucket is split by the next bits, three times. What lies below the threshold is taken, so documents are
filtered without sorting them, and the sets of growing budgets are nested. Sums are formed before each
shuffle, so a hot source costs no more than another.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating. They share 150 % of all words;
no source gets more than twice its words, and what is left over is shared again by weight until none is above.
A target of t times the source's words takes every document floor(t) times and once more those below the
threshold; the document in which the budget ends gives the rest of the words.

Windows over all sources run in one task up to BROADCAST_ROWS sources (counted), by ranges beyond.

Defined results: a null or empty text has size 0 and is never taken; null is a source of its own; a row without id goes by its text; sources
without words have target 0; repeated rows are documents of their own (rows equal in id and text lie next to each
other, and ``mix`` treats them alike at the threshold); other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACED, materialize

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS, LEVELS, DIGITS = 12, 3, 12
BROADCAST_ROWS = 100_000
SALT = 64


def place(column: str = "doc_id", text: str = "text"):
    """48 bits of a hash of the id, or of the text where there is none, that other engines have as well."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.md5(text), F.lit(""))), 1, DIGITS), 16, 10).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(SPACED)), F.lit(0)).cast("long").alias("size"), place().alias("h"))


def _running(df: DataFrame, order: list, sums: dict, few: bool) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows before. Few rows are summed in one task, others by ranges, whose totals are summed then."""
    if few:
        w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(v).over(w), F.lit(0)) for k, v in sums.items()})
    ranges = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before, inside = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_p").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    totals = totals.select(F.col("_p").alias("_r"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    out = ranges.join(F.broadcast(totals), F.col("_p") == F.col("_r"))  # a row for each range
    return out.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_{k}") for k, v in sums.items()}).drop("_p", "_r", *[f"_{k}" for k in sums])


def _attach(df: DataFrame, side: DataFrame, few: bool, *on) -> DataFrame:
    """df with the one row of side (k_source, ...) of its source. Where there are too many sources to send them to all tasks, a source's rows are dealt out among SALT copies of its row."""
    same = F.col("source").eqNullSafe(F.col("k_source"))
    for x in on:
        same = same & x
    if few:
        return df.join(F.broadcast(side), same)
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64("h"), F.lit(SALT)).cast("int"))
    return dealt.join(side.withColumn("k_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), same & (F.col("_salt") == F.col("k_salt"))).drop("_salt", "k_salt")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, bool]:
    """source, source_size, target, one row per source; and whether these are few."""
    s = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    few = s.count() <= BROADCAST_ROWS
    s = _running(s, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, few)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * most)
    s = s.withColumn("full_at", F.col("most") / F.col("weight"))
    total = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    s = _running(s, [F.col("full_at"), F.col("source").asc_nulls_last()], {"_full": F.col("most"), "_weights": F.col("weight")}, few)
    s = s.withColumn("level", (share * F.lit(total["size"] or 0) - F.col("_full")) / (F.lit(total["weight"] or 0) - F.col("_weights")))
    s = materialize(s.withColumn("open", F.col("full_at") > F.col("level")))
    # Levels rise along the full sources up to the first open one, and fall behind it: that one's holds for all.
    level = F.lit(s.where("open").agg(F.max("level").alias("level")).first()["level"]).cast("double")
    return s.select("source", "source_size", F.when(F.col("open"), F.least(F.col("most").cast("double"), F.col("weight") * level)).otherwise(F.col("most").cast("double")).alias("target")), few


def thresholds(sizes: DataFrame, goal: DataFrame, few: bool = True) -> DataFrame:
    """goal with full (copies of everything) and, of the last level, edge (bits of the boundary bucket) and need (words to take of it)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = goal.withColumn("full", whole)
    t = t.withColumn("need", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long")).withColumn("edge", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = 48 - BITS * level
        side = t.select(F.col("source").alias("k_source"), F.col("edge").alias("k_edge"), F.col("need").alias("k_need"))
        inside = _attach(sizes, side, few, *([F.shiftright("h", shift + BITS) == F.col("k_edge")] if level > 1 else []))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.first("k_need").alias("need"))
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        edge = run.where(F.col("upto") > F.col("need")).groupBy("source").agg(F.min(F.struct("b", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("e"))
        edge = edge.select(F.col("source").alias("k_source"), F.col("e.b").alias("n_edge"), F.col("e.left").alias("n_need"))
        t = t.join(edge, F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_source")
        # No bucket ends the budget only where a source has no words.
        t = materialize(t.withColumn("edge", F.coalesce("n_edge", F.lit(0))).withColumn("need", F.coalesce("n_need", F.lit(0))).drop("n_edge", "n_need"))
    return t


def plan(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, bool]:
    """Written sizes and thresholds, and whether the latter are few enough to broadcast."""
    sizes = materialize(measure(docs))
    goal, few = targets(sizes, **options)
    return sizes, thresholds(sizes, goal, few), few


def _extra(sizes: DataFrame, t: DataFrame, few: bool) -> DataFrame:
    d = _attach(sizes, t.withColumnRenamed("source", "k_source"), few).withColumn("_at", F.shiftright("h", 48 - BITS * LEVELS))
    clear = d.where(F.col("_at") != F.col("edge")).withColumn("extra", F.when(F.col("_at") < F.col("edge"), F.col("size")).otherwise(0).cast("long"))
    w = Window.partitionBy("source").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    # Documents that share 36 bits with the boundary: one or two per source, or copies of one row.
    near = d.where(F.col("_at") == F.col("edge")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.coalesce(F.sum("size").over(w), F.lit(0)))).cast("long"))
    return clear.unionByName(near)


def allot(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    d = _extra(*plan(docs, **options))
    return d.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs filtered and repeated: whole texts only, the document at the threshold if at least half of it is due. Texts are not shuffled."""
    sizes, t, few = plan(docs, **options)
    near = _extra(sizes, t, few).where(F.shiftright("h", 48 - BITS * LEVELS) == F.col("edge")).where(2 * F.col("extra") >= F.col("size")).where("size > 0")
    near = near.select(F.col("doc_id").alias("__lw_d"), F.col("text_hash").alias("__lw_k")).distinct().withColumn("__lw_due", F.lit(1))
    cols = docs.columns
    side = t.select(F.col("source").alias("__lw_s"), F.col("edge").alias("__lw_edge"), F.col("full").alias("__lw_full"))
    d = docs.withColumn("__lw_h", place()).withColumn("__lw_at", F.shiftright("__lw_h", 48 - BITS * LEVELS))
    if few:
        d = d.join(F.broadcast(side), F.col("source").eqNullSafe(F.col("__lw_s")))
    else:
        side = side.withColumn("__lw_k_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        d = d.withColumn("__lw_salt", F.pmod(F.xxhash64("__lw_h"), F.lit(SALT)).cast("int")).join(side, F.col("source").eqNullSafe(F.col("__lw_s")) & (F.col("__lw_salt") == F.col("__lw_k_salt")))
    d = d.join(F.broadcast(near) if few else near, (F.col("__lw_at") == F.col("__lw_edge")) & F.col("doc_id").eqNullSafe(F.col("__lw_d")) & (F.xxhash64("text") == F.col("__lw_k")), "left")
    copies = F.when(F.coalesce("text", F.lit("")).rlike(SPACED), F.col("__lw_full") + F.when(F.col("__lw_at") < F.col("__lw_edge"), 1).otherwise(F.coalesce("__lw_due", F.lit(0)))).otherwise(0)
    return d.withColumn("__lw_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*cols)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size AS most, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(CAST(sum(2 * source_size) OVER w AS DOUBLE), 0))
  / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, most / weight > level AS open FROM l),
g AS (SELECT source, source_size, CASE WHEN open THEN least(CAST(most AS DOUBLE), weight * (SELECT max(level) FROM o WHERE open)) ELSE CAST(most AS DOUBLE) END AS target FROM o),
f AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, CAST(round(target - copies * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM f
"""
