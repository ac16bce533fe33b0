"""Best of several alignments of each read: files joined by read, ranked by a score of tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S

PRESETS = {"bwa": {"XM": 30, "XO": 45, "XG": 15}, "anfo": {"UQ": 1}, "blat": {"NM": 30}, "blast": {"AS": -3}}


def score(value=None, weights: dict[str, int] | None = None) -> Column:
    """The lower the better; a missing tag counts as 0. value: the column of a tag's number, else taken from tags."""
    value = value or (lambda k: S.tag_number(F.col("tags"), k))
    total = F.lit(0)
    for k, w in (PRESETS["bwa"] if weights is None else weights).items():
        total = total + value(k) * w
    return total.cast("int")


def by_name(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds occurrence: the i-th record of a name in one file goes with the i-th of it in the others; a file may lack it."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy("qname", "file_ordinal").orderBy(*order)))


def in_step(df: DataFrame) -> DataFrame:
    """Adds occurrence for files that have the same reads in the same order: the record's number. Differing names are an error."""
    w = Window.partitionBy("rec_no")
    same = F.min("qname").over(w).eqNullSafe(F.max("qname").over(w))
    return df.withColumn("occurrence", F.when(same, F.col("rec_no")).otherwise(F.raise_error(F.concat(F.lit("names differ in record "), F.col("rec_no").cast("string"))).cast("long")))


def meld(df: DataFrame, n_files: int, unmapped: Column, score_: Column, key: list[str] | None = None, refs: DataFrame | None = None) -> DataFrame:
    """One record per read: the mapped one with the least score, files 2, 3, ..., n, 1 in ties (ordinals from 1).

    mapq: unchanged with one mapped record, else at most the distance to the second score. If records have tags and
    refs is given, XA lists the others (ref,±pos,cigar,NM, positions from 0) in order and then older entries. With none mapped,
    the first in file order is given as it is. A group has at most one record per file, so it is small.
    """
    key = key or ["qname", "occurrence"]
    columns = [c for c in df.columns if c not in key]
    xa = refs is not None and "tags" in columns
    if xa:
        df = df.join(F.broadcast(refs.select(F.col("rname_id").alias("_ref"), F.col("sq_name").alias("_name"))), F.col("rname_id") == F.col("_ref"), "left").drop("_ref")
    extra = ["_name"] if xa else []
    rank = F.pmod(F.col("file_ordinal") - 2, F.lit(n_files))
    entry = F.struct(unmapped.cast("int").alias("u"), F.when(unmapped, F.lit(0)).otherwise(score_).alias("s"), rank.cast("int").alias("o"), F.struct(*columns, *extra).alias("r"))
    less = lambda a, b: F.when(a["u"] != b["u"], a["u"] - b["u"]).when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["o"] - b["o"])
    g = df.groupBy(*key).agg(F.array_sort(F.collect_list(entry), less).alias("l"))
    mapped = F.filter("l", lambda x: x["u"] == 0)
    g = g.withColumn("m", mapped).withColumn("best", F.element_at("l", 1))
    several = F.size("m") > 1
    distance = F.element_at("m", F.when(several, 2).otherwise(1))["s"] - F.element_at("m", 1)["s"]
    out = g.withColumn("_mapq", F.when(several, F.least(F.col("best.r.mapq"), distance)).otherwise(F.col("best.r.mapq")).cast("int"))
    new = {"mapq": F.col("_mapq")}
    if xa:
        one = lambda x: F.concat_ws(",", x["r"]["_name"], F.concat(F.when(S.bit(x["r"]["flag"], S.REVERSED), "-").otherwise("+"), x["r"]["pos"].cast("string")), x["r"]["cigar"], S.tag_number(x["r"]["tags"], "NM").cast("int").cast("string"))
        others = F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1))), one)
        old = F.filter(F.flatten(F.transform("m", lambda x: F.split(S.tag_string(x["r"]["tags"], "XA"), ";"))), lambda x: x != "")
        text = F.array_join(F.concat(F.when(several, others).otherwise(F.array().cast("array<string>")), old), ";")
        new["tags"] = F.when(F.size("m") > 0, S.put_tags(F.col("best.r.tags"), {"XA": S.tag_text(text)})).otherwise(F.col("best.r.tags"))
    return out.select(*key, *[new.get(c, F.col(f"best.r.{c}")).alias(c) for c in columns])
