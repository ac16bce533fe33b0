"""Sorting, run grouping, scans of reference ranges, exact samples of groups."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def sort_records(df: DataFrame, *ties: str) -> DataFrame:
    """By reference and position, invalid references last."""
    return df.orderBy(F.col("rname_id").asc_nulls_last(), "pos", *ties)


def merge(inputs: list[DataFrame], *ties: str) -> DataFrame:
    """Inputs in coordinate order as one; file_ordinal says where each record comes from."""
    return sort_records(concat(inputs), *ties)


def concat(inputs: list[DataFrame]) -> DataFrame:
    out = None
    for n, df in enumerate(inputs):
        df = df.withColumn("file_ordinal", F.lit(n))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs")
    return out


def concat_refs(inputs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(records, refs) of several files as one. The first file's references come first, then those of the last, the last but one and so on; reference ids are shifted by the number of references before."""
    refs, records, shift = None, {}, 0
    for n in [0, *range(len(inputs) - 1, 0, -1)]:
        df, r = inputs[n]
        moved = r.withColumn("rname_id", (F.col("rname_id") + shift).cast("int"))
        refs = moved if refs is None else refs.unionByName(moved)
        records[n] = df.withColumns({c: (F.col(c) + shift).cast("int") for c in ("rname_id", "mrnm_id") if c in df.columns})
        shift += r.count()  # a header's references
    return concat([records[n] for n in range(len(inputs))]), refs


def parse_range(which: str) -> tuple[int, int] | None | str:
    """A: everything; U: unaligned; n or n-m: references counted from 1; letters in either case. As None, "U", or ids from 0 with both ends."""
    which = which.upper()
    if which == "A":
        return None
    if which == "U":
        return "U"
    a, _, b = which.partition("-")
    if not a.isdigit() or (b and not b.isdigit()):
        raise ValueError(f"{which} is no range of references")
    return int(a) - 1, int(b or a) - 1


def range_scan(df: DataFrame, which: str) -> DataFrame:
    """Records of a range of references: a filter that reaches the scan, and prunes files partitioned by rname_id."""
    r = parse_range(which)
    if r is None:
        return df
    return df.where("rname_id is null") if r == "U" else df.where(F.col("rname_id").between(*r))


#: Rows of a stretch in run_ids.
STRETCH = 200_000


def run_ids(df: DataFrame, key: str, order: list[str], within: list[str]) -> DataFrame:
    """Adds run: the number, within ``within``, of the run of adjacent records with one key.

    The first column of ``order``, if it is a number, is cut in stretches at its quantiles. Runs are numbered in each stretch by itself;
    then one row of each stretch says how many runs there were before, so that no task has all records of a group.
    """
    cuts = []
    if isinstance(df.schema[order[0]].dataType, T.NumericType):
        n = min(-(-df.count() // STRETCH), 10_000)
        if n > 1:
            cuts = df.agg(F.percentile_approx(order[0], [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted({float(c) for c in cuts or []})
    df = _stretch(df, order[0], cuts)
    w = Window.partitionBy(*within, "_at").orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 0).when(F.lag(key).over(w).eqNullSafe(F.col(key)) & F.col(key).isNotNull(), 0).otherwise(1)
    local = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    ends = local.groupBy(*within, "_at").agg(F.min_by(F.struct(F.col(key).alias("k")), F.struct(*order)).alias("_a"), F.max_by(F.struct(F.col(key).alias("k")), F.struct(*order)).alias("_z"), F.max("_run").alias("_n"))
    v = Window.partitionBy(*within).orderBy("_at")
    same = F.coalesce(F.lag("_z.k").over(v) == F.col("_a.k"), F.lit(False))
    ends = ends.withColumn("_joins", F.when(same, 0).otherwise(1))
    before = F.sum(F.col("_joins") + F.col("_n")).over(v) - F.col("_n")
    ends = F.broadcast(ends.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_at").alias("_to"), before.alias("_before")))  # a row for each stretch
    on = F.col("_at") == F.col("_to")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    return local.join(ends, on).withColumn("run", F.col("_before") + F.col("_run")).drop("_at", "_to", "_new", "_run", "_before", *[f"_w{i}" for i in range(len(within))])


def _stretch(df: DataFrame, column: str, cuts: list[float]) -> DataFrame:
    """Adds _at: how many cuts lie at or below the value; -1 for null, which comes first."""
    if not cuts:
        return df.withColumn("_at", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_at", handleInvalid="keep").transform(df.withColumn("_x", F.col(column).cast("double")))
    return found.withColumn("_at", F.when(F.col("_x").isNull(), -1).otherwise(F.col("_at").cast("int"))).drop("_x")


def count_groups(df: DataFrame, key: str) -> DataFrame:
    """How many keys there are."""
    return df.agg(F.count_distinct(key).alias("groups"))


def ensure_sorted(df: DataFrame, key: str, within: str = "file_ordinal", order: str = "rec_no") -> DataFrame:
    """df; a record whose key is smaller than that of the one before it is an error."""
    before = F.lag(key).over(Window.partitionBy(within).orderBy(order))
    wrong = F.raise_error(F.concat(F.lit("not sorted: "), F.col(key).cast("string"))).cast(df.schema[key].dataType)
    return df.withColumn(key, F.when(before > F.col(key), wrong).otherwise(F.col(key)))


def sample_groups(df: DataFrame, key: str, m: int, seed: str = "") -> DataFrame:
    """All records of exactly m keys, chosen by a hash of key and seed; fewer keys than m are an error."""
    keys = df.select(key).distinct()
    chosen = keys.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(m)
    # The check is part of the plan and fails with the action; m keys are in one task after the limit anyway.
    short = F.when(F.count("*").over(Window.partitionBy()) < m, F.raise_error(F.lit(f"there are fewer than {m} groups")).cast("boolean")).otherwise(True)
    chosen = chosen.withColumn("_ok", short).where("_ok").select(F.col(key).alias("_key"))
    return df.join(chosen, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
