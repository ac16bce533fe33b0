"""Columns of alignment records, flag bits, and helpers for the typed tags.

A record has qname, flag, rname_id, pos, mapq, cigar, mrnm_id, mpos, isize, seq, qual and tags, and its place in the
input: file_ordinal, rec_no. Operators use the columns they need; ``have`` supplies defaults for missing ones.
References are ids into ``refs(rname_id, sq_name, sq_length)``, null if invalid; positions start at 0, -1 if invalid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSED, MATE_REVERSED, FIRST, SECOND = 0x10, 0x20, 0x40, 0x80
SECONDARY, FAILED, DUPLICATE = 0x100, 0x200, 0x400

TRIMMED, MERGED, ALTERNATIVE, EXACT_INDEX = 1, 2, 4, 8

TAG = T.StructType([T.StructField("t", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("s", T.StringType())])
TAGS = T.MapType(T.StringType(), TAG)

RECORD = T.StructType([
    T.StructField("qname", T.StringType()), T.StructField("flag", T.IntegerType()), T.StructField("rname_id", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()), T.StructField("cigar", T.StringType()),
    T.StructField("mrnm_id", T.IntegerType()), T.StructField("mpos", T.IntegerType()), T.StructField("isize", T.IntegerType()),
    T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()), T.StructField("tags", TAGS),
    T.StructField("file_ordinal", T.IntegerType()), T.StructField("rec_no", T.LongType()),
])
REFS = "rname_id int, sq_name string, sq_length int"
READ_GROUPS = "rg_id string, lb string, sm string"



def have(df: DataFrame, *names: str) -> DataFrame:
    """df with those of the record's columns that it lacks, at their defaults."""
    values = {"flag": 0, "pos": -1, "mapq": 0, "mpos": -1, "isize": 0, "file_ordinal": 0, "rec_no": 0}
    for n in names:
        if n not in df.columns:
            kind = RECORD[n].dataType
            df = df.withColumn(n, F.lit(values.get(n)).cast(kind))
    return df


def bit(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) != 0


def clear(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(F.lit(~mask))


def set_bits(flag: Column, mask: int, where: Column | None = None) -> Column:
    on = flag.bitwiseOR(F.lit(mask))
    return on if where is None else F.when(where, on).otherwise(flag)


def tag_int(value: Column) -> Column:
    return F.struct(F.lit("i").alias("t"), value.cast("long").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("string").alias("s"))


def tag_text(value: Column) -> Column:
    return F.struct(F.lit("Z").alias("t"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("f"), value.cast("string").alias("s"))


def tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, F.lit(key))


def tag_number(tags: Column, key: str) -> Column:
    """Value of a numeric tag, else 0."""
    x = tag(tags, key)
    return F.coalesce(F.when(x["t"] == "i", x["i"].cast("double")), F.when(x["t"] == "f", x["f"]), F.lit(0.0))


def tag_string(tags: Column, key: str) -> Column:
    """Value of a text tag, else the empty string."""
    x = tag(tags, key)
    return F.coalesce(F.when(x["t"].isin("Z", "H", "A"), x["s"]), F.lit(""))


def put_tags(tags: Column, values: dict[str, Column]) -> Column:
    """tags with some keys set anew."""
    keys = F.array(*map(F.lit, values))
    rest = F.map_filter(F.coalesce(tags, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(T.ArrayType(TAG)))), lambda k, _: ~F.array_contains(keys, k))
    return F.map_concat(rest, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
