"""FastQ and FastA as a Spark data source, and the conventions of read names."""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..shipping import ship_code

_SCHEMA = "qname string, description string, seq string, qual string, file_ordinal int, rec_no bigint"


class _File(InputPartition):
    def __init__(self, path: str, ordinal: int):
        self.path, self.ordinal = path, ordinal


def parse(stream) -> Iterator[tuple[str, str, str, str | None]]:
    """name, description, sequence, qualities (None in FastA) of each record; both kinds may be mixed, and sequences may have several lines."""
    line = stream.readline()
    while line:
        line = line.rstrip("\r\n")
        if not line:
            line = stream.readline()
            continue
        mark, head = line[0], line[1:]
        if mark not in ">@":
            raise ValueError(f"no header: {line[:40]}")
        name, _, description = head.partition(" ")
        seq, line = [], stream.readline()
        while line and line[0] not in "+>" and not (mark == ">" and line[0] == "@"):
            seq.append(line.strip())
            line = stream.readline()
        s = "".join(seq)
        if mark == "@" and line[:1] == "+":
            qual = ""
            while len(qual) < len(s):
                line = stream.readline()
                if not line:
                    raise ValueError(f"{name}: the file ends within the qualities")
                qual += line.rstrip("\r\n")
            if not s:
                stream.readline()
            yield name, description, s, qual
            line = stream.readline()
        else:
            yield name, description, s, None


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p, n) for n, p in enumerate(self.paths)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            packed = f.read(2) == b"\x1f\x8b"
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        types = [pa.string()] * 4 + [pa.int32(), pa.int64()]
        with gzip.open(partition.path, "rt") if packed else open(partition.path) as f:
            rows, n = [], 0
            for r in parse(f):
                rows.append((*r, partition.ordinal, n))
                n += 1
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class FastqSource(DataSource):
    """One task per file, in bounded memory; gzip is recognised by its first bytes. Paths on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file:")
        paths = [p for part in path.split(",") for p in (sorted(glob.glob(os.path.join(part, "*"))) if os.path.isdir(part) else sorted(glob.glob(part)))]
        if not paths:
            raise ValueError(f"no files: {path}")
        return _Reader(paths)


def read_fastq(spark: SparkSession, path: str, warts: bool = True) -> DataFrame:
    """Unaligned records of FastQ or FastA files, with what their names say in flags and tags."""
    ship_code(spark)
    spark.dataSource.register(FastqSource)
    df = spark.read.format("fastq").load(path)
    df = df.withColumns({"flag": F.lit(S.UNMAPPED), "tags": F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<t:string,i:bigint,f:double,s:string>>>"))})
    return remove_warts(df) if warts else df.drop("description")


def _strip_prefixes(name: Column) -> tuple[Column, Column]:
    """The prefixes of a name (letters F R M T C) and the name without them; C may stand before or after another."""
    head = F.regexp_extract(name, r"^((?:C_)?(?:[FRMT]_)?(?:C_)?)", 1)
    return head, F.substring(name, F.length(head) + 1, F.length(name))


def remove_warts(df: DataFrame) -> DataFrame:
    """Flags and tags from names: /1 /2, F_ R_ (mates), M_ (merged), T_ (trimmed), C_ (XP -1), #INDEX[,INDEX], and the first word of
    the description if it has four fields between colons (mate, failed if Y, -, index)."""
    head, rest = _strip_prefixes(F.col("qname"))
    df = df.withColumns({"_p": head, "_n": rest}).withColumn("_m", F.regexp_extract("_n", r"/([12])$", 1))
    df = df.withColumn("_n", F.regexp_replace("_n", r"/[12]$", ""))
    index = lambda i: F.nullif(F.regexp_extract("_n", r"#([ACGTNacgtn]+)(?:,([ACGTNacgtn]+))?$", i), F.lit(""))
    word = F.split(F.split(F.coalesce("description", F.lit("")), " ")[0], ":")
    df = df.withColumns({"_x1": index(1), "_x2": index(2), "_d": F.when(F.size(word) >= 4, word)})
    df = df.withColumn("_m2", F.get("_d", F.lit(0)))
    # The mate comes apart of the name first; the description overrides.
    name = F.regexp_replace("_n", r"#[ACGTNacgtn]+(?:,[ACGTNacgtn]+)?$", "")
    again = F.regexp_extract(name, r"/([12])$", 1)
    mate = F.coalesce(F.when(F.col("_m2").isin("1", "2"), F.col("_m2")), F.nullif("_m", F.lit("")), F.nullif(again, F.lit("")), F.when(F.contains("_p", F.lit("F_")), "1").when(F.contains("_p", F.lit("R_")), "2"))
    flag = F.col("flag")
    flag = F.when(mate == "1", flag.bitwiseOR(S.PAIRED | S.MATE_UNMAPPED | S.FIRST)).when(mate == "2", flag.bitwiseOR(S.PAIRED | S.MATE_UNMAPPED | S.SECOND)).otherwise(flag)
    flag = F.when(F.get("_d", F.lit(1)) == "Y", flag.bitwiseOR(S.FAILED)).otherwise(flag)
    ff = F.when(F.contains("_p", F.lit("M_")), S.MERGED).when(F.contains("_p", F.lit("T_")), S.TRIMMED)
    xi = F.coalesce(F.nullif(F.get("_d", F.lit(3)), F.lit("")), "_x1")
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
            ("FF", F.when(ff.isNotNull(), S.tag_int(ff))), ("XP", F.when(F.contains("_p", F.lit("C_")), S.tag_int(F.lit(-1)))),
            ("XI", F.when(xi.isNotNull(), S.tag_text(xi))), ("XJ", F.when(F.col("_x2").isNotNull(), S.tag_text(F.col("_x2")))),
        )]
    )
    new = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    keep = [c for c in df.columns if c[0] != "_" and c != "description"]
    return df.withColumns({"qname": F.regexp_replace(name, r"/[12]$", ""), "flag": flag, "tags": F.map_concat(F.map_filter("tags", lambda k, _: ~F.map_contains_key(new, k)), new)}).select(*keep)


def zip_mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """r1, r2 of two files' records in step; names that differ are an error."""
    a = first.select(F.col("file_ordinal").alias("_f"), F.col("rec_no").alias("_n"), F.struct(*first.columns).alias("r1"))
    b = second.select(F.col("file_ordinal").alias("_f"), F.col("rec_no").alias("_n"), F.struct(*second.columns).alias("r2"))
    both = a.join(b, ["_f", "_n"], "full")
    same = F.col("r1.qname").eqNullSafe(F.col("r2.qname"))
    return both.select(F.when(same, F.col("r1")).otherwise(F.raise_error(F.concat(F.lit("names of mates differ: "), F.coalesce("r1.qname", F.lit("none")), F.lit(" "), F.coalesce("r2.qname", F.lit("none")))).cast(both.schema["r1"].dataType)).alias("r1"), "r2")


def with_index(records: DataFrame, index: DataFrame, number: int = 1) -> DataFrame:
    """records with an index read of a parallel file as XI, YI (number 1) or XJ, YJ (2); the quality tag is left out if empty; names that differ are an error."""
    seq, qual = (("XI", "YI"), ("XJ", "YJ"))[number - 1]
    i = index.select(F.col("file_ordinal").alias("_f"), F.col("rec_no").alias("_n"), F.col("qname").alias("_q"), F.col("seq").alias("_s"), F.col("qual").alias("_y"))
    df = records.join(i, (F.col("file_ordinal") == F.col("_f")) & (F.col("rec_no") == F.col("_n")), "left")
    same = F.col("qname").eqNullSafe(F.col("_q"))
    tags = S.put_tags(F.col("tags"), {seq: S.tag_text(F.col("_s"))})
    tags = F.when(F.coalesce(F.length("_y"), F.lit(0)) > 0, S.put_tags(tags, {qual: S.tag_text(F.col("_y"))})).otherwise(tags)
    ok = F.when(same, tags).otherwise(F.raise_error(F.concat(F.lit("names of read and index differ: "), F.coalesce("qname", F.lit("none")))).cast(S.TAGS))
    return df.withColumn("tags", ok).select(*records.columns)


def as_single_pairs(records: DataFrame) -> DataFrame:
    """r1, r2: records of one file; mates that stand next to each other are one row."""
    from pyspark.sql.window import Window

    r = F.struct(*records.columns)
    w = Window.partitionBy("file_ordinal", "qname").orderBy("rec_no")
    df = records.withColumn("_r", r).withColumn("_k", F.row_number().over(w))
    g = df.groupBy("file_ordinal", "qname", F.floor((F.col("_k") - 1) / 2).alias("_g")).agg(F.min_by("_r", "_k").alias("r1"), F.max_by("_r", "_k").alias("r2"), F.count("*").alias("_c"))
    return g.select("r1", F.when(F.col("_c") == 2, F.col("r2")).alias("r2"))


