"""Text formats as DataFrames: SAM, BED, five columns, FastA with regions, chromosome tables; and what format a file has.

Files are read by Spark's text source, line by line in parallel; gzip is inflated on the way. Line numbers, where order
matters, are kept as the file's ordinal and a number that grows along it.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.alignment import aligned_length
from ..operators.intervals import parse_strand


class FormatError(ValueError):
    """A file isn't what it was taken for."""


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value, file_ordinal, line_no: line_no grows along each file, but isn't dense."""
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for n, p in enumerate(paths):
        df = spark.read.text(p).select("value", F.lit(n).alias("file_ordinal"), F.monotonically_increasing_id().alias("line_no"))
        out = df if out is None else out.unionByName(df)
    return out


def _fail(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), value))


def read_bed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse_bed(lines(spark, paths))


def parse_bed(df: DataFrame) -> DataFrame:
    """name, chrom, strand, start, end of lines (value, file_ordinal, line_no). Empty lines, comments and track lines are skipped; fewer than four fields are an error."""
    df = df.withColumn("f", F.split("value", "\t"))
    df = df.where((F.col("value") != "") & ~F.col("value").startswith("#") & (F.col("f")[0] != "track") & ~F.col("value").startswith("track "))
    field = lambda i: F.get("f", F.lit(i))
    name = F.when(F.size("f") >= 4, field(3)).otherwise(_fail("too few fields: ", F.col("value")).cast("string"))
    return df.select(name.alias("name"), field(0).alias("chrom"), parse_strand(field(5)).alias("strand"), field(1).cast("int").alias("start"), field(2).cast("int").alias("end"), "file_ordinal", "line_no")


def read_5col(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse_5col(lines(spark, paths))


def parse_5col(df: DataFrame) -> DataFrame:
    """name, chrom, strand, start, end from fields between white space."""
    df = df.withColumn("f", F.split(F.trim("value"), r"\s+")).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    field = lambda i: F.get("f", F.lit(i))
    name = F.when(F.size("f") >= 4, field(0)).otherwise(_fail("too few fields: ", F.col("value")).cast("string"))
    return df.select(name.alias("name"), field(1).alias("chrom"), parse_strand(field(4)).alias("strand"), field(2).cast("int").alias("start"), field(3).cast("int").alias("end"), "file_ordinal", "line_no")


def read_fasta_regions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return parse_fasta_regions(lines(spark, paths))


def parse_fasta_regions(df: DataFrame) -> DataFrame:
    """Regions named in FastA headers: >chrom:strand:start:end...;more. The whole label is the region's name."""
    df = df.where(F.col("value").startswith(">"))
    df = df.select(F.posexplode(F.split(F.substring("value", 2, 1 << 30), ";")).alias("_i", "name"), "file_ordinal", "line_no").where(F.trim("name") != "").withColumn("f", F.split("name", ":"))
    field = lambda i: F.get("f", F.lit(i))
    return df.select("name", field(0).alias("chrom"), parse_strand(field(1)).alias("strand"), field(2).cast("int").alias("start"), F.regexp_extract(field(3), r"^\d+", 0).cast("int").alias("end"), "file_ordinal", "line_no")


def read_chromosomes(spark: SparkSession, path: str) -> DataFrame:
    return parse_chromosomes(lines(spark, path))


def parse_chromosomes(df: DataFrame) -> DataFrame:
    """ensembl, ucsc, shift; a name that comes again has the later line's values."""
    df = df.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    field = lambda i: F.get("f", F.lit(i))
    name = F.when(F.size("f") >= 3, field(0)).otherwise(_fail("too few fields: ", F.col("value")).cast("string"))
    df = df.select(name.alias("ensembl"), field(1).alias("ucsc"), field(2).cast("int").alias("shift"), "line_no")
    return df.groupBy("ensembl").agg(F.max_by(F.struct("ucsc", "shift"), "line_no").alias("x")).select("ensembl", "x.ucsc", "x.shift")


def _tag(kind: Column, value: Column) -> Column:
    return F.struct(
        kind.alias("t"), F.when(kind == "i", F.try_to_number(value, F.lit("S99999999999"))).cast("long").alias("i"),
        F.when(kind == "f", value.try_cast("double")).alias("f"), F.when(kind.isin("Z", "H", "A"), value).alias("s"),
    )


def parse_tags(fields: Column) -> Column:
    """Map of typed tags from fields NAME:TYPE:VALUE; array tags keep their type and no value."""
    parts = F.transform(fields, lambda x: F.split(x, ":", 3))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(p[0].alias("key"), _tag(p[1], p[2]).alias("value"))))


def _head(spark: SparkSession, path: str) -> list[str]:
    """The lines before the first that doesn't begin with @, read from the file's top only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(conf)
    tops = [f.getPath() for f in fs.listStatus(file)] if fs.getFileStatus(file).isDirectory() else [file]
    out = []
    for top in sorted(tops, key=str):
        if top.getName()[0] in "._":
            continue
        stream = fs.open(top)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(top)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
        while (line := reader.readLine()) is not None and line.startswith("@"):
            out.append(line)
        reader.close()
    return out


def parse_sam_header(spark: SparkSession, head: list[str]) -> tuple[DataFrame, DataFrame]:
    """refs and read_groups of header lines; ids of references count from 0 in order."""

    def rows(mark: str, *keys: str) -> list[tuple]:
        fields = [dict(x.partition(":")[::2] for x in line.split("\t")[1:]) for line in head if line.startswith(mark)]
        return [tuple(f.get(k) or None for k in keys) for f in fields]

    refs = [(n, name, int(k) if k and k.isdigit() else None) for n, (name, k) in enumerate(rows("@SQ", "SN", "LN"))]
    return spark.createDataFrame(refs, S.REFS), spark.createDataFrame(rows("@RG", "ID", "LB", "SM"), S.READ_GROUPS)


def sam_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """refs and read_groups of a SAM file's header."""
    return parse_sam_header(spark, _head(spark, path))


def read_sam(spark: SparkSession, path: str, file_ordinal: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records, refs, read_groups of a SAM file."""
    refs, groups = sam_header(spark, path)
    return parse_sam(lines(spark, path), refs, file_ordinal), refs, groups


def parse_sam(df: DataFrame, refs: DataFrame, file_ordinal: int = 0) -> DataFrame:
    """Records of lines (value, line_no) of SAM."""
    df = df.where(~F.col("value").startswith("@") & (F.col("value") != "")).withColumn("f", F.split("value", "\t"))
    field = lambda i: F.get("f", F.lit(i))
    name = F.when(field(6) == "=", field(2)).otherwise(field(6))
    ids = lambda c, k: F.broadcast(refs.select(F.col("rname_id").alias(c), F.col("sq_name").alias(k)))
    df = df.withColumns({"_r": field(2), "_m": name}).join(ids("rname_id", "_rn"), F.col("_r") == F.col("_rn"), "left").join(ids("mrnm_id", "_mn"), F.col("_m") == F.col("_mn"), "left")
    star = lambda x: F.when(x != "*", x)
    return df.select(
        field(0).alias("qname"), field(1).cast("int").alias("flag"), "rname_id", (field(3).cast("int") - 1).alias("pos"), field(4).cast("int").alias("mapq"), star(field(5)).alias("cigar"), "mrnm_id",
        (field(7).cast("int") - 1).alias("mpos"), field(8).cast("int").alias("isize"), star(field(9)).alias("seq"), star(field(10)).alias("qual"),
        F.when(F.size("f") > 11, parse_tags(F.slice("f", 12, 1 << 20))).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<t:string,i:bigint,f:double,s:string>>>"))).alias("tags"),
        F.lit(file_ordinal).alias("file_ordinal"), F.col("line_no").alias("rec_no"),
    )


def records_as_regions(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Mapped records as regions: name, chrom, strand by flag, start, end."""
    named = records.where(~S.bit(F.col("flag"), S.UNMAPPED)).join(F.broadcast(refs.select(F.col("rname_id").alias("_id"), F.col("sq_name").alias("chrom"))), F.col("rname_id") == F.col("_id"))
    return named.select(F.col("qname").alias("name"), "chrom", F.when(S.bit(F.col("flag"), S.REVERSED), "-").otherwise("+").alias("strand"), F.col("pos").alias("start"), (F.col("pos") + aligned_length(F.col("cigar"))).alias("end"), "file_ordinal", F.col("rec_no").alias("line_no"))


def sniff(path: str, size: int = 1 << 16) -> str:
    """bam, fasta, sam, bed or empty, by a file's beginning."""
    with open(path, "rb") as f:
        raw = f.read(size)
    if raw[:2] == b"\x1f\x8b":
        with gzip.open(path) as f:
            raw = f.read(size)
    if raw[:4] == b"BAM\1":
        return "bam"
    text = raw.lstrip()
    if not text:
        return "empty"
    if text[:1] == b">":
        return "fasta"
    if text[:1] == b"@":
        return "sam"
    first = text.partition(b"\n")[0]
    fields = first.split(b"\t")
    if len(fields) >= 11 and fields[1].isdigit() and fields[3].isdigit() and fields[4].isdigit():
        return "sam"
    if any(c < 9 or 13 < c < 32 for c in first):
        raise FormatError(f"{path}: neither alignments nor text")
    return "bed"


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a file in any of the formats."""
    kind = sniff(path)
    if kind == "bam":
        from .bam import read_bam

        records, refs, _ = read_bam(spark, path)
        return records_as_regions(records, refs)
    if kind == "sam":
        records, refs, _ = read_sam(spark, path)
        return records_as_regions(records, refs)
    if kind == "fasta":
        return read_fasta_regions(spark, path)
    if kind == "empty":
        return spark.createDataFrame([], "name string, chrom string, strand string, start int, end int, file_ordinal int, line_no bigint")
    return read_bed(spark, path)
