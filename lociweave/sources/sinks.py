"""Writers: SAM and FastQ text, output split by library, histogram and report files, names by pattern."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S


def file_pattern(pattern: str, path: str) -> str:
    """%s the path, %f without extension, %p its folder, %n its base name, %e its extension, %% a percent sign."""
    stem, ext = os.path.splitext(path)
    values = {"s": path, "f": stem, "p": os.path.dirname(path), "n": os.path.basename(stem), "e": ext, "%": "%"}
    return re.sub(r"%(.)", lambda m: values.get(m[1], m[0]), pattern)


def library_pattern(pattern: str, library: str) -> str:
    return re.sub(r"%([s%])", lambda m: library if m[1] == "s" else "%", pattern)


def _tag_fields() -> Column:
    e = F.array_sort(F.map_entries("tags"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    value = lambda v: F.when(v["t"] == "i", v["i"].cast("string")).when(v["t"] == "f", v["f"].cast("string")).otherwise(v["s"])
    return F.transform(F.filter(e, lambda x: value(x["value"]).isNotNull()), lambda x: F.concat_ws(":", x["key"], x["value"]["t"], value(x["value"])))


def sam_lines(records: DataFrame, refs: DataFrame) -> DataFrame:
    """value: each record as a line of SAM."""
    df = S.have(records, "flag", "rname_id", "pos", "mapq", "cigar", "mrnm_id", "mpos", "isize", "seq", "qual", "tags")
    side = lambda i, n: F.broadcast(refs.select(F.col("rname_id").alias(i), F.col("sq_name").alias(n)))
    df = df.join(side("_i", "_r"), F.col("rname_id") == F.col("_i"), "left").join(side("_j", "_m"), F.col("mrnm_id") == F.col("_j"), "left")
    star = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("*"))
    mate = F.when(F.col("mrnm_id").isNull(), "*").when(F.col("mrnm_id").eqNullSafe(F.col("rname_id")), "=").otherwise(F.col("_m"))
    fields = F.array(
        star("qname"), F.col("flag").cast("string"), F.coalesce("_r", F.lit("*")), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), star("cigar"), mate,
        (F.col("mpos") + 1).cast("string"), F.col("isize").cast("string"), star("seq"), star("qual"),
    )
    return df.select(F.array_join(F.concat(fields, F.coalesce(_tag_fields(), F.array().cast("array<string>"))), "\t").alias("value"), *[c for c in ("file_ordinal", "rec_no") if c in df.columns])


def header_lines(refs: DataFrame, read_groups: DataFrame | None = None, program: str | None = None) -> list[str]:
    out = ["@HD\tVN:1.6"] + [f"@SQ\tSN:{r.sq_name}\tLN:{r.sq_length}" for r in refs.orderBy("rname_id").collect()]
    for g in read_groups.collect() if read_groups is not None else []:
        out.append("\t".join(["@RG", f"ID:{g.rg_id}", *([f"LB:{g.lb}"] if g.lb else []), *([f"SM:{g.sm}"] if g.sm else [])]))
    return out + ([f"@PG\tID:lociweave\tPN:lociweave\tCL:{program}"] if program else [])


def write_sam(records: DataFrame, refs: DataFrame, path: str, read_groups: DataFrame | None = None, program: str | None = None) -> None:
    """A folder of SAM text: the header in a file of its own, then a file per partition. program: the command line for @PG."""
    lines = records.sparkSession.createDataFrame([(x,) for x in header_lines(refs, read_groups, program)], "value string").coalesce(1)
    sam_lines(records, refs).select("value").write.mode("overwrite").text(path)
    lines.write.mode("append").text(path)


def split_by_library(records: DataFrame, path: str, pattern: str = "%s") -> dict[str, str]:
    """Parquet in one folder per library below ``path``, named by the pattern; records need the column library. Returns the folder of each library.

    All libraries are written in one pass; their folders are then renamed.
    """
    spark = records.sparkSession
    written = records.withColumn("_library", F.hex(F.encode(F.coalesce("library", F.lit("")), "UTF-8")))
    written.write.mode("overwrite").partitionBy("_library").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = top.getFileSystem(conf), {}
    for f in fs.listStatus(top):
        _, mark, code = f.getPath().getName().partition("_library=")
        if mark:
            library = "" if code == "__HIVE_DEFAULT_PARTITION__" else bytes.fromhex(code).decode()
            to = jvm.org.apache.hadoop.fs.Path(top, library_pattern(pattern, library.replace("/", "_") or "--"))
            fs.rename(f.getPath(), to)
            out[library] = str(to)
    return out


def fastq_streams(records: DataFrame) -> dict[str, DataFrame]:
    """value: FastQ of first mates, second mates and unpaired reads."""
    from ..operators.rewrite import fastq_lines

    df = fastq_lines(records)
    first, second = S.bit(F.col("flag"), S.FIRST), S.bit(F.col("flag"), S.SECOND)
    pick = lambda c: df.where(c).select(F.col("fastq").alias("value"))
    return {"first": pick(first & ~second), "second": pick(second & ~first), "unpaired": pick(first == second)}


def histogram_lines(histogram: DataFrame) -> DataFrame:
    return histogram.orderBy("n").select(F.concat_ws("\t", F.col("n").cast("string"), F.col("clusters").cast("string")).alias("value"))
