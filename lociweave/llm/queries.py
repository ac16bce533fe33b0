"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, licenses, lm, mixing, neardup, packing, quality, repeats, surrogates


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_decontaminate(spark, d):
    return decontaminate.report(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def op4_quality(spark, d):
    return quality.report(_read(spark, d, "documents"))


def op8_mix(spark, d):
    return mixing.allot(_read(spark, d, "documents"))


def op9_licenses(spark, d):
    return licenses.scan(_read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (op2_decontaminate, op4_quality, op8_mix, op9_licenses)}
ORACLES = {"op2_decontaminate": decontaminate.ORACLE, "op4_quality": quality.ORACLE, "op8_mix": mixing.ORACLE, "op9_licenses": licenses.ORACLE}


def op5_near_dedup(spark, d):
    return neardup.report(_read(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (op5_near_dedup,)}


def op7_repeats(spark, d):
    return repeats.report(_read(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (op7_repeats,)}


def op10_lm_score(spark, d):
    return lm.report(_read(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (op10_lm_score,)}


def op3_html_text(spark, d):
    return html_text.extract(_read(spark, d, "pages"))


def op6_pack(spark, d):
    return packing.pack(_read(spark, d, "documents"))


QUERIES |= {f.__name__: f for f in (op3_html_text, op6_pack)}


#: For these tables of invented persons only; whoever has real ones passes a secret.
SAMPLE_KEY = b"key of the sample query"


def op1_surrogates(spark, d):
    return surrogates.report(_read(spark, d, "documents"), SAMPLE_KEY)


QUERIES |= {f.__name__: f for f in (op1_surrogates,)}
