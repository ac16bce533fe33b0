"""Circular references: normal coordinates, repair of hits that the padding doubled, wrapping of overhanging reads."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..shipping import ship_code
from ..functions.alignment import format_cigar, parse_cigar


def resolve(refs: list[tuple[int, str, int]], wanted: list[str]) -> dict[int, int]:
    """``name:length`` by unique prefix of the reference names: natural lengths by id, at most the length in the header."""
    out = {}
    for w in wanted:
        name, _, length = w.rpartition(":")
        if not name or not length.isdigit() or int(length) <= 0:
            raise ValueError(f"{w}: expected NAME:LENGTH")
        hits = [r for r in refs if r[1].startswith(name)]
        if len(hits) != 1:
            raise ValueError(f"{name}: {'no' if not hits else 'more than one'} reference has that name")
        if int(length) > hits[0][2]:
            raise ValueError(f"{name}: the natural length {length} exceeds {hits[0][2]}")
        out[hits[0][0]] = int(length)
    return out


def rewrite_lengths(refs: DataFrame, lengths: dict[int, int]) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]) if lengths else None
    return refs if m is None else refs.withColumn("sq_length", F.coalesce(m[F.col("rname_id")], "sq_length"))


def _table(spark, lengths: dict[int, int], refs: DataFrame):
    padded = refs.where(F.col("rname_id").isin(list(lengths))).select(F.col("rname_id").alias("_ref"), F.col("sq_length").alias("_padded"))
    return F.broadcast(padded.withColumn("_natural", F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])[F.col("_ref")]))


def _normal(pos, natural, padded):
    over = padded - natural
    return F.when(pos >= 0, over + F.pmod(pos - over, natural)).otherwise(pos)


def normalize(df: DataFrame, refs: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Positions on circular references moved out of the first copy of the padded part, for reads and mates; a hit whose only alternative is itself in the other copy loses XA and gets mapq 37."""
    if not lengths:
        return df
    df = S.have(df, "mrnm_id", "mpos", "mapq")
    side = _table(df.sparkSession, lengths, refs)
    name = F.broadcast(refs.select(F.col("rname_id").alias("_id"), F.col("sq_name").alias("_name")))
    out = df.join(side, F.col("rname_id") == F.col("_ref"), "left").withColumn("_pos", F.when(F.col("_ref").isNotNull(), _normal(F.col("pos"), F.col("_natural"), F.col("_padded"))).otherwise(F.col("pos")))
    if "tags" in df.columns:
        out = out.join(name, F.col("rname_id") == F.col("_id"), "left")
        xa = F.rtrim(S.tag_string(F.col("tags"), "XA"), F.lit(";"))
        part = F.split(xa, ",")
        there = F.try_to_number(F.element_at(part, 2), F.lit("S9999999999")).cast("long")
        one = (xa != "") & ~F.contains(xa, F.lit(";")) & (F.size(part) >= 3)
        same = one & (F.element_at(part, 1) == F.col("_name")) & (_normal(F.abs(there) - 1, F.col("_natural"), F.col("_padded")) == F.col("_pos")) & ((there < 0) == S.bit(F.col("flag"), S.REVERSED))
        hit = F.coalesce(F.col("_ref").isNotNull() & F.when(one, same), F.lit(False))
        out = out.withColumns({"mapq": F.when(hit, 37).otherwise(F.col("mapq")).cast("int"), "tags": F.when(hit, F.map_filter("tags", lambda k, _: k != "XA")).otherwise(F.col("tags"))})
    mate = side.select(F.col("_ref").alias("_mref"), F.col("_natural").alias("_mnat"), F.col("_padded").alias("_mpad"))
    out = out.join(F.broadcast(mate), F.col("mrnm_id") == F.col("_mref"), "left")
    return out.withColumns({"pos": F.col("_pos").cast("int"), "mpos": F.when(F.col("_mref").isNotNull(), _normal(F.col("mpos"), F.col("_mnat"), F.col("_mpad"))).otherwise(F.col("mpos")).cast("int")}).select(*df.columns)


def split_cigar(cigar: str, pos: int, length: int) -> list[tuple[int, str]]:
    """(position, CIGAR) of the pieces of an alignment that runs past ``length``: each has the bases of the other soft-masked."""
    ops, left, right, at, over = parse_cigar(cigar), [], [], pos, False
    for n, op in ops:
        if op not in "MDN=X":
            if over:
                right.append((n, op))
                left.append((n, "S" if op == "I" else op))
            else:
                left.append((n, op))
                right.append((n, "S" if op == "I" else op))
            continue
        for part, past in ((max(0, min(n, length - at)), False), (max(0, n - max(0, length - at)), True)):
            if part:
                mine, other = (right, left) if past else (left, right)
                mine.append((part, op))
                if op in "M=X":
                    other.append((part, "S"))
                over = past
        at += n
    if not over:
        return [(pos, cigar)]

    def tidy(ops):  # no clip inside, hard clips outermost
        return re.sub(r"^(\d+S)(\d+)H", r"\2H\1", format_cigar([(n, op) for n, op in ops if n]))

    return [(pos, tidy(left)), (0, tidy(right))]


def wrap(df: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Reads that overhang the natural end of their reference in two pieces: the second begins at 0 and is flagged as secondary. Positions are brought below the natural length first."""
    if not lengths:
        return df
    natural = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])[F.col("rname_id")]

    ship_code(df.sparkSession)

    @F.pandas_udf("array<struct<pos:int,cigar:string>>")
    def pieces(pos: pd.Series, cigar: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": p, "cigar": c}] if pd.isna(k) or p is None or p < 0 or not c else [{"pos": a, "cigar": b} for a, b in split_cigar(c, int(p), int(k))] for p, c, k in zip(pos, cigar, n)])

    out = df.withColumn("_natural", natural)
    out = out.withColumn("pos", F.when(F.col("_natural").isNotNull() & (F.col("pos") >= 0), F.pmod("pos", "_natural")).otherwise(F.col("pos")).cast("int"))
    if "mpos" in df.columns and "mrnm_id" in df.columns:
        mate = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])[F.col("mrnm_id")]
        out = out.withColumn("mpos", F.when(mate.isNotNull() & (F.col("mpos") >= 0), F.pmod(F.col("mpos"), mate)).otherwise(F.col("mpos")).cast("int"))
    over = F.col("_natural").isNotNull() & F.col("cigar").isNotNull() & (F.col("pos") >= 0)
    # Only reads on circular references go through Python.
    kept = out.where(~F.coalesce(over, F.lit(False))).select(*df.columns)
    out = out.where(over).withColumn("_p", pieces("pos", "cigar", "_natural")).select("*", F.posexplode("_p").alias("_k", "_x"))
    out = out.withColumns({"pos": F.col("_x.pos"), "cigar": F.col("_x.cigar"), "flag": F.when(F.col("_k") > 0, F.col("flag").bitwiseOR(S.SECONDARY)).otherwise(F.col("flag"))}).select(*df.columns)
    return kept.unionByName(out)
