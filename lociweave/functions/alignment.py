"""CIGAR strings, and pairs of reference and read bases from CIGAR and MD."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..shipping import ship_code

_OPS = re.compile(r"(\d+)([MIDNSHP=X])")


def parse_cigar(cigar: str | None) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OPS.findall(cigar or "")]


def format_cigar(ops: list[tuple[int, str]]) -> str:
    out: list[tuple[int, str]] = []
    for n, op in ops:
        if n and out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        elif n:
            out.append((n, op))
    return "".join(f"{n}{op}" for n, op in out)


def aligned_length(cigar: Column) -> Column:
    """Reference positions that a CIGAR string covers."""
    lengths = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)[MDN=X]"), 1)
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x.cast("int"))


def aligned_pairs(seq: str, cigar: str, md: str) -> list[tuple[str, str]]:
    """(reference base, read base) of each aligned position, in reference order; insertions and clips are left out, deletions give '-' for the read."""
    read, at = [], 0
    for n, op in parse_cigar(cigar):
        if op in "M=X":
            read += seq[at : at + n]
            at += n
        elif op in "IS":
            at += n
    out, k = [], 0
    for n, gone, base in re.findall(r"(\d+)|\^([A-Za-z]+)|([A-Za-z])", md):
        if n:
            out += [(b, b) for b in read[k : k + int(n)]]
            k += int(n)
        elif gone:
            out += [(b, "-") for b in gone]
        elif k < len(read):
            out.append((base, read[k]))
            k += 1
    return [(a.upper(), b.upper()) for a, b in out]


def deaminated(seq: Column, cigar: Column, md: Column, n: int) -> Column:
    """C read as T among the first or last n pairs, or G read as A among the last n; false without MD."""

    ship_code()

    @F.pandas_udf("boolean")
    def run(s: pd.Series, c: pd.Series, m: pd.Series) -> pd.Series:
        def one(seq, cigar, md):
            if not md or seq is None:
                return False
            pairs = aligned_pairs(seq, cigar, md)
            last = pairs[-n:] if n else []
            return ("C", "T") in pairs[:n] or ("C", "T") in last or ("G", "A") in last

        return pd.Series([one(*x) for x in zip(s, c, m)], dtype=bool)

    return F.coalesce(run(seq, cigar, md), F.lit(False))
