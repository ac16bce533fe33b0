"""Overlapping mates merged into one read, and adapters cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..shipping import ship_code

_COMPLEMENTS = np.arange(256, dtype=np.uint8)
_COMPLEMENTS[list(b"ACGTNacgtn")] = list(b"TGCANtgcan")
ADAPTERS = ("AGATCGGAAGAGCACACGTCTGAACTCCAGTCAC", "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGTA")
_COMPLEMENT = str.maketrans("ACGTNacgtn", "TGCANtgcan")


def reverse_complement(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.upper().encode(), np.uint8)


def _quals(q: str) -> np.ndarray:
    return np.frombuffer(q.encode(), np.uint8).astype(np.int64) - 33


def _mismatch(a: np.ndarray, b: np.ndarray, qa: np.ndarray, qb: np.ndarray) -> int:
    """Cost of laying a on b: the lower quality where they differ."""
    return int(np.minimum(qa, qb)[a != b].sum())


def merge_pair(s1: str, q1: str, s2: str, q2: str, adapters: tuple[str, str] = ADAPTERS) -> tuple[int, int, int, str, str]:
    """(length, margin, margin to not merging, sequence, qualities) of the best merge.

    For each insert length the mates are laid over each other, what runs past it over the adapters; the cost is the sum of the lower
    qualities at mismatches, less 4 for each position compared. margin: distance to the second best length.
    """
    a, qa = _codes(s1), _quals(q1)
    b, qb = _codes(reverse_complement(s2)), _quals(q2)[::-1]
    n1, n2 = len(a), len(b)
    ad1, ad2 = _codes(adapters[0]), _codes(adapters[1])
    r2, rq2 = _codes(s2), _quals(q2)
    best = []
    for n in range(1, n1 + n2):
        lo, hi = max(0, n - n2), min(n1, n)
        cost, compared = 0, max(0, hi - lo)
        if compared:
            k = lo - (n - n2)
            cost = _mismatch(a[lo:hi], b[k : k + compared], qa[lo:hi], qb[k : k + compared])
        for read, qual, ad in ((a, qa, ad1), (r2, rq2, ad2)):
            past = min(len(read) - n, len(ad))
            if past > 0:
                cost += int(qual[n : n + past][read[n : n + past] != ad[:past]].sum())
                compared += past
        best.append((cost - 4 * compared, n))
    best.sort()
    score, n = best[0]
    second = best[1][0] if len(best) > 1 else 0
    seq, qual = [], []
    for p in range(n):
        i, j = p, p - (n - n2)
        x = (int(a[i]), int(qa[i])) if i < n1 else None
        y = (int(b[j]), int(qb[j])) if 0 <= j < n2 else None
        if x and y:
            c, q = (x[0], min(40, x[1] + y[1])) if x[0] == y[0] else ((x[0], x[1] - y[1]) if x[1] >= y[1] else (y[0], y[1] - x[1]))
        else:
            c, q = x or y or (78, 0)
        seq.append(chr(c))
        qual.append(chr(q + 33))
    return n, second - score, -score, "".join(seq), "".join(qual)


def merge_many(s1: list[str], q1: list[str], s2: list[str], q2: list[str], adapters: tuple[str, str] = ADAPTERS) -> list[tuple[int, int, int, str, str]]:
    """``merge_pair`` of many pairs: those of the same lengths are laid over each other all at once."""
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(zip(s1, s2)):
        groups.setdefault((len(a), len(b)), []).append(k)
    out: list = [None] * len(s1)
    rows = lambda x, at, n: np.frombuffer("".join(x[k] for k in at).encode(), np.uint8).reshape(len(at), n)
    ads, upper = [_codes(x) for x in adapters], ([x.upper() for x in s1], [x.upper() for x in s2])
    for (n1, n2), members in groups.items():
        if not n1 or not n2 or any(len(q1[k]) != n1 or len(q2[k]) != n2 or not (s1[k] + s2[k]).isascii() for k in members):
            for k in members:
                out[k] = merge_pair(s1[k], q1[k], s2[k], q2[k], adapters)
            continue
        for start in range(0, len(members), 4096):
            at = members[start : start + 4096]
            a, r2 = rows(upper[0], at, n1), rows(upper[1], at, n2)
            qa, rq2 = rows(q1, at, n1).astype(np.int64) - 33, rows(q2, at, n2).astype(np.int64) - 33
            b, qb = _COMPLEMENTS[r2][:, ::-1], rq2[:, ::-1]
            score = np.zeros((len(at), n1 + n2 - 1), np.int64)
            for n in range(1, n1 + n2):
                lo, hi = max(0, n - n2), min(n1, n)
                cost, compared = score[:, n - 1], max(0, hi - lo)
                if compared:
                    k = lo - (n - n2)
                    cost += np.where(a[:, lo:hi] != b[:, k : k + compared], np.minimum(qa[:, lo:hi], qb[:, k : k + compared]), 0).sum(1)
                for read, qual, ad in ((a, qa, ads[0]), (r2, rq2, ads[1])):
                    past = min(read.shape[1] - n, len(ad))
                    if past > 0:
                        cost += np.where(read[:, n : n + past] != ad[:past], qual[:, n : n + past], 0).sum(1)
                        compared += past
                cost -= 4 * compared
            best = score.argmin(1)
            top = score[np.arange(len(at)), best]
            rest = score.copy()
            rest[np.arange(len(at)), best] = np.iinfo(np.int64).max
            second = rest.min(1) if score.shape[1] > 1 else np.zeros(len(at), np.int64)
            for n in np.unique(best + 1):
                mine = np.flatnonzero(best + 1 == n)
                x, xq = np.full((len(mine), n), 78, np.uint8), np.full((len(mine), n), -1, np.int64)
                y, yq = x.copy(), xq.copy()
                k = min(n1, n)
                x[:, :k], xq[:, :k] = a[mine, :k], qa[mine, :k]
                lo = max(0, n - n2)
                y[:, lo:], yq[:, lo:] = b[mine, lo - (n - n2) : n2], qb[mine, lo - (n - n2) : n2]
                both, first = (xq >= 0) & (yq >= 0), xq >= yq
                seq = np.where(first, x, y)
                qual = np.where(both, np.where(x == y, np.minimum(40, xq + yq), np.abs(xq - yq)), np.maximum(np.maximum(xq, yq), 0))
                for row, sq, ql in zip(mine, seq, (qual + 33).astype(np.uint8)):
                    out[at[row]] = (int(n), int(second[row] - top[row]), int(-top[row]), sq.tobytes().decode(), ql.tobytes().decode())
    return out


def trim_adapter(s: str, q: str, adapters: tuple[str, ...] = ADAPTERS) -> tuple[int, int]:
    """(length to keep, margin) of a single read: where an adapter fits best; all of it if none does."""
    a, qa = _codes(s), _quals(q)
    best = [(0, len(s))]
    for ad in map(_codes, adapters):
        for n in range(len(s)):
            k = min(len(a) - n, len(ad))
            cost = int(qa[n : n + k][a[n : n + k] != ad[:k]].sum()) - 4 * k
            best.append((cost, n))
    best.sort()
    return best[0][1], (best[1][0] if len(best) > 1 else 0) - best[0][0]


_OUT = "array<struct<seq:string,qual:string,mate:int,ff:int,ym:int,yn:int>>"


def merge(pairs: DataFrame, low: int = 20, high: int = 200, adapters: tuple[str, str] = ADAPTERS) -> DataFrame:
    """Records of r1, r2 (null for single reads), merged or trimmed where the evidence allows.

    Below ``low`` only the originals are kept, above ``high`` only the merged read; in between both, the originals flagged
    as alternative (FF 4). Merged reads are unpaired, FF 2, or 3 if adapters were cut, and carry YM (margin to the
    second best) and YN (margin to not merging); trimmed single reads have FF 1.
    """

    ship_code(pairs.sparkSession)

    @F.pandas_udf(_OUT)
    def run(s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.Series:
        rows = list(zip(s1, q1, s2, q2))
        two = [k for k, r in enumerate(rows) if all(x is not None for x in r)]
        merged = dict(zip(two, merge_many(*([rows[k][c] for k in two] for c in range(4)), adapters)))

        def one(k, a, qa, b, qb):
            if a is None or qa is None:
                return []
            original = [{"seq": a, "qual": qa, "mate": 1, "ff": 0, "ym": None, "yn": None}]
            if b is not None and qb is not None:
                original.append({"seq": b, "qual": qb, "mate": 2, "ff": 0, "ym": None, "yn": None})
                n, ym, yn, seq, qual = merged[k]
                new = {"seq": seq, "qual": qual, "mate": 0, "ff": S.MERGED | (S.TRIMMED if n < min(len(a), len(b)) else 0), "ym": ym, "yn": yn}
            else:
                n, ym = trim_adapter(a, qa, adapters)
                if n == len(a):
                    return original
                new = {"seq": a[:n], "qual": qa[:n], "mate": 0, "ff": S.TRIMMED, "ym": ym, "yn": ym}
            sure = min(ym, new["yn"])
            if sure < low:
                return original
            return [new] if sure > high else [new, *({**o, "ff": S.ALTERNATIVE} for o in original)]

        return pd.Series([one(k, *r) for k, r in enumerate(rows)])

    df = pairs.withColumn("_x", F.explode(run("r1.seq", "r1.qual", "r2.seq", "r2.qual")))
    r = F.when(F.col("_x.mate") == 2, F.col("r2")).otherwise(F.col("r1"))
    new = F.col("_x.mate") == 0
    alone = r["flag"].bitwiseAND(~(S.PAIRED | S.PROPER | S.FIRST | S.SECOND | S.MATE_UNMAPPED | S.MATE_REVERSED))
    old = S.tag_number(r["tags"], "FF").cast("int")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.when(c, S.tag_int(v)).alias("value")) for k, v, c in (
        ("FF", old.bitwiseOR(F.col("_x.ff")), F.col("_x.ff") > 0), ("YM", F.col("_x.ym"), F.col("_x.ym").isNotNull()), ("YN", F.col("_x.yn"), F.col("_x.yn").isNotNull()))])
    add = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    tags = F.map_concat(F.map_filter(r["tags"], lambda k, _: ~F.map_contains_key(add, k)), add)
    flag = F.when(new & F.col("r2").isNotNull(), alone).otherwise(r["flag"])
    return df.select(r.withField("seq", F.col("_x.seq")).withField("qual", F.col("_x.qual")).withField("flag", flag).withField("tags", tags).alias("r")).select("r.*")
