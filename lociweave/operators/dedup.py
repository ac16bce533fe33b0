"""Duplicate removal: clean-up, clusters by key, cheap or consensus collapse or marking, counts, histogram, complexity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..shipping import ship_code
from ..functions.alignment import aligned_length

HISTOGRAM_SIZE = 1024


def aligned(flag: Column = None, rname: Column = None) -> Column:
    flag, rname = F.col("flag") if flag is None else flag, F.col("rname_id") if rname is None else rname
    return ~(S.bit(flag, S.UNMAPPED) & S.bit(flag, S.MATE_UNMAPPED)) & rname.isNotNull()


def proper(flag: Column = None) -> Column:
    flag = F.col("flag") if flag is None else flag
    same = S.bit(flag, S.UNMAPPED) == S.bit(flag, S.MATE_UNMAPPED)
    return ~S.bit(flag, S.PAIRED) | (same & S.bit(flag, S.PROPER))


def effective_length() -> Column:
    """The insert of a proper pair, else the read."""
    return F.when(S.bit(F.col("flag"), S.PAIRED) & S.bit(F.col("flag"), S.PROPER), F.abs("isize")).otherwise(F.col("length"))


def clean(df: DataFrame, unaligned: bool = False, improper: bool = False, least_length: int = 0, least_mapq: int = 0) -> DataFrame:
    df = S.have(df, "flag", "rname_id", "mapq", "isize")
    if "length" not in df.columns:
        df = df.withColumn("length", F.col("seq_len") if "seq_len" in df.columns else F.coalesce(F.length("seq"), F.lit(0)))
    if not unaligned:
        df = df.where(aligned())
    if not improper:
        df = df.where(proper())
    if least_length:
        df = df.where(effective_length() >= least_length)
    return df.where(F.col("mapq") >= least_mapq) if least_mapq else df


def label(df: DataFrame, read_groups: DataFrame | None, ignore: bool = False) -> DataFrame:
    """Adds library: the read group's LB, else its SM, else its id; the RG text if the header doesn't know it; "" if read groups are ignored."""
    if ignore:
        return df.withColumn("library", F.lit(""))
    rg = F.col("rg") if "rg" in df.columns else S.tag_string(F.col("tags"), "RG")
    if read_groups is None:
        return df.withColumn("library", F.coalesce(rg, F.lit("")))
    name = F.coalesce(F.nullif("lb", F.lit("")), F.nullif("sm", F.lit("")), "rg_id")
    side = F.broadcast(read_groups.select(F.col("rg_id").alias("_rg"), name.alias("_label")))  # the header's, so small
    return df.withColumn("_own", F.coalesce(rg, F.lit(""))).join(side, F.col("_own") == F.col("_rg"), "left").withColumn("library", F.coalesce("_label", "_own")).drop("_own", "_rg", "_label")


def with_key(df: DataFrame, ignore_strand: bool = False) -> DataFrame:
    """Adds key: what duplicates share. Merged reads: 5' end and length; pairs: both leftmost positions and the mate's role; single reads: leftmost position."""
    flag = F.col("flag")
    both = S.bit(flag, S.PAIRED) & ~S.bit(flag, S.UNMAPPED) & ~S.bit(flag, S.MATE_UNMAPPED) & (F.col("mpos") >= 0)
    merged = (S.tag_number(F.col("tags"), "FF").cast("int").bitwiseAND(S.MERGED) != 0) if "tags" in df.columns else F.lit(False)
    length = aligned_length(F.col("cigar")) if "cigar" in df.columns else F.col("length")
    strand = F.lit(False) if ignore_strand else S.bit(flag, S.REVERSED)
    kind = F.when(both, 1).when(merged, 0).otherwise(2)
    low, high = F.least("pos", "mpos"), F.greatest("pos", "mpos")
    end5 = F.when(S.bit(flag, S.REVERSED), F.col("pos") + length).otherwise(F.col("pos"))
    a = F.when(kind == 1, low).when(kind == 0, end5).otherwise(F.col("pos"))
    b = F.when(kind == 1, high).when(kind == 0, length).otherwise(0)
    other = F.when(kind == 1, F.coalesce("mrnm_id", F.lit(-1))).otherwise(-1)
    role = F.when(kind == 1, flag.bitwiseAND(S.FIRST | S.SECOND)).otherwise(0)
    return df.withColumn("key", F.struct(F.col("library"), F.coalesce("rname_id", F.lit(-1)).alias("rname"), kind.alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), other.cast("int").alias("other"), role.cast("int").alias("role"), strand.alias("strand")))


def junk(df: DataFrame) -> DataFrame:
    """Records that a clean-up leaves out as unaligned; copied behind the others where they are kept."""
    return df.where(~aligned())


def keep_junk(deduplicated: DataFrame, df: DataFrame) -> DataFrame:
    """deduplicated with the unaligned records of df, each of them once, after it in the order of inputs."""
    return deduplicated.unionByName(junk(df), allowMissingColumns=True)


def _quality(df: DataFrame) -> DataFrame:
    q = F.aggregate(F.split("qual", ""), F.lit(0), lambda a, c: a + F.ascii(c) - 33) if "qual" in df.columns else F.lit(0)
    return df.withColumn("_quality", F.coalesce(q, F.lit(0)))


def collapse_cheap(df: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One record per key, xp: how many there were. Takes the best by sum of qualities, then mapq, then the first by ``order``. An aggregate, so that partial results are formed before the shuffle.

    keep: columns of the best that are wanted (default: all); others aren't carried through sorts and shuffles.
    """
    df = _quality(df)
    rest = [c for c in (df.columns if keep is None else keep) if c not in ("key", "_quality")]
    if any(isinstance(df.schema[c].dataType, T.MapType) for c in rest):
        return df.groupBy("key").agg(F.min_by(F.struct(*rest), _best(order)).alias("r"), F.count("*").alias("xp")).select("key", "r.*", "xp")
    # What has an order is the tail of what is compared, so that nothing is carried twice.
    ranked = {"mapq": -F.col("r.m")} | {c: F.col(f"r.o{i}") for i, c in enumerate(order)}
    tail = [F.col(c).alias(f"_{c}") for c in rest if c not in ranked]
    best = df.groupBy("key").agg(F.min(F.struct(*_ranks(order), *tail)).alias("r"), F.count("*").alias("xp"))
    return best.select("key", *[ranked.get(c, F.col(f"r._{c}")).alias(c) for c in rest], "xp")


def _ranks(order: list[str]) -> list[Column]:
    return [(-F.col("_quality")).alias("q"), (-F.col("mapq")).alias("m"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]]


def _best(order: list[str]) -> Column:
    return F.struct(*_ranks(order))


def mark(df: DataFrame, order: list[str]) -> DataFrame:
    """All records; those that a collapse would drop are flagged as duplicates. ``order`` must tell the records of a key apart.

    The best of each key is found by an aggregate and joined back, so that a deep cluster's records need not meet in one task.
    """
    best = _quality(df.select("key", "mapq", *[c for c in df.columns if c == "qual"], *order)).groupBy(F.col("key").alias("_k")).agg(F.min(_best(order)).alias("_b"))
    same = F.lit(True)
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_b.o{i}"))
    df = df.join(best, F.col("key").eqNullSafe(F.col("_k")))
    return df.withColumn("flag", F.when(same, F.col("flag")).otherwise(F.col("flag").bitwiseOR(S.DUPLICATE))).drop("_k", "_b")


def drop_shadowed(df: DataFrame) -> DataFrame:
    """Without single reads that might be half of a pair: those at the place of a pair's read."""
    flag = F.col("flag")
    pairs = df.where("key.kind = 1").select(F.col("library").alias("_l"), F.col("rname_id").alias("_r"), F.col("pos").alias("_p"), S.bit(flag, S.REVERSED).alias("_s")).distinct()
    singles = df.where("key.kind = 2").join(pairs, (F.col("library") == F.col("_l")) & (F.col("rname_id") == F.col("_r")) & (F.col("pos") == F.col("_p")) & (S.bit(flag, S.REVERSED) == F.col("_s")), "left_anti")
    return df.where("key.kind <> 2").unionByName(singles)


def histogram(collapsed: DataFrame, size: int = HISTOGRAM_SIZE) -> DataFrame:
    """n, clusters: how many clusters have n members, for n from 0 to the largest below ``size``."""
    h = collapsed.where((F.col("xp") >= 0) & (F.col("xp") < size)).groupBy(F.col("xp").cast("int").alias("n")).agg(F.count("*").alias("clusters"))
    # At most ``size`` rows: one map, so that the clusters are counted once.
    one = h.agg(F.max("n").alias("top"), F.map_from_entries(F.collect_list(F.struct("n", "clusters"))).alias("m")).where("top is not null")
    return one.select(F.explode(F.sequence(F.lit(0), "top")).alias("n"), "m").select("n", F.coalesce(F.element_at("m", F.col("n")), F.lit(0)).cast("long").alias("clusters"))


def library_counts(collapsed: DataFrame) -> DataFrame:
    """Per library, in pairs or their like: reads in, out, out with mapq 20 or more, and of these those without duplicates. A read of a pair counts half."""
    w = F.when(S.bit(F.col("flag"), S.PAIRED), 1).otherwise(2)
    good = F.col("mapq") >= 20
    half = lambda x: F.floor(F.sum(x) / 2).cast("long")
    return collapsed.groupBy("library").agg(
        half(w * F.coalesce("xp", F.lit(1))).alias("n_in"), half(w).alias("n_out"),
        half(F.when(good, w).otherwise(0)).alias("out_mq20"), half(F.when(good & (F.col("xp") == 1), w).otherwise(0)).alias("single_mq20"),
    )


def estimate(total: float, singles: float) -> float | None:
    """Distinct molecules if each is seen as often as a Poisson variable that isn't 0: singles / total = x / (e^x - 1)."""
    if singles <= 0 or singles >= total:
        return None
    low, high = 1e-12, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid / np.expm1(mid) > singles / total:
            low = mid
        else:
            high = mid
    return total / -np.expm1(-low)


def complexity(counts: DataFrame) -> DataFrame:
    """library_counts with unseen and all molecules, unique and exhausted percentages; null where there is no estimate. One row per library."""

    ship_code(counts.sparkSession)

    @F.pandas_udf("double")
    def est(total: pd.Series, singles: pd.Series) -> pd.Series:
        return pd.Series([estimate(t, s) for t, s in zip(total, singles)], dtype="float64")

    df = counts.withColumn("_e", est("out_mq20", "single_mq20"))
    df = df.withColumn("_e", F.when(~F.isnan("_e"), F.col("_e")))
    grand = F.col("_e") * F.col("n_out") / F.col("out_mq20")
    return df.select(
        "library", "n_in", "n_out", "out_mq20", "single_mq20",
        (grand - F.col("n_out")).alias("unseen"), grand.alias("molecules"), F.when(F.col("n_in") != 0, 100 * F.col("n_out") / F.nullif(F.col("n_in"), F.lit(0))).alias("unique_pct"),
        (100 * F.col("out_mq20") / F.col("_e")).alias("exhausted_pct"),
    )


def report_lines(report: DataFrame) -> DataFrame:
    """The complexity report as tab-separated lines; an empty label is --, a missing estimate N/A."""
    number = lambda c, d: F.when(F.col(c).isNull(), "N/A").otherwise(F.format_string(f"%.{d}f", F.col(c)))
    whole = [F.col(c).cast("string") for c in ("n_in", "n_out", "out_mq20", "single_mq20")]
    return report.select(F.concat_ws("\t", F.when(F.col("library") == "", "--").otherwise(F.col("library")), *whole, number("unseen", 0), number("molecules", 0), number("unique_pct", 1), number("exhausted_pct", 1)).alias("line"))


def consensus_of(seqs: list[str], quals: list[str], most: int) -> tuple[str, str]:
    """Per position the base with the largest sum of qualities (ties: A before C, G, T, N); its quality is its sum less the others', at least 0 and at most ``most``."""
    n = len(seqs[0])
    score = np.zeros((n, 5), np.int64)
    for s, q in zip(seqs, quals):
        code = np.array(["ACGTN".find(c) for c in s.upper()])
        code[code < 0] = 4
        np.add.at(score, (np.arange(n), code), np.frombuffer(q.encode(), np.uint8).astype(np.int64) - 33)
    score[:, 4] = 0
    best = score[:, :4].argmax(1)
    top = score[np.arange(n), best]
    value = np.clip(2 * top - score.sum(1), 0, most)
    return "".join("ACGT"[b] if t > 0 else "N" for b, t in zip(best, top)), (value + 33).astype(np.uint8).tobytes().decode()


#: Clusters of more members than this are collapsed by votes summed per position, others by lists of their members.
DEEP = 4096


def collapse_consensus(df: DataFrame, order: list[str], most: int = 60, keep: list[str] | None = None) -> DataFrame:
    """One record per key: the consensus of its members with the most common CIGAR (ties: the lesser); other columns from the best of them.

    The members of a cluster meet in one row, which is the least to shuffle; those of the few deep ones, which are counted before, do not:
    there, votes are summed per key and position by partial aggregates. keep: columns of the best that are wanted (default: all).
    """
    rest = [c for c in (df.columns if keep is None else keep) if c not in ("key", "_quality", "seq", "qual", "cigar")]
    df = _quality(df).select("key", "_quality", *dict.fromkeys(["mapq", *order, "cigar", "seq", "qual", *rest]))
    deep = df.groupBy("key").agg(F.count("*").alias("_c")).where(F.col("_c") > DEEP).select(F.col("key").alias("_k"))
    found, on = deep.count(), F.col("key").eqNullSafe(F.col("_k"))
    if not found:
        return _consensus_by_lists(df, order, most, rest)
    deep = F.broadcast(deep) if found <= 100_000 else deep
    few = _consensus_by_lists(df.join(deep, on, "left_anti"), order, most, rest)
    return few.unionByName(_consensus_by_votes(df.join(deep, on, "left_semi"), order, most, rest))


def _consensus_by_lists(df: DataFrame, order: list[str], most: int, rest: list[str]) -> DataFrame:
    each = df.repartition("key").groupBy("key", "cigar").agg(F.count("*").alias("_c"), F.min_by(F.struct(F.lit(0).alias("_"), *rest), _best(order)).alias("r"), F.collect_list(F.struct(F.col("seq").alias("s"), F.col("qual").alias("q"))).alias("v"))
    main = each.groupBy("key").agg(F.min_by(F.struct("cigar", "r", "v"), F.struct((-F.col("_c")).alias("c"), F.coalesce("cigar", F.lit("")).alias("s"))).alias("m"), F.sum("_c").alias("xp"))
    main = main.select("key", "m.cigar", "m.r", "m.v", "xp")
    sole = F.col("v")[0]
    top = chr(33 + most)
    # One read of known bases with qualities from 1 to ``most`` is its own consensus.
    plain = (F.size("v") == 1) & sole["s"].rlike("^[ACGTacgt]+$") & sole["q"].rlike(f'^["-\\x{ord(top):02x}]+$') & (F.length(sole["s"]) == F.length(sole["q"])) if 1 < most < 94 else F.lit(False)
    code = lambda x, i: F.ascii(F.substring(x["q"], i, F.lit(1))) - 33
    valid = lambda x, i: (i <= F.length(x["s"])) & (i <= F.length(x["q"]))

    def add(i):
        def step(a, x):
            b, q = F.upper(F.substring(x["s"], i, F.lit(1))), F.when(valid(x, i), code(x, i)).otherwise(0)
            return F.struct(*[(a[c] + F.when(b == c, q).otherwise(0)).alias(c) for c in "ACGT"])

        return step

    def call(a):
        most_ = F.greatest(*[a[c] for c in "ACGT"])
        base = F.when(most_ <= 0, "N").when(a["A"] == most_, "A").when(a["C"] == most_, "C").when(a["G"] == most_, "G").otherwise("T")
        value = F.least(F.greatest(2 * most_ - (a["A"] + a["C"] + a["G"] + a["T"]), F.lit(0)), F.lit(most))
        return F.struct(base.alias("b"), F.chr((value + 33).cast("long")).alias("q"))

    zero = F.struct(*[F.lit(0).cast("int").alias(c) for c in "ACGT"])
    length = F.array_max(F.transform("v", lambda x: F.when(x["s"].isNotNull() & x["q"].isNotNull(), F.greatest(F.length(x["s"]), F.length(x["q"])))))
    voted = F.when(length > 0, F.transform(F.sequence(F.lit(1), length), lambda i: F.aggregate("v", zero, add(i), call)))
    main = main.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    main = main.withColumn("w", F.when(~F.col("_plain"), voted))
    seq = F.when(F.col("_plain"), F.upper(sole["s"])).otherwise(F.array_join(F.transform("w", lambda x: x["b"]), ""))
    qual = F.when(F.col("_plain"), sole["q"]).otherwise(F.array_join(F.transform("w", lambda x: x["q"]), ""))
    return main.select("key", "cigar", *[F.col(f"r.{c}").alias(c) for c in rest], seq.alias("seq"), qual.alias("qual"), "xp")


def _consensus_by_votes(df: DataFrame, order: list[str], most: int, rest: list[str]) -> DataFrame:
    sizes = df.groupBy("key", "cigar").agg(F.count("*").alias("_c"))
    main = sizes.groupBy("key").agg(F.min_by("cigar", F.struct((-F.col("_c")).alias("c"), F.coalesce("cigar", F.lit("")).alias("s"))).alias("_main"), F.sum("_c").alias("xp"))
    on = F.col("key").eqNullSafe(F.col("_k"))
    members = df.join(main.withColumnRenamed("key", "_k"), on).where(F.col("cigar").eqNullSafe(F.col("_main")))
    letters = F.arrays_zip(F.split(F.upper("seq"), "").alias("b"), F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33).alias("q"))
    votes = members.select("key", F.posexplode(letters).alias("at", "x")).select("key", "at", "x.b", "x.q")
    votes = votes.groupBy("key", "at").agg(*[F.sum(F.when(F.col("b") == c, F.col("q")).otherwise(0)).alias(c) for c in "ACGT"])
    top = F.greatest(*[F.col(c) for c in "ACGT"])
    base = F.when(top <= 0, "N").when(F.col("A") == top, "A").when(F.col("C") == top, "C").when(F.col("G") == top, "G").otherwise("T")
    value = F.least(F.greatest(2 * top - (F.col("A") + F.col("C") + F.col("G") + F.col("T")), F.lit(0)), F.lit(most))
    votes = votes.select("key", "at", base.alias("b"), F.chr((value + 33).cast("long")).alias("q"))
    read = votes.groupBy(F.col("key").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("at", "b", "q"))).alias("v"))
    read = read.select("_k", F.array_join(F.transform("v", lambda x: x["b"]), "").alias("_seq"), F.array_join(F.transform("v", lambda x: x["q"]), "").alias("_qual"))
    best = collapse_cheap(members.drop("_k", "_main", "xp", "_quality"), order, ["cigar", *rest]).drop("xp")
    out = best.join(read, on, "left").drop("_k").join(main.select(F.col("key").alias("_k"), "xp"), on).drop("_k")
    return out.select("key", "cigar", *rest, F.col("_seq").alias("seq"), F.col("_qual").alias("qual"), "xp")
