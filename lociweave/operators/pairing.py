"""Mates found by name, their fields repaired, widows divorced or dropped, all with one shuffle by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.alignment import aligned_length

INDEX_TAGS = ("XI", "XJ", "YI", "YJ", "RG", "BC")


def _ready(df: DataFrame) -> DataFrame:
    df = S.have(df, "flag", "rname_id", "pos", "mrnm_id", "mpos", "isize")
    if "tags" in df.columns:
        return df.withColumn("alnid", S.tag_number(F.col("tags"), "XI").cast("long"))
    return df.withColumn("alnid", F.lit(0).cast("long"))


def pair(df: DataFrame, order: list[str] | None = None, wrong_roles: str = "error") -> DataFrame:
    """kind (single, pair, widow), r1, r2 (null but for pairs): the i-th first mate of a name goes with its i-th second mate.

    A paired record that is neither or both mates is an error; wrong_roles "quarantine" gives it the kind "wrong".
    """
    df = _ready(df)
    flag = F.col("flag")
    first, second = S.bit(flag, S.FIRST), S.bit(flag, S.SECOND)
    role = F.when(~S.bit(flag, S.PAIRED), 0).when(first & ~second, 1).when(second & ~first, 2).otherwise(3)
    if wrong_roles == "error":
        role = F.when(role == 3, F.raise_error(F.concat(F.lit("no first or second mate: "), F.col("qname"))).cast("int")).otherwise(role)
    columns = [c for c in df.columns if c != "alnid"]
    order = order or ["file_ordinal", "rec_no"]
    r = F.struct(*columns)
    df = df.withColumn("_role", role).repartition("qname", "alnid")  # windows and groups below keep to this partitioning
    w = Window.partitionBy("qname", "alnid", "_role").orderBy(*order)
    df = df.select("qname", "alnid", "_role", F.when(F.col("_role").isin(1, 2), 0).otherwise(1).alias("_single"), F.row_number().over(w).alias("_i"), r.alias("r"))
    # Records that are no mates stand alone.
    alone = F.when(F.col("_single") == 1, F.col("_i") * 4 + F.col("_role")).otherwise(0)
    g = df.groupBy("qname", "alnid", F.when(F.col("_single") == 1, 0).otherwise(F.col("_i")).alias("_i"), alone.alias("_alone")).agg(
        F.max("_role").alias("_role"), F.first(F.when(F.col("_role") != 2, F.col("r")), ignorenulls=True).alias("a"),
        F.first(F.when(F.col("_role") == 2, F.col("r")), ignorenulls=True).alias("b"),
    )
    kind = F.when(F.col("_role") == 0, "single").when(F.col("_role") == 3, "wrong").when(F.col("a").isNotNull() & F.col("b").isNotNull(), "pair").otherwise("widow")
    return g.select(kind.alias("kind"), F.coalesce("a", "b").alias("r1"), F.when(F.col("a").isNotNull(), F.col("b")).alias("r2"))


def only_mapped(pairs: DataFrame) -> DataFrame:
    """A single or widow if it is mapped, or paired with a mapped mate; a pair if either is."""
    f = F.col("r1.flag")
    alone = ~S.bit(f, S.UNMAPPED) | (S.bit(f, S.PAIRED) & ~S.bit(f, S.MATE_UNMAPPED))
    either = ~S.bit(f, S.UNMAPPED) | ~S.bit(F.coalesce("r2.flag", F.lit(S.UNMAPPED)), S.UNMAPPED)
    return pairs.where(F.when(F.col("kind") == "pair", either).otherwise(alone))


def _pos5(r: str, fields: list[str]) -> Column:
    length = aligned_length(F.col(f"{r}.cigar")) if "cigar" in fields else F.col(f"{r}.length") if "length" in fields else F.col(f"{r}.seq_len")
    return F.when(S.bit(F.col(f"{r}.flag"), S.REVERSED), F.col(f"{r}.pos") + length).otherwise(F.col(f"{r}.pos"))


def _mask(where: Column, mask: int) -> Column:
    return F.when(where, mask).otherwise(0)


def _flag(a: str, b: str) -> Column:
    """The flag that a should have, but for whether the pair is a proper one."""
    fa, fb = F.col(f"{a}.flag"), F.col(f"{b}.flag")
    out = S.clear(fa, S.MATE_UNMAPPED | S.MATE_REVERSED).bitwiseOR(fb.bitwiseAND(S.FAILED)).bitwiseOR(_mask(S.bit(fb, S.REVERSED), S.MATE_REVERSED))
    out = out.bitwiseOR(_mask(S.bit(fb, S.UNMAPPED) | F.col(f"{b}.rname_id").isNull(), S.MATE_UNMAPPED))
    return out.bitwiseOR(_mask(F.col(f"{a}.rname_id").isNull(), S.UNMAPPED))


def _compared(f: Column) -> Column:
    """A flag without what may be wrong in a common way."""
    return f.bitwiseAND(F.when(S.bit(f, S.MATE_UNMAPPED), ~(S.FAILED | S.MATE_REVERSED)).otherwise(~S.FAILED))


def repair(pairs: DataFrame, legacy_fflag: bool = False) -> DataFrame:
    """pairs with mate reference, mate position, insert size, flags and index tags of each mate put right from the other.

    Adds fix1, fix2: which of mrnm, mpos, isize, flags, fflag, ixs were wrong. fflag are flags that are wrong in a common
    way (failure not passed on; strand of an unmapped mate); legacy_fflag leaves those alone and counts all others, as the
    original does.
    """
    fields = pairs.select("r1.*").columns
    columns = pairs.columns
    # In steps, so that what is used several times is computed once and the generated code stays small.
    mates = (("r1", "r2", "1"), ("r2", "r1", "2"))
    df = pairs.withColumns({f"_f{i}": _flag(a, b) for a, b, i in mates} | {f"_p{i}": _pos5(a, fields) for a, _, i in mates})
    well = (F.col("_f1").bitwiseAND(S.UNMAPPED | S.MATE_UNMAPPED) == 0) & F.col("r1.rname_id").eqNullSafe(F.col("r2.rname_id"))
    df = df.withColumns({"_well": well, "_size": F.col("_p2") - F.col("_p1")})
    df = df.withColumns({f"_f{i}": F.col(f"_f{i}").bitwiseAND(F.when(F.col("_well"), -1).otherwise(~S.PROPER)) for _, _, i in mates} | {"_size": F.when(F.col("_well"), F.col("_size")).otherwise(0)})
    df = df.withColumns({f"_major{i}": _compared(F.col(f"{a}.flag")) != _compared(F.col(f"_f{i}")) for a, _, i in mates})
    both = {k: F.greatest(S.tag_string(F.col("r1.tags"), k), S.tag_string(F.col("r2.tags"), k)) for k in INDEX_TAGS} if "tags" in fields else {}
    if both:
        df = df.withColumn("_ixs", F.struct(*[v.alias(k) for k, v in both.items()]))
        df = df.withColumns({f"_ixs{i}": S.any_of([S.tag_string(F.col(f"{a}.tags"), k) != F.col(f"_ixs.{k}") for k in INDEX_TAGS]) for a, _, i in mates})
    two, new = F.col("kind") == "pair", {}
    for a, b, i in mates:
        old, flag, major = F.col(f"{a}.flag"), F.col(f"_f{i}"), F.col(f"_major{i}")
        isize = F.col("_size") if i == "1" else -F.col("_size")
        common = (old != flag) & ~major
        fixes = {
            "mrnm": ~F.col(f"{a}.mrnm_id").eqNullSafe(F.col(f"{b}.rname_id")), "mpos": F.col(f"{a}.mpos") != F.col(f"{b}.pos"), "isize": F.col(f"{a}.isize") != isize,
            "flags": major, "fflag": ~common if legacy_fflag else common,
        }
        values = {"mrnm_id": F.col(f"{b}.rname_id"), "mpos": F.col(f"{b}.pos"), "isize": isize.cast("int"), "flag": F.when(major, flag).otherwise(old).cast("int") if legacy_fflag else flag.cast("int")}
        if both:
            fixes["ixs"] = F.col(f"_ixs{i}")
            values["tags"] = F.when(F.col(f"_ixs{i}"), S.put_tags(F.col(f"{a}.tags"), {k: S.tag_text(F.col(f"_ixs.{k}")) for k in INDEX_TAGS})).otherwise(F.col(f"{a}.tags"))
        new[a] = F.when(two, F.struct(*[values.get(c, F.col(f"{a}.{c}")).alias(c) for c in fields])).otherwise(F.col(a))
        new[f"fix{i}"] = F.when(two, F.struct(*[v.alias(k) for k, v in fixes.items()]))
    return df.withColumns(new).select(*columns, "fix1", "fix2")


def settle_widows(pairs: DataFrame, kill: str = "none") -> DataFrame:
    """Widows made singles; kill "unmapped" drops those that are unmapped, "all" drops them all."""
    if kill not in ("none", "unmapped", "all"):
        raise ValueError(kill)
    widow = F.col("kind") == "widow"
    if kill == "all":
        return pairs.where(~widow)
    if kill == "unmapped":
        pairs = pairs.where(~(widow & S.bit(F.col("r1.flag"), S.UNMAPPED)))
    lone = S.clear(F.col("r1.flag"), S.PAIRED | S.PROPER | S.FIRST | S.SECOND | S.MATE_UNMAPPED | S.MATE_REVERSED)
    r = F.col("r1").withField("flag", lone).withField("mrnm_id", F.lit(None).cast("int")).withField("mpos", F.lit(-1)).withField("isize", F.lit(0))
    return pairs.withColumn("r1", F.when(widow, r).otherwise(F.col("r1")))


def records(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.filter(F.array("r1", "r2"), lambda x: x.isNotNull())).alias("r")).select("r.*")


def statistics(repaired: DataFrame, kill: str = "none") -> DataFrame:
    """Records in and out, singles, widows, and repairs of each kind, in one pass over repair's result."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    kind = F.col("kind")
    gone = {"none": F.lit(False), "all": kind == "widow", "unmapped": (kind == "widow") & S.bit(F.col("r1.flag"), S.UNMAPPED)}[kill]
    size = F.when(kind == "pair", 2).otherwise(1)
    fixes = repaired.select("fix1.*").columns
    return repaired.agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_in"), F.coalesce(F.sum(F.when(gone, 0).otherwise(size)), F.lit(0)).cast("long").alias("n_out"), n(kind == "single").alias("n_singles"), n(kind == "widow").alias("n_widows"),
        *[(n(F.coalesce(f"fix1.{f}", F.lit(False))) + n(F.coalesce(f"fix2.{f}", F.lit(False)))).alias(f"n_{f}") for f in fixes],
    )


def repair_lines(pairs: DataFrame, kinds: tuple[str, ...] = ("mrnm", "mpos", "isize", "flags", "fflag", "ixs")) -> DataFrame:
    """qname, mate, line: each repair of these kinds with the wrong value and the right one; pairs: not yet repaired."""
    fixed = repair(pairs.withColumns({"_r1": F.col("r1"), "_r2": F.col("r2")}))
    tagged = "ixs" in fixed.select("fix1.*").columns

    def of(a: str, fix: str, mate: int) -> DataFrame:
        old, new = F.col(f"_{a}"), F.col(a)
        number = lambda c: F.coalesce(c, F.lit(-1)).cast("string")
        hexa = lambda c: F.lpad(F.hex(c.cast("long")), 3, "0")
        bits = lambda word: F.concat(F.lit("FLAG "), hexa(old["flag"]), F.lit(f" is {word} (+"), hexa(new["flag"].bitwiseAND(F.bitwise_not(old["flag"]))), F.lit(",-"), hexa(old["flag"].bitwiseAND(F.bitwise_not(new["flag"]))), F.lit(")"))
        plain = lambda name, c: F.concat(F.lit(f"{name} "), number(old[c]), F.lit(" is wrong ("), number(new[c]), F.lit(")"))
        said = {"mrnm": plain("MRNM", "mrnm_id"), "mpos": plain("MPOS", "mpos"), "isize": plain("ISIZE", "isize"), "flags": bits("wrong"), "fflag": bits("technically wrong")}
        if tagged:
            show = lambda r: F.concat_ws(",", *[S.tag_string(r["tags"], k) for k in INDEX_TAGS])
            said["ixs"] = F.concat(F.lit("Index fields "), show(old), F.lit(" are wrong ("), show(new), F.lit(")"))
        each = F.filter(F.array(*[F.when(F.col(f"{fix}.{k}"), said[k]) for k in kinds if k in said]), lambda x: x.isNotNull())
        return fixed.where("kind = 'pair'").select(old["qname"].alias("qname"), F.lit(mate).alias("mate"), F.explode(each).alias("line"))

    return of("r1", "fix1", 1).unionByName(of("r2", "fix2", 2))


def repairs(repaired: DataFrame) -> DataFrame:
    """qname, mate, kind of every repair that was made."""
    fixes = repaired.select("fix1.*").columns
    rows = lambda r, fix, mate: repaired.where("kind = 'pair'").select(F.col(f"{r}.qname").alias("qname"), F.lit(mate).alias("mate"), F.explode(F.filter(F.array(*[F.when(F.col(f"{fix}.{f}"), F.lit(f)) for f in fixes]), lambda x: x.isNotNull())).alias("kind"))
    return rows("r1", "fix1", 1).unionByName(rows("r2", "fix2", 2))
