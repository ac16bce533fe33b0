"""Record to record: flags, tags, mate fields, strands, index reads, trimming, FastQ text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

INDEX_TAGS = ("XI", "XJ", "YI", "YJ")


def make_single(df: DataFrame) -> DataFrame:
    """First mates and unpaired reads that are mapped, with all pairing forgotten but the mate's strand."""
    df = S.have(df, "flag", "mrnm_id", "mpos", "isize")
    kept = df.where(~S.bit(F.col("flag"), S.SECOND) & ~S.bit(F.col("flag"), S.UNMAPPED))
    return _forget(kept, S.PAIRED | S.PROPER | S.FIRST | S.SECOND | S.MATE_UNMAPPED)


def divorce(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Records (those of ``where``) as unpaired reads."""
    return _forget(S.have(df, "flag", "mrnm_id", "mpos", "isize"), S.PAIRED | S.PROPER | S.FIRST | S.SECOND | S.MATE_UNMAPPED | S.MATE_REVERSED, where)


def _forget(df: DataFrame, mask: int, where: Column | None = None) -> DataFrame:
    new = {"flag": S.clear(F.col("flag"), mask), "mrnm_id": F.lit(None).cast("int"), "mpos": F.lit(-1), "isize": F.lit(0)}
    return df.withColumns({k: v if where is None else F.when(where, v).otherwise(F.col(k)) for k, v in new.items()})


def strip_multimap(df: DataFrame, primary_only: bool = False) -> DataFrame:
    """Without multi-mapping tags. primary_only drops records that aren't their read's first alignment; else one with HI, IH or NH other than 1 is an error."""
    n = lambda k: F.when(F.map_contains_key("tags", F.lit(k)), S.tag_number(F.col("tags"), k)).otherwise(1.0)
    if primary_only:
        df = df.where(F.coalesce(n("HI"), F.lit(1.0)) == 1)
        return df.withColumn("tags", F.map_filter("tags", lambda k, _: ~k.isin("HI", "IH", "NH")))
    bad = F.coalesce((n("HI") != 1) | (n("IH") != 1) | (n("NH") != 1), F.lit(False))
    return df.withColumn("flag", F.when(bad, F.raise_error(F.concat(F.lit("cannot deal with multiple alignments of "), F.col("qname"))).cast("int")).otherwise(F.col("flag")))


def set_extra(df: DataFrame, mask: int) -> DataFrame:
    """Bits of the FF tag set; a record that has them is left alone."""
    old = S.tag_number(F.col("tags"), "FF").cast("int")
    new = old.bitwiseOR(mask)
    return df.withColumn("tags", F.when(new != old, S.put_tags(F.col("tags"), {"FF": S.tag_int(new)})).otherwise(F.col("tags")))


def set_failed(df: DataFrame, failed: bool = True) -> DataFrame:
    return df.withColumn("flag", S.set_bits(F.col("flag"), S.FAILED) if failed else S.clear(F.col("flag"), S.FAILED))


def erase_strand(regions: DataFrame) -> DataFrame:
    return regions.withColumn("strand", F.lit("*"))


def translate_chromosomes(regions: DataFrame, table: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Names of ``table`` (ensembl, ucsc, shift) changed and coordinates shifted: start + shift - 1, end + shift. An unknown name is an error."""
    t = F.broadcast(table.select(F.col("ensembl").alias("_e"), F.col("ucsc").alias("_u"), F.col("shift").alias("_o")))
    df = regions.join(t, F.col("chrom") == F.col("_e"), "left")
    name = F.coalesce("_u", F.raise_error(F.concat(F.lit("unknown chromosome "), F.coalesce("chrom", F.lit("null")))).cast("string"))
    return df.withColumns({"chrom": name, start: F.col(start) + F.col("_o") - 1, end: F.col(end) + F.col("_o")}).select(*regions.columns)


def split_index(pairs: DataFrame, length: int) -> DataFrame:
    """pairs: r1, r2 (null for a single read) with seq, qual and tags. The last bases of the first read become the index XI of both, their qualities YI."""
    seq, qual = F.col("r1.seq"), F.col("r1.qual")
    n = F.greatest(F.length(seq) - length, F.lit(0))
    new = {"XI": S.tag_text(F.substring(seq, n + 1, F.lit(length)))}
    quality = F.substring(qual, n + 1, F.lit(length))
    tagged = lambda r: F.when(F.coalesce(F.length(qual), F.lit(0)) > 0, S.put_tags(F.col(f"{r}.tags"), new | {"YI": S.tag_text(quality)})).otherwise(S.put_tags(F.col(f"{r}.tags"), new))
    first = F.col("r1").withField("tags", tagged("r1")).withField("seq", F.substring(seq, F.lit(1), n)).withField("qual", F.substring(qual, F.lit(1), n))
    return pairs.withColumns({"r1": first, "r2": F.when(F.col("r2").isNotNull(), F.col("r2").withField("tags", tagged("r2")))})


def force_mates(pairs: DataFrame) -> DataFrame:
    """Both records of r1, r2 flagged as mates; a failed mate fails both; index tags are shared, the first mate's preferred."""
    failed = (F.col("r1.flag").bitwiseOR(F.col("r2.flag"))).bitwiseAND(S.FAILED)
    tags = {}
    for k in INDEX_TAGS:
        tags[k] = F.coalesce(S.tag(F.col("r1.tags"), k), S.tag(F.col("r2.tags"), k))

    def shared(r: str) -> Column:
        t = S.put_tags(F.col(f"{r}.tags"), tags)
        return F.map_filter(t, lambda _, v: v.isNotNull())

    def mate(r: str, is_: int, not_: int) -> Column:
        flag = S.clear(F.col(f"{r}.flag"), not_).bitwiseOR(S.PAIRED | is_).bitwiseOR(failed)
        return F.when(F.col("r2").isNotNull(), F.col(r).withField("flag", flag).withField("tags", shared(r))).otherwise(F.col(r))

    return pairs.withColumns({"r1": mate("r1", S.FIRST, S.SECOND), "r2": mate("r2", S.SECOND, S.FIRST)})


def explode_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.filter(F.array("r1", "r2"), lambda x: x.isNotNull())).alias("r")).select("r.*")


def _qualities(qual: Column) -> Column:
    """Numbers of a quality string (offset 33)."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def _shorten(df: DataFrame, keep: Column) -> DataFrame:
    """The first ``keep`` bases in sequencing direction; the read is stored reversed where its flag says so."""
    back = S.bit(F.col("flag"), S.REVERSED)
    begin = F.when(back, F.length("seq") - keep + 1).otherwise(F.lit(1))
    return df.withColumns({"seq": F.substring(F.col("seq"), begin, keep), "qual": F.substring(F.col("qual"), begin, keep)})


def trim_quality(df: DataFrame, least: int = 20, mapped_pass: bool = True) -> DataFrame:
    """Cuts the longest 3' end whose qualities are all below ``least``. Merged reads pass; so do mapped ones, which trimming would break, unless mapped_pass is off."""
    ff = S.tag_number(F.col("tags"), "FF").cast("int")
    passes = ff.bitwiseAND(S.MERGED) != 0
    if mapped_pass:
        passes = passes | ~S.bit(F.col("flag"), S.UNMAPPED)
    q = _qualities(F.col("qual"))
    forward = F.when(S.bit(F.col("flag"), S.REVERSED), F.reverse(q)).otherwise(q)
    keep = F.coalesce(F.array_max(F.transform(forward, lambda x, i: F.when(x >= least, i + 1).otherwise(0))), F.lit(0))
    cut = ~passes & F.col("qual").isNotNull() & (F.length("qual") > 0) & (keep < F.length("seq"))
    return _shorten(df, F.when(cut, keep).otherwise(F.length("seq")))


def trim_average(df: DataFrame, most: int, pair_id: str | None = None) -> DataFrame:
    """Cuts where the average quality of the rest is ``most`` or less, at the first such base. A read that loses all goes, and with it its mate (rows that share pair_id)."""
    q = _qualities(F.col("qual"))
    forward = F.when(S.bit(F.col("flag"), S.REVERSED), F.reverse(q)).otherwise(q)
    df = df.withColumn("_q", forward)
    n = F.size("_q")
    total = F.aggregate("_q", F.lit(0), lambda a, x: a + x)
    # One pass from the left: what is left of the sum, and the first place where it is small enough.
    init = F.struct(F.lit(0).alias("i"), total.alias("rest"), F.lit(-1).alias("at"))
    fold = F.aggregate("_q", init, lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["rest"] - x).alias("rest"), F.when((a["at"] < 0) & (a["rest"] <= most * (n - a["i"])), a["i"]).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    whole = (F.coalesce(F.length("qual"), F.lit(0)) == 0)
    df = df.withColumn("_keep", F.when(whole | (fold < 0), F.length("seq")).otherwise(fold)).drop("_q")
    df = df.withColumn("_gone", (F.col("_keep") == 0) & ~whole)
    if pair_id is None:
        df = df.where(~F.col("_gone"))
    else:
        from pyspark.sql.window import Window

        df = df.withColumn("_gone", F.max("_gone").over(Window.partitionBy(pair_id))).where(~F.col("_gone"))
    return _shorten(df, F.col("_keep")).drop("_keep", "_gone")


def fastq_lines(df: DataFrame, suffix: bool = True) -> DataFrame:
    """Adds fastq: the record as four lines."""
    s = F.when(S.bit(F.col("flag"), S.FIRST), "/1").when(S.bit(F.col("flag"), S.SECOND), "/2").otherwise("") if suffix else F.lit("")
    return df.withColumn("fastq", F.concat(F.lit("@"), "qname", s, F.lit("\n"), "seq", F.lit("\n+\n"), "qual"))
