"""Annotation of regions by interval joins: names with any overlap, names that cover, those that don't, or the nearest.

Regions and annotations are half-open. Bins have levels of eightfold width. An interval's level is the first whose bins are as
wide as it, so that it touches two at most there and on all wider levels, of which only those are used that the other side has; a pair meets on the wider of its levels, on (chrom, strand,
level, bin), whether it is a base in a chromosome or the other way round, and no interval is cut in many pieces. A pair that shares both
bins is taken in the first of them only, so nothing has to be made distinct. Where "nearest" asks for the annotation before or behind a place, the gaps between breakpoints tile
the line, and the question is a lookup of a point in an interval: no sort of all regions, no partition per chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("inclusive", "covered", "partial", "nearest")


def parse_strand(text: Column) -> Column:
    """Both if missing, empty or 0; reverse if it begins with -; else forward, a point included."""
    return F.when(text.isNull() | (text == "") | (text == "0"), "*").when(text.startswith("-"), "-").otherwise("+")


def expand_strand(df: DataFrame) -> DataFrame:
    """One row per strand; both means two."""
    return df.withColumn("strand", F.explode(F.when(F.col("strand") == "*", F.array(F.lit("-"), F.lit("+"))).otherwise(F.array("strand"))))


def symbols(annotations: DataFrame, order: list[str]) -> DataFrame:
    """name, sym: where each name appears first. It orders the names as numbers would, without a sort of all of them."""
    return annotations.groupBy("name").agg(F.min(F.struct(*order)).alias("sym"))


def index(annotations: DataFrame, order: list[str], start: str = "a_start", end: str = "a_end") -> DataFrame:
    """chrom, strand (+ or -), s, e, name, sym of each annotation that isn't empty, ends in order whichever way they were given."""
    named = annotations.join(symbols(annotations, order), "name")
    a = expand_strand(named.select("chrom", "strand", F.least(start, end).alias("s"), F.greatest(start, end).alias("e"), "name", "sym"))
    return a.where("s < e")


def islands(idx: DataFrame) -> DataFrame:
    """Intervals of one name on one strand that overlap or touch, joined."""
    w = Window.partitionBy("chrom", "strand", "name").orderBy("s", "e")
    new = F.when(F.col("s") <= F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    marked = idx.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("chrom", "strand", "name", "sym", "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


#: Bins of level k are 2 ** (4 + 3 * k) wide: from 16 to more than any position.
LEVELS = range(10)


def _level(start: Column, end: Column) -> Column:
    n, out = end - start, F.lit(LEVELS[-1])
    for k in reversed(LEVELS[:-1]):
        out = F.when(n <= 1 << (4 + 3 * k), k).otherwise(out)
    return out


def _levels(df: DataFrame, start: str, end: str) -> tuple[list[int], int]:
    """The levels that there are, ten at most, and the number of intervals that aren't empty."""
    r = df.where(F.col(start) < F.col(end)).agg(F.collect_set(_level(F.col(start), F.col(end))).alias("x"), F.count("*").alias("n")).first()
    return sorted(r["x"]), r["n"]


#: Rows with bins that may be sent to all executors; more are shuffled, whatever size Spark takes them for: it doesn't see that a row becomes several.
BROADCAST_ROWS = 100_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _bins(start: Column, end: Column, levels) -> Column:
    """Rows (k, bin) of the bins that an interval touches on its own level, and on wider ones if they are among ``levels``."""
    own = _level(start, end)
    at = lambda k: F.transform(F.sequence(F.shiftright(start, 4 + 3 * k), F.shiftright(end - 1, 4 + 3 * k)), lambda b: F.struct(F.lit(k).alias("k"), b.alias("bin")))
    none = F.array().cast("array<struct<k:int,bin:int>>")
    return F.explode(F.flatten(F.array(*[F.when(own == k if k not in levels else own <= k, at(k)).otherwise(none) for k in LEVELS])))


def overlap_join(regions: DataFrame, idx: DataFrame, wider: list[int], start: str, end: str) -> DataFrame:
    """Rows of regions (with strand + or -) and of idx that overlap; an empty region overlaps nothing. wider: the levels of regions, so that idx is put in bins of no others."""
    levels, n = _levels(idx, "s", "e")
    left = regions.where(F.col(start) < F.col(end)).withColumn("_l", _level(F.col(start), F.col(end))).withColumn("_b", _bins(F.col(start), F.col(end), levels))
    right = idx.select(*[F.col(c).alias(f"x_{c}") for c in idx.columns], _level(F.col("s"), F.col("e")).alias("x_l"), _bins(F.col("s"), F.col("e"), wider).alias("x_b"))
    left = left.withColumns({"_k": F.col("_b.k"), "_bin": F.col("_b.bin")}).drop("_b")
    right = right.withColumns({"x_k": F.col("x_b.k"), "x_bin": F.col("x_b.bin")}).drop("x_b")
    first = F.greatest(F.col(start), F.col("x_s"))
    on = (F.col("chrom") == F.col("x_chrom")) & (F.col("strand") == F.col("x_strand")) & (F.col("_k") == F.col("x_k")) & (F.col("_bin") == F.col("x_bin"))
    met = F.col("_k") == F.greatest("_l", "x_l")
    hit = (F.col("x_s") < F.col(end)) & (F.col("x_e") > F.col(start)) & (F.call_function("shiftright", first, 4 + 3 * F.col("_k")) == F.col("_bin"))
    return left.join(_sized(right, 2 * n * (1 + len(wider))), on & met & hit).drop("_l", "_k", "_bin", "x_l", "x_k", "x_bin", "x_chrom", "x_strand")


def _point_join(points: DataFrame, at: str, gaps: DataFrame) -> DataFrame:
    """Rows of points and the one row of gaps (chrom, strand, lo, hi, ...) with lo <= at < hi. A gap is sought on its own level only."""
    levels, n = _levels(gaps, "lo", "hi")
    place = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright(F.col(at), 4 + 3 * k).alias("bin")) for k in levels]) if levels else F.array().cast("array<struct<k:int,bin:int>>")
    left = points.withColumn("_b", F.explode(place)).withColumns({"_k": F.col("_b.k"), "_bin": F.col("_b.bin")}).drop("_b")
    right = gaps.select(*[F.col(c).alias(f"g_{c}") for c in gaps.columns], _bins(F.col("lo"), F.col("hi"), ()).alias("g_b")).withColumns({"g_k": F.col("g_b.k"), "g_bin": F.col("g_b.bin")}).drop("g_b")
    on = (F.col("chrom") == F.col("g_chrom")) & (F.col("strand") == F.col("g_strand")) & (F.col("_k") == F.col("g_k")) & (F.col("_bin") == F.col("g_bin"))
    return left.join(_sized(right, 2 * n), on & (F.col(at) >= F.col("g_lo")) & (F.col(at) < F.col("g_hi"))).drop("_k", "_bin", "g_k", "g_bin", "g_chrom", "g_strand")


def once(df: DataFrame) -> DataFrame:
    """df, computed once however often it is used: written to the checkpoint folder that the cluster names, or kept in memory and on disk where none is named."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _neighbours(idx: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Gaps with the annotation that ends before them, what ends last; gaps with the annotation that starts behind them, what starts first. In each the least symbol of those at the breakpoint."""
    w = Window.partitionBy("chrom", "strand").orderBy("p")
    points = idx.select("chrom", "strand", F.explode(F.array("s", "e")).alias("p")).distinct().withColumn("next", F.lead("p").over(w))
    ends = idx.groupBy("chrom", "strand", F.col("e").alias("p")).agg(F.min(F.struct("sym", "name")).alias("who")).withColumn("hi", F.lead("p").over(w))
    starts = idx.groupBy("chrom", "strand", F.col("s").alias("p")).agg(F.min(F.struct("sym", "name")).alias("who")).join(points, ["chrom", "strand", "p"]).withColumn("lo", F.lag("p").over(w))
    left = ends.where("hi is not null").select("chrom", "strand", F.col("p").alias("lo"), "hi", "p", "who")
    last = ends.where("hi is null").select("chrom", "strand", "p", "who")
    # An end in (previous start, start] has that start behind it.
    right = starts.where("lo is not null").select("chrom", "strand", (F.col("lo") + 1).alias("lo"), (F.col("p") + 1).alias("hi"), "p", "next", "who")
    first = starts.where("lo is null").select("chrom", "strand", "p", "next", "who")
    return left, last, right, first


def _outer(points: DataFrame, side: DataFrame) -> DataFrame:
    """side has one row per chromosome and strand."""
    on = (F.col("chrom") == F.col("g_chrom")) & (F.col("strand") == F.col("g_strand"))
    return points.join(F.broadcast(side.select(*[F.col(c).alias(f"g_{c}") for c in side.columns])), on).drop("g_chrom", "g_strand")


def annotate(regions: DataFrame, annotations: DataFrame, mode: str = "inclusive", order: list[str] | None = None, start: str = "r_start", end: str = "r_end", no_strand: bool = False,
             legacy_tail: bool = False, legacy_signed: bool = False, true_distance: bool = False) -> DataFrame:
    """regions with hits (names by first appearance in ``order``), and for "nearest" without hits near and distance.

    covered: names whose joined intervals hold the whole region; legacy_tail leaves what lies beyond the last breakpoint of
    the strand out of account. partial: names that overlap on a strand without covering there. nearest: of the neighbours
    before (distance start to end, 0 or less) and behind, the nearer; legacy_signed compares signed distances, so that
    any before goes first. The distance behind is measured to the end of the first stretch there, plus 1, as the
    original has it; true_distance measures to its beginning. Repeated regions give repeated rows.
    """
    if mode not in MODES:
        raise ValueError(mode)
    idx = index(annotations, order or ["line_no"])
    idx = once(idx) if mode == "nearest" else idx
    wider, _ = _levels(regions, start, end)
    keys = regions.columns
    copies = regions.groupBy(*keys).agg(F.count("*").alias("_copies"))
    q = copies.withColumn("_strand", F.lit("*") if no_strand else F.col("strand"))
    key = [f"k_{i}" for i in range(len(keys))]
    q = q.select(*[F.col(c).alias(k) for c, k in zip(keys, key)], "chrom", F.col("_strand").alias("strand"), F.col(start).alias("b"), F.col(end).alias("t"), "_copies")
    each = expand_strand(q)
    pair = F.struct(F.col("x_sym").alias("sym"), F.col("x_name").alias("name"))
    by = [*key, "_copies"]
    if mode in ("inclusive", "nearest"):
        got = overlap_join(each, idx, wider, "b", "t").groupBy(*by).agg(F.collect_set(pair).alias("h"))
    else:
        isl = islands(idx)
        last = F.broadcast(idx.groupBy(F.col("chrom").alias("l_chrom"), F.col("strand").alias("l_strand")).agg(F.max("e").alias("last")))
        reach = F.col("t")
        if legacy_tail:
            each = each.join(last, (F.col("chrom") == F.col("l_chrom")) & (F.col("strand") == F.col("l_strand")), "left").drop("l_chrom", "l_strand")
            reach = F.least("t", "last")
        over = overlap_join(each, isl, wider, "b", "t")
        full = (F.col("x_s") <= F.col("b")) & (F.col("x_e") >= reach)
        got = over.where(full if mode == "covered" else ~full)
        # An island that covers a region is the only one of its name that touches it, so "not covering" may be asked of each.
        got = got.groupBy(*by).agg(F.collect_set(pair).alias("h"))
    out = q.join(got.drop("_copies"), key, "left").select(*key, "_copies", "chrom", "strand", "b", "t", F.coalesce("h", F.array().cast(got.schema["h"].dataType)).alias("h"))
    near, distance = F.lit(None).cast("string"), F.lit(None).cast("int")
    if mode == "nearest":
        out = once(out)  # five branches follow
        missed = expand_strand(out.where(F.size("h") == 0).select(*key, "chrom", "strand", "b", "t"))
        left, last, right, first = _neighbours(idx)
        before = F.struct((F.col("g_p") - F.col("b")).alias("d"), F.col("g_who.sym").alias("sym"), F.col("g_who.name").alias("name"))
        to = (F.col("g_p") - F.col("t")) if true_distance else (F.col("g_next") - F.col("t") + 1)
        behind = F.struct(to.alias("d"), F.col("g_who.sym").alias("sym"), F.col("g_who.name").alias("name"))
        c = [
            _point_join(missed, "b", left).select(*key, before.alias("c")), _outer(missed, last).where("b >= g_p").select(*key, before.alias("c")),
            _point_join(missed, "t", right).select(*key, behind.alias("c")), _outer(missed, first).where("t <= g_p").select(*key, behind.alias("c")),
        ]
        all_ = c[0].unionByName(c[1]).unionByName(c[2]).unionByName(c[3])
        rank = F.struct((F.col("c.d") if legacy_signed else F.abs("c.d")).alias("a"), F.col("c.d").alias("d"), F.col("c.sym").alias("sym"), F.col("c.name").alias("name"))
        best = all_.groupBy(*key).agg(F.min(rank).alias("near"))
        out = out.join(best, key, "left").select(*key, "_copies", "h", "near")
        near, distance = F.col("near.name"), F.col("near.d").cast("int")
    hits = F.transform(F.array_sort("h"), lambda x: x["name"])
    out = out.select(*[F.col(k).alias(c) for c, k in zip(keys, key)], hits.alias("hits"), near.alias("near"), distance.alias("distance"), F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_c"))
    return out.drop("_c")


def table_lines(annotated: DataFrame) -> DataFrame:
    """name TAB hits joined by a colon, or name TAB near@distance; regions without either are left out."""
    hit = F.when(F.size("hits") > 0, F.array_join("hits", ":")).otherwise(F.concat("near", F.lit("@"), F.col("distance").cast("string")))
    return annotated.where((F.size("hits") > 0) | F.col("near").isNotNull()).select("name", hit.alias("annotation"))


def table_file(annotated: DataFrame) -> DataFrame:
    """value: the table's lines; the header line is the first."""
    head = annotated.sparkSession.sql("select '#RegionName\\tID' as value")
    return head.unionByName(table_lines(annotated).select(F.concat_ws("\t", "name", "annotation").alias("value")))


def summary(annotated: DataFrame, file: str, files: list[str] | None = None) -> DataFrame:
    """annotation, and for each input file how many of its regions hit it; near misses don't count."""
    one = annotated.select(file, F.explode("hits").alias("annotation"))
    p = one.groupBy("annotation").pivot(file, files) if files else one.groupBy("annotation").pivot(file)
    return p.count().na.fill(0)


def combine(sets: list[DataFrame], keys: list[str]) -> DataFrame:
    """Results of several annotation sets for the same regions: hits (in order, not made distinct) beat near misses, of which the absolutely nearest stays."""
    out = None
    for n, s in enumerate(sets):
        s = s.select(*keys, F.lit(n).alias("_n"), "hits", "near", "distance")
        out = s if out is None else out.unionByName(s)
    hits = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", "hits"))), lambda x: x["hits"]))
    near = F.min(F.when(F.col("near").isNotNull(), F.struct(F.abs("distance").alias("a"), F.col("_n").alias("n"), F.col("near").alias("near"), F.col("distance").alias("distance"))))
    g = out.groupBy(*keys).agg(hits.alias("hits"), near.alias("m"))
    free = F.size("hits") == 0
    return g.select(*keys, "hits", F.when(free, F.col("m.near")).alias("near"), F.when(free, F.col("m.distance")).alias("distance"))


class AnnotationCache:
    """Annotation sets by name: read once, kept in executors' memory and disk, used again."""

    def __init__(self):
        self.sets: dict[str, DataFrame] = {}

    def get(self, name: str, load) -> DataFrame:
        if name not in self.sets:
            self.sets[name] = load().persist()
        return self.sets[name]

    def drop(self, name: str) -> None:
        self.sets.pop(name).unpersist()
