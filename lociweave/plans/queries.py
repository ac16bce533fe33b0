"""Named queries over the fixture views, each a plan of the operators, with independent SQL for the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..fixtures import records, view, with_views
from ..operators import circular, dedup, intervals, meld, pairing, rewrite, sampling
from ..operators.expression import filter_records, print_values, sum_values

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    return df.select("qname", "ord", "flag", "mapq", "pos", "rname_id")


def _filter(name: str, expression: str, where: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(filter_records(records(spark, sf_dir), expression, view(spark, sf_dir, "refs"), view(spark, sf_dir, "read_groups")))

    run.__name__ = name
    query(f"SELECT qname, ord, flag, mapq, pos, rname_id FROM reads WHERE {where}")(run)


_filter("filter_mapq_reversed", "MAPQ >= 25 && reversed", "mapq >= 25 AND flag & 16 <> 0")
_filter("filter_regex_rg", 'RG ~ "^RG[01]$" && not RG ~ "1"', "rg = 'RG0'")
_filter("filter_precedence", "paired || reversed && MAPQ < 10", "flag & 1 <> 0 OR (flag & 16 <> 0 AND mapq < 10)")
_filter("filter_not", "not (paired || unmapped) && ! failed", "NOT (flag & 1 <> 0 OR flag & 4 <> 0) AND flag & 512 = 0")
_filter("filter_numbers", "XM > 3 && XO != 2 && LENGTH <= 50 && POS >= 100 && RNAME == 3", "xm > 3 AND xo <> 2 AND seq_len <= 50 AND pos >= 100 AND rname_id = 3")
_filter("filter_reference_name", 'RNAME ~ "[[:alpha:]]+[MX]" && MRNM !~ "^chr1$"', "rname_id IN (3, 4) AND (mrnm_id IS NULL OR mrnm_id <> 0)")
_filter("filter_library", 'library ~ "^lib" && sample ~ "1"', "rg IN ('RG0', 'RG1')")
_filter("filter_tags", "defined XM && isnum XM && isstring RG && !defined ZZ && wrongness < 1 && rgquality >= 9999 && XM >= 5", "xm >= 5")
_filter("filter_flags", "first-mate && mapped || second-mate && good && !reversed", "(flag & 64 <> 0 AND flag & 4 = 0) OR (flag & 128 <> 0 AND flag & 512 = 0 AND flag & 16 = 0)")


@query("""SELECT qname, ord, CASE WHEN mapq >= 30 THEN flag & ~512 ELSE flag | 512 END AS flag FROM reads
WHERE CASE WHEN mapq >= 30 THEN TRUE ELSE TRUE END""")
def filter_modifier_state(spark, d):
    """Flags as the expression leaves them: the side that isn't evaluated changes nothing."""
    out = filter_records(records(spark, d), "MAPQ >= 30 && clear-failed && good || set-failed && failed")
    return out.select("qname", "ord", "flag")


@query("""SELECT qname, ord, CAST(CASE WHEN mapq < 20 THEN 1 ELSE 2 END AS BIGINT) AS ff FROM reads WHERE mapq < 20 OR flag & 16 <> 0""")
def filter_extra_flags(spark, d):
    out = filter_records(records(spark, d), "MAPQ < 20 && set-trimmed && trimmed || reversed && set-merged && merged && !trimmed")
    return out.select("qname", "ord", S.tag_number(F.col("tags"), "FF").cast("long").alias("ff"))


@query("SELECT qname, ord, mapq FROM (SELECT * FROM reads WHERE mapq >= 40 ORDER BY qname, ord LIMIT 50)")
def filter_limit(spark, d):
    return filter_records(records(spark, d), "MAPQ >= 40", limit=50, order=["qname", "ord"]).select("qname", "ord", "mapq")


@query("SELECT qname, ord, coalesce(CASE WHEN lb IS NOT NULL THEN lb END, '') AS line FROM reads JOIN read_groups ON rg = rg_id")
def expr_print_library(spark, d):
    return print_values(records(spark, d), "library", read_groups=view(spark, d, "read_groups"), keep=("qname", "ord"))


@query("SELECT qname, ord, CASE WHEN lb IS NOT NULL THEN sm ELSE '' END AS line FROM reads JOIN read_groups ON rg = rg_id")
def expr_print_sample(spark, d):
    return print_values(records(spark, d), "sample", read_groups=view(spark, d, "read_groups"), keep=("qname", "ord"))


@query("SELECT qname, ord, concat(CAST(mapq AS VARCHAR), '.0') AS line FROM reads")
def expr_print_number(spark, d):
    return print_values(records(spark, d), "MAPQ", keep=("qname", "ord"))


@query("SELECT CAST(coalesce(sum(mapq), 0) AS DOUBLE) AS total FROM reads WHERE flag & 512 = 0")
def expr_sum_mapq(spark, d):
    return sum_values(filter_records(records(spark, d), "good"), "MAPQ")


@query("SELECT CAST(count(*) AS DOUBLE) AS total FROM reads WHERE mapq >= 25")
def expr_sum_one(spark, d):
    return sum_values(filter_records(records(spark, d), "MAPQ >= 25"), "1")


# ---- Rewrites ------------------------------------------------------------------------------------------


@query("SELECT qname, ord, flag & ~(1 | 2 | 64 | 128 | 8) AS flag, CAST(NULL AS INT) AS mrnm_id, -1 AS mpos, 0 AS isize FROM reads WHERE flag & 128 = 0 AND flag & 4 = 0")
def single_read_projection(spark, d):
    return rewrite.make_single(records(spark, d)).select("qname", "ord", "flag", "mrnm_id", "mpos", "isize")


@query("SELECT qname, ord FROM reads WHERE flag & 1 = 0 OR (flag & 2 <> 0 AND (flag & 4 <> 0) = (flag & 8 <> 0))")
def proper_filter(spark, d):
    return records(spark, d).where(dedup.proper()).select("qname", "ord")


@query("SELECT qname, ord FROM reads WHERE CASE WHEN flag & 3 = 3 THEN 0 ELSE seq_len END >= 45 AND mapq >= 20")
def min_length(spark, d):
    return dedup.clean(records(spark, d), improper=True, least_length=45, least_mapq=20).select("qname", "ord")


@query("SELECT qname, ord, xm > 5 AS changed, CAST(CASE WHEN xm > 5 THEN 3 ELSE 0 END AS BIGINT) AS ff, flag | 512 AS flag FROM reads")
def set_tags_and_flags(spark, d):
    df = records(spark, d)
    few, many = df.where("xm <= 5"), df.where("xm > 5")
    both = few.unionByName(rewrite.set_extra(rewrite.set_extra(many, S.TRIMMED), S.MERGED))
    return rewrite.set_failed(both).select("qname", "ord", F.map_contains_key("tags", F.lit("FF")).alias("changed"), S.tag_number(F.col("tags"), "FF").cast("long").alias("ff"), "flag")


@query("SELECT name, '*' AS strand, CASE chrom WHEN 0 THEN 'one' ELSE concat('c', chrom) END AS chrom, r_start + chrom * 10 - 1 AS r_start, r_end + chrom * 10 AS r_end FROM regions")
def translate_regions(spark, d):
    r = view(spark, d, "regions").withColumn("chrom", F.col("chrom").cast("string"))
    t = spark.sql("select cast(id as string) as ensembl, case id when 0 then 'one' else concat('c', id) end as ucsc, cast(id * 10 as int) as shift from range(5)")
    return rewrite.translate_chromosomes(rewrite.erase_strand(r), t, "r_start", "r_end").select("name", "strand", "chrom", "r_start", "r_end")


# ---- Duplicates ----------------------------------------------------------------------------------------

_ORDER = ["qname", "ord"]
_BEST, _COUNTED = ["qname", "ord", "mapq"], ["library", "flag", "mapq"]
_KEY = """k AS (SELECT *, CASE WHEN rg = 'RG0' THEN 'libA' WHEN rg = 'RG1' THEN 'libB' WHEN rg = 'RG2' THEN 's2' END AS library,
  flag & 1 <> 0 AND flag & 4 = 0 AND flag & 8 = 0 AND mpos >= 0 AS two FROM reads WHERE NOT (flag & 4 <> 0 AND flag & 8 <> 0) AND rname_id IS NOT NULL),
c AS (SELECT *, concat_ws('/', {library}, rname_id, {strand}, CASE WHEN two THEN concat_ws('/', 'p', least(pos, mpos), greatest(pos, mpos), coalesce(mrnm_id, -1), flag & 192) ELSE concat_ws('/', 's', pos) END) AS key FROM k)"""


def _sql_key(library: str = "library", strand: str = "flag & 16") -> str:
    return "WITH " + _KEY.format(library=library, strand=strand)


def _keyed(spark, d, ignore_strand: bool = False, ignore_rg: bool = False, sequences: bool = False) -> DataFrame:
    df = dedup.clean(records(spark, d, sequences), improper=True)
    return dedup.with_key(dedup.label(df, view(spark, d, "read_groups"), ignore_rg), ignore_strand)


@query(_sql_key() + " SELECT library, CAST(size AS BIGINT) AS size, count(*) AS clusters FROM (SELECT library, key, count(*) AS size FROM c GROUP BY library, key) GROUP BY ALL")
def dedup_clusters(spark, d):
    c = dedup.collapse_cheap(_keyed(spark, d), _ORDER, ["library"])
    return c.groupBy("library", F.col("xp").alias("size")).agg(F.count("*").alias("clusters"))


_CHEAP = " SELECT qname, ord, mapq, xp FROM (SELECT qname, ord, mapq, count(*) OVER (PARTITION BY key) AS xp, row_number() OVER (PARTITION BY key ORDER BY mapq DESC, qname, ord) AS n FROM c) WHERE n = 1"


@query(_sql_key().replace("FROM reads", "FROM sequences") + _CHEAP.replace("ORDER BY mapq", "ORDER BY list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) DESC, mapq"))
def dedup_cheap(spark, d):
    """The best by sum of qualities, then by mapping quality."""
    return dedup.collapse_cheap(_keyed(spark, d, sequences=True), _ORDER, _BEST).select("qname", "ord", "mapq", "xp")


@query("""WITH k AS (SELECT *, CASE WHEN rg = 'RG0' THEN 'libA' WHEN rg = 'RG1' THEN 'libB' ELSE 's2' END AS library, flag & 1 <> 0 AND flag & 4 = 0 AND flag & 8 = 0 AND mpos >= 0 AS two,
  flag & 1 = 0 AND xm % 2 = 0 AS merged, CASE cigar WHEN '20M' THEN 20 ELSE 18 END AS n FROM sequences WHERE NOT (flag & 4 <> 0 AND flag & 8 <> 0) AND rname_id IS NOT NULL),
c AS (SELECT *, concat_ws('/', library, rname_id, flag & 16, CASE WHEN two THEN concat_ws('/', 'p', least(pos, mpos), greatest(pos, mpos), coalesce(mrnm_id, -1), flag & 192)
  WHEN merged THEN concat_ws('/', 'm', pos + CASE WHEN flag & 16 <> 0 THEN n ELSE 0 END, n) ELSE concat_ws('/', 's', pos) END) AS key FROM k)""" + _CHEAP.replace("ORDER BY mapq", "ORDER BY list_sum(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) DESC, mapq"))
def dedup_merged(spark, d):
    """Merged reads go by their 5' end and length."""
    df = records(spark, d, True)
    df = df.withColumn("tags", F.when((F.col("xm") % 2 == 0) & (F.col("flag").bitwiseAND(1) == 0), S.put_tags(F.col("tags"), {"FF": S.tag_int(F.lit(S.MERGED))})).otherwise(F.col("tags")))
    df = dedup.with_key(dedup.label(dedup.clean(df, improper=True), view(spark, d, "read_groups")))
    return dedup.collapse_cheap(df, _ORDER, _BEST).select("qname", "ord", "mapq", "xp")


@query(_sql_key().replace("FROM reads", "FROM (SELECT * FROM reads WHERE NOT (flag & 4 <> 0 AND xm % 3 = 0))") + ", o AS (SELECT qname, ord, row_number() OVER (PARTITION BY key ORDER BY mapq DESC, qname, ord) AS n FROM c) SELECT qname, ord FROM o WHERE n = 1 UNION ALL SELECT qname, ord FROM reads WHERE flag & 4 <> 0 AND xm % 3 = 0")
def dedup_keep_junk(spark, d):
    """Every third unmapped read has an unmapped mate; those come back behind the others."""
    df = records(spark, d).withColumn("flag", _unmapped_mate())
    kept = dedup.collapse_cheap(dedup.with_key(dedup.label(dedup.clean(df, improper=True), view(spark, d, "read_groups"))), _ORDER)
    return dedup.keep_junk(kept, df).select("qname", "ord")


def _unmapped_mate():
    return F.when((F.col("flag").bitwiseAND(S.UNMAPPED) != 0) & (F.col("xm") % 3 == 0), F.col("flag").bitwiseOR(S.MATE_UNMAPPED)).otherwise(F.col("flag"))


@query(_sql_key(strand="0") + _CHEAP)
def dedup_no_strand(spark, d):
    return dedup.collapse_cheap(_keyed(spark, d, ignore_strand=True), _ORDER, _BEST).select("qname", "ord", "mapq", "xp")


@query(_sql_key(library="'x'") + _CHEAP)
def dedup_ignore_rg(spark, d):
    return dedup.collapse_cheap(_keyed(spark, d, ignore_rg=True), _ORDER, _BEST).select("qname", "ord", "mapq", "xp")


@query(_sql_key() + " SELECT qname, ord, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY mapq DESC, qname, ord) > 1 THEN flag | 1024 ELSE flag END AS flag FROM c")
def dedup_mark(spark, d):
    return dedup.mark(_keyed(spark, d), _ORDER).select("qname", "ord", "flag")


@query(_sql_key() + " SELECT qname, ord FROM c WHERE two OR NOT EXISTS (SELECT 1 FROM c p WHERE p.two AND p.library = c.library AND p.rname_id = c.rname_id AND p.pos = c.pos AND p.flag & 16 = c.flag & 16)")
def dedup_shadowed_singles(spark, d):
    return dedup.drop_shadowed(_keyed(spark, d)).select("qname", "ord")


@query(_sql_key() + """, s AS (SELECT count(*) AS n FROM c GROUP BY key), h AS (SELECT n, count(*) AS c FROM s WHERE n < 1024 GROUP BY n)
SELECT CAST(g.n AS INT) AS n, coalesce(h.c, 0) AS clusters FROM (SELECT unnest(range(0, (SELECT max(n) + 1 FROM h))) AS n) g LEFT JOIN h USING (n)""")
def dedup_histogram(spark, d):
    return dedup.histogram(dedup.collapse_cheap(_keyed(spark, d), _ORDER, []))


_COUNTS = (_sql_key() + """, o AS (SELECT *, count(*) OVER (PARTITION BY key) AS xp, row_number() OVER (PARTITION BY key ORDER BY mapq DESC, qname, ord) AS n FROM c),
w AS (SELECT *, CASE WHEN flag & 1 <> 0 THEN 1 ELSE 2 END AS w FROM o WHERE n = 1),
t AS (SELECT library, CAST(sum(w * xp) // 2 AS BIGINT) AS n_in, CAST(sum(w) // 2 AS BIGINT) AS n_out, CAST(sum(CASE WHEN mapq >= 20 THEN w ELSE 0 END) // 2 AS BIGINT) AS out_mq20,
  CAST(sum(CASE WHEN mapq >= 20 AND xp = 1 THEN w ELSE 0 END) // 2 AS BIGINT) AS single_mq20 FROM w GROUP BY library)""")  # fmt: skip


@query(_COUNTS + " SELECT * FROM t")
def dedup_library_counts(spark, d):
    return dedup.library_counts(dedup.collapse_cheap(_keyed(spark, d), _ORDER, _COUNTED))


@query(_COUNTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, b(library, i, lo, hi) AS (
  SELECT library, 0, CAST(1e-12 AS DOUBLE), CAST(700 AS DOUBLE) FROM t WHERE single_mq20 > 0 AND single_mq20 < out_mq20
  UNION ALL SELECT b.library, i + 1, CASE WHEN m / (exp(m) - 1) > s THEN m ELSE lo END, CASE WHEN m / (exp(m) - 1) > s THEN hi ELSE m END
    FROM (SELECT b.*, (lo + hi) / 2 AS m, single_mq20 / out_mq20 AS s FROM b JOIN t USING (library) WHERE i < 200) b),
e AS (SELECT library, out_mq20 / (1 - exp(-lo)) AS est FROM b JOIN t USING (library) WHERE i = 200)
SELECT library, n_in, n_out, CAST(round(est * n_out / out_mq20) AS BIGINT) AS molecules, CAST(round(est * n_out / out_mq20 - n_out) AS BIGINT) AS unseen, CAST(round(10000 * out_mq20 / est) AS BIGINT) AS exhausted_bp FROM t LEFT JOIN e USING (library)""")
def dedup_complexity(spark, d):
    c = dedup.complexity(dedup.library_counts(dedup.collapse_cheap(_keyed(spark, d), _ORDER, _COUNTED)))
    return c.select("library", "n_in", "n_out", F.round("molecules").cast("long").alias("molecules"), F.round("unseen").cast("long").alias("unseen"), F.round(100 * F.col("exhausted_pct")).cast("long").alias("exhausted_bp"))


@query("SELECT library, count(*) AS n FROM (SELECT CASE WHEN rg = 'RG0' THEN 'libA' WHEN rg = 'RG1' THEN 'libB' ELSE 's2' END AS library FROM reads) GROUP BY library")
def library_split_counts(spark, d):
    return dedup.label(records(spark, d), view(spark, d, "read_groups")).groupBy("library").agg(F.count("*").alias("n"))


# ---- Intervals -----------------------------------------------------------------------------------------

_SYMS = """sy AS (SELECT name AS n, row_number() OVER (ORDER BY min(line_no)) AS sym FROM annotations GROUP BY name),
a AS (SELECT chrom, unnest(CASE WHEN strand = '*' THEN ['+', '-'] ELSE [strand] END) AS strand, least(a_start, a_end) AS s, greatest(a_start, a_end) AS e, name, sym FROM annotations JOIN sy ON n = name WHERE a_start <> a_end),
r AS (SELECT *, unnest(CASE WHEN {strand} = '*' THEN ['+', '-'] ELSE [{strand}] END) AS st FROM regions),
i AS (SELECT DISTINCT r.name AS rn, st, a.name, sym FROM r JOIN a ON a.chrom = r.chrom AND a.strand = st AND s < r_end AND e > r_start),
m AS (SELECT *, max(e) OVER (PARTITION BY chrom, strand, name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM a),
g AS (SELECT *, sum(CASE WHEN pe >= s THEN 0 ELSE 1 END) OVER (PARTITION BY chrom, strand, name ORDER BY s, e) AS grp FROM m),
l AS (SELECT chrom, strand, name, sym, min(s) AS s, max(e) AS e FROM g GROUP BY chrom, strand, name, sym, grp),
cv AS (SELECT DISTINCT r.name AS rn, st, l.name, sym FROM r JOIN l ON l.chrom = r.chrom AND l.strand = st AND s <= r_start AND e >= r_end AND r_start < r_end)"""
_HITS = " SELECT r.name, coalesce(h, '') AS hits FROM regions r LEFT JOIN (SELECT rn, string_agg(name, ':' ORDER BY sym) AS h FROM (SELECT DISTINCT rn, name, sym FROM {src}) GROUP BY rn) ON rn = r.name"


def _intervals_sql(tail: str, strand: str = "strand") -> str:
    return "WITH " + _SYMS.format(strand=strand) + tail


def _annotated(spark, d, mode: str, **options) -> DataFrame:
    return intervals.annotate(view(spark, d, "regions"), view(spark, d, "annotations"), mode, **options)


def _hits(df: DataFrame) -> DataFrame:
    return df.select("name", F.array_join("hits", ":").alias("hits"))


@query(_intervals_sql(_HITS.format(src="i")))
def annotate_inclusive(spark, d):
    return _hits(_annotated(spark, d, "inclusive"))


@query(_intervals_sql(_HITS.format(src="cv")))
def annotate_covered(spark, d):
    return _hits(_annotated(spark, d, "covered"))


@query(_intervals_sql(_HITS.format(src="(SELECT * FROM i EXCEPT SELECT * FROM cv)")))
def annotate_partial(spark, d):
    return _hits(_annotated(spark, d, "partial"))


@query(_intervals_sql(_HITS.format(src="i"), "'*'"))
def annotate_nostrand(spark, d):
    return _hits(_annotated(spark, d, "inclusive", no_strand=True))


_NEAREST = """, bp AS (SELECT DISTINCT chrom, strand, unnest([s, e]) AS p FROM a), mi AS (SELECT * FROM r WHERE name NOT IN (SELECT rn FROM i)),
lf AS (SELECT mi.name AS rn, st, mi.chrom, r_start, max(e) AS p FROM mi JOIN a ON a.chrom = mi.chrom AND a.strand = st AND e <= r_start GROUP BY ALL),
rt AS (SELECT mi.name AS rn, st, mi.chrom, r_end, min(s) AS p FROM mi JOIN a ON a.chrom = mi.chrom AND a.strand = st AND s >= r_end GROUP BY ALL),
ca AS (SELECT rn, p - r_start AS d, sym, name FROM lf JOIN a ON a.chrom = lf.chrom AND a.strand = st AND e = p
  UNION ALL SELECT rn, (SELECT min(bp.p) FROM bp WHERE bp.chrom = rt.chrom AND bp.strand = rt.st AND bp.p > rt.p) - r_end + 1, sym, name FROM rt JOIN a ON a.chrom = rt.chrom AND a.strand = st AND s = p),
be AS (SELECT rn, name, d FROM ca QUALIFY row_number() OVER (PARTITION BY rn ORDER BY abs(d), d, sym) = 1),
hh AS (SELECT rn, string_agg(name, ':' ORDER BY sym) AS h FROM (SELECT DISTINCT rn, name, sym FROM i) GROUP BY rn)"""


@query(_intervals_sql(_NEAREST + " SELECT r.name, coalesce(h, '') AS hits, be.name AS near, CAST(d AS INT) AS distance FROM regions r LEFT JOIN hh ON hh.rn = r.name LEFT JOIN be ON be.rn = r.name"))
def annotate_nearest(spark, d):
    return _annotated(spark, d, "nearest").select("name", F.array_join("hits", ":").alias("hits"), "near", "distance")


@query(_intervals_sql(_NEAREST + " SELECT name, annotation FROM (SELECT r.name, coalesce(h, be.name || '@' || d) AS annotation FROM regions r LEFT JOIN hh ON hh.rn = r.name LEFT JOIN be ON be.rn = r.name) WHERE annotation IS NOT NULL"))
def annotate_table(spark, d):
    return intervals.table_lines(_annotated(spark, d, "nearest"))


@query(_intervals_sql(""" SELECT name AS annotation, CAST(sum(CASE WHEN f = 'even' THEN 1 ELSE 0 END) AS BIGINT) AS even, CAST(sum(CASE WHEN f = 'odd' THEN 1 ELSE 0 END) AS BIGINT) AS odd
FROM (SELECT DISTINCT rn, name, CASE WHEN CAST(substr(rn, 2) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS f FROM i) GROUP BY name"""))
def annotate_summary(spark, d):
    file = F.when(F.substring("name", 2, 20).cast("long") % 2 == 0, "even").otherwise("odd")
    return intervals.summary(_annotated(spark, d, "inclusive").withColumn("file", file), "file", ["even", "odd"])


# ---- Mates ---------------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    df = records(spark, d).select("qname", "ord", "flag", "rname_id", "pos", "mrnm_id", "mpos", "isize", F.col("seq_len").alias("length"))
    return pairing.pair(df, ["ord"])


_ALONE = "flag & 1 <> 0 AND NOT EXISTS (SELECT 1 FROM reads m WHERE m.qname = r.qname AND m.ord <> r.ord)"


@query(f"SELECT qname, ord, CASE WHEN flag & 1 = 0 THEN 'single' WHEN {_ALONE} THEN 'widow' ELSE 'pair' END AS kind FROM reads r")
def pair_mates(spark, d):
    p = _pairs(spark, d)
    return p.select("kind", F.explode(F.filter(F.array("r1", "r2"), lambda x: x.isNotNull())).alias("r")).select("r.qname", "r.ord", "kind")


def _widows(spark, d, kill: str) -> DataFrame:
    return pairing.records(pairing.settle_widows(_pairs(spark, d), kill)).select("qname", "ord", "flag", "mpos")


_WIDOWS = f"SELECT qname, ord, CASE WHEN {_ALONE} THEN flag & ~(1 | 2 | 64 | 128 | 8 | 32) ELSE flag END AS flag, CASE WHEN {_ALONE} THEN -1 ELSE mpos END AS mpos FROM reads r"


@query(_WIDOWS)
def pair_widows_none(spark, d):
    return _widows(spark, d, "none")


@query(f"{_WIDOWS} WHERE NOT ({_ALONE} AND flag & 4 <> 0)")
def pair_widows_unmapped(spark, d):
    return _widows(spark, d, "unmapped")


@query(f"{_WIDOWS} WHERE NOT ({_ALONE})")
def pair_widows_all(spark, d):
    return _widows(spark, d, "all")


@query(f"""SELECT qname, ord FROM reads r WHERE CASE WHEN flag & 1 = 0 OR {_ALONE} THEN flag & 4 = 0 OR (flag & 1 <> 0 AND flag & 8 = 0)
ELSE flag & 4 = 0 OR EXISTS (SELECT 1 FROM reads m WHERE m.qname = r.qname AND m.ord <> r.ord AND m.flag & 4 = 0) END""")
def pair_only_mapped(spark, d):
    return pairing.records(pairing.only_mapped(_pairs(spark, d))).select("qname", "ord")


_REPAIR = """WITH p AS (SELECT a.*, b.flag AS bf, b.rname_id AS br, b.pos AS bp, a.pos + CASE WHEN a.flag & 16 <> 0 THEN a.seq_len ELSE 0 END AS a5, b.pos + CASE WHEN b.flag & 16 <> 0 THEN b.seq_len ELSE 0 END AS b5
  FROM reads a JOIN reads b ON a.qname = b.qname AND a.ord <> b.ord AND a.flag & 1 <> 0),
f1 AS (SELECT *, (flag & ~(8 | 32)) | CASE WHEN bf & 4 <> 0 OR br IS NULL THEN 8 ELSE 0 END | CASE WHEN bf & 16 <> 0 THEN 32 ELSE 0 END | (bf & 512) | CASE WHEN rname_id IS NULL THEN 4 ELSE 0 END AS c FROM p),
f2 AS (SELECT *, CASE WHEN c & 12 = 0 AND rname_id = br THEN c ELSE c & ~2 END AS cf, CASE WHEN c & 12 = 0 AND rname_id = br THEN b5 - a5 ELSE 0 END AS ci FROM f1),
f3 AS (SELECT *, CASE WHEN flag & 8 <> 0 THEN flag & ~(512 | 32) ELSE flag & ~512 END <> CASE WHEN cf & 8 <> 0 THEN cf & ~(512 | 32) ELSE cf & ~512 END AS major FROM f2)"""


@query(_REPAIR + " SELECT qname, ord, cf AS flag, br AS mrnm_id, bp AS mpos, ci AS isize FROM f3")
def pair_repair(spark, d):
    p = pairing.repair(_pairs(spark, d)).where("kind = 'pair'")
    return pairing.records(p).select("qname", "ord", "flag", "mrnm_id", "mpos", "isize")


@query(_REPAIR + f""" SELECT (SELECT count(*) FROM reads) AS n_in, (SELECT count(*) FROM reads) AS n_out, (SELECT count(*) FROM reads WHERE flag & 1 = 0) AS n_singles, (SELECT count(*) FROM reads r WHERE {_ALONE}) AS n_widows,
CAST(sum(CASE WHEN mrnm_id IS DISTINCT FROM br THEN 1 ELSE 0 END) AS BIGINT) AS n_mrnm, CAST(sum(CASE WHEN mpos <> bp THEN 1 ELSE 0 END) AS BIGINT) AS n_mpos, CAST(sum(CASE WHEN ci <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_isize,
CAST(sum(CASE WHEN major THEN 1 ELSE 0 END) AS BIGINT) AS n_flags, CAST(sum(CASE WHEN NOT major AND flag <> cf THEN 1 ELSE 0 END) AS BIGINT) AS n_fflag FROM f3""")
def pair_stats(spark, d):
    return pairing.statistics(pairing.repair(_pairs(spark, d)))


@query(_REPAIR + """, x AS (SELECT qname, CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate, mrnm_id IS DISTINCT FROM br AS k1, mpos <> bp AS k2, ci <> 0 AS k3, major AS k4, NOT major AND flag <> cf AS k5 FROM f3)
SELECT qname, mate, 'mrnm' AS kind FROM x WHERE k1 UNION ALL SELECT qname, mate, 'mpos' FROM x WHERE k2 UNION ALL SELECT qname, mate, 'isize' FROM x WHERE k3 UNION ALL SELECT qname, mate, 'flags' FROM x WHERE k4 UNION ALL SELECT qname, mate, 'fflag' FROM x WHERE k5""")
def pair_repair_log(spark, d):
    return pairing.repairs(pairing.repair(_pairs(spark, d)))


# ---- Melding -------------------------------------------------------------------------------------------


def _alignments(spark, d) -> DataFrame:
    return view(spark, d, "alignments")


def _melded(spark, d, weights=None, where: str | None = None) -> DataFrame:
    a = _alignments(spark, d)
    if where:
        a = a.where(where)
    a = meld.by_name(a, ["mapq"])
    return meld.meld(a, 3, F.col("unmapped") == 1, meld.score(lambda k: F.col(k.lower()), weights))


_MELD = """WITH a AS (SELECT *, {score} AS score, (file_ordinal + 1) % 3 AS o, row_number() OVER (PARTITION BY qname ORDER BY unmapped, CASE WHEN unmapped = 1 THEN 0 ELSE {score} END, (file_ordinal + 1) % 3) AS n,
  sum(1 - unmapped) OVER (PARTITION BY qname) AS m FROM alignments {where}),
b AS (SELECT *, lead(score) OVER (PARTITION BY qname ORDER BY n) - score AS gap FROM a)
SELECT {columns} FROM b WHERE n = 1"""
_BWA = "30 * xm + 45 * xo + 15 * xg"


@query(_MELD.format(score=_BWA, columns="qname, file_ordinal, unmapped", where=""))
def meld_best(spark, d):
    return _melded(spark, d).select("qname", "file_ordinal", "unmapped")


@query(_MELD.format(score=_BWA, columns="qname, CAST(CASE WHEN m > 1 THEN least(mapq, gap) ELSE mapq END AS INT) AS mapq", where=""))
def meld_mapq(spark, d):
    return _melded(spark, d).select("qname", "mapq")


@query(_MELD.format(score="2 * xm + xo", columns="qname, file_ordinal, CAST(CASE WHEN m > 1 THEN least(mapq, gap) ELSE mapq END AS INT) AS mapq", where=""))
def meld_weighted(spark, d):
    return _melded(spark, d, {"XM": 2, "XO": 1}).select("qname", "file_ordinal", "mapq")


@query(_MELD.format(score=_BWA, columns="qname, file_ordinal, CAST(CASE WHEN m > 1 THEN least(mapq, gap) ELSE mapq END AS INT) AS mapq", where="WHERE (mapq + file_ordinal) % 4 <> 0"))
def meld_outer(spark, d):
    """Files that lack some of the reads."""
    return _melded(spark, d, where="(mapq + file_ordinal) % 4 <> 0").select("qname", "file_ordinal", "mapq")


# ---- Circular references, sorting, sampling ----------------------------------------------------------------


@query("""SELECT qname, ord, CAST(CASE WHEN rname_id = 3 AND pos >= 0 THEN 200 + ((pos - 200) % 1900 + 1900) % 1900 ELSE pos END AS INT) AS pos,
CAST(CASE WHEN mrnm_id = 3 AND mpos >= 0 THEN 200 + ((mpos - 200) % 1900 + 1900) % 1900 ELSE mpos END AS INT) AS mpos FROM (SELECT qname, ord, rname_id, mrnm_id, pos % 2100 AS pos, CASE WHEN mpos >= 0 THEN mpos % 2100 ELSE mpos END AS mpos FROM reads)""")
def circular_normalize(spark, d):
    df, refs = _ring(spark, d)
    lengths = circular.resolve([tuple(r) for r in refs.collect()], ["chrM:1900"])
    return circular.normalize(df, refs, lengths).select("qname", "ord", "pos", "mpos")


@query("""WITH p AS (SELECT qname, ord, rname_id, mapq, xm, pos % 2100 AS pos FROM reads), n AS (SELECT *, CASE WHEN rname_id = 3 THEN 200 + ((pos - 200) % 1900 + 1900) % 1900 ELSE pos END AS np,
  CASE WHEN xm % 3 = 0 THEN pos + 1900 ELSE pos + 7 END AS there FROM p)
SELECT qname, ord, CAST(CASE WHEN rname_id = 3 AND xm % 3 < 2 AND 200 + ((there - 200) % 1900 + 1900) % 1900 = np THEN 37 ELSE mapq END AS INT) AS mapq, NOT (rname_id = 3 AND xm % 3 < 2 AND 200 + ((there - 200) % 1900 + 1900) % 1900 = np) AS xa FROM n""")
def circular_doubled(spark, d):
    """A hit whose only alternative is the same place in the other copy of the padded part is a unique one."""
    df, refs = _ring(spark, d)
    strand = F.when(F.col("flag").bitwiseAND(S.REVERSED) != 0, "-").otherwise("+")
    there = F.when(F.col("xm") % 3 == 0, F.col("pos") + 1901).otherwise(F.col("pos") + 8)
    one = F.concat(F.lit("chrM,"), strand, there.cast("string"), F.lit(",20M,0;"))
    xa = F.when(F.col("xm") % 3 == 2, F.concat(one, one)).otherwise(one)
    df = df.withColumn("tags", S.put_tags(F.col("tags"), {"XA": S.tag_text(xa)}))
    out = circular.normalize(df, refs, circular.resolve([tuple(r) for r in refs.collect()], ["chrM:1900"]))
    return out.select("qname", "ord", "mapq", F.map_contains_key("tags", F.lit("XA")).alias("xa"))


def _ring(spark, d):
    """Records folded into references of 2100."""
    fold = lambda c: F.when(F.col(c) >= 0, F.col(c) % 2100).otherwise(F.col(c)).cast("int")
    return records(spark, d).withColumns({"pos": fold("pos"), "mpos": fold("mpos")}), view(spark, d, "refs").withColumn("sq_length", F.lit(2100))


@query("SELECT CAST(rname_id AS INT) AS rname_id, sq_name, CASE WHEN sq_name = 'chrM' THEN 1900 ELSE sq_length END AS sq_length FROM refs")
def circular_lengths(spark, d):
    refs = view(spark, d, "refs")
    return circular.rewrite_lengths(refs, circular.resolve([tuple(r) for r in refs.collect()], ["chrM:1900"]))


@query("SELECT qname, ord, CAST(row_number() OVER (PARTITION BY rname_id ORDER BY pos, qname, ord) AS INT) AS place FROM reads")
def sort_coordinate(spark, d):
    """The place of each record within its reference, by the order in which the sort returns them."""
    return _places(sampling.sort_records(records(spark, d), "qname", "ord").select("qname", "ord", "rname_id")).select("qname", "ord", "place")


def _places(df: DataFrame) -> DataFrame:
    """Adds place: the row's number within its reference as the rows come, partition after partition; rows of a reference must come together.

    A row's id is its partition and its number there, so that the first id of each partition and reference is enough: no task has a whole reference.
    """
    came = intervals.once(df.withColumn("_came", F.monotonically_increasing_id()))
    part = F.shiftright("_came", 33)
    firsts = came.groupBy(F.col("rname_id").alias("_r"), part.alias("_p")).agg(F.min("_came").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = F.broadcast(firsts.select("_r", "_p", "_first", before.alias("_before")))  # partitions and references
    placed = came.join(firsts, F.col("rname_id").eqNullSafe(F.col("_r")) & (part == F.col("_p")))
    return placed.withColumn("place", (F.col("_before") + F.col("_came") - F.col("_first") + 1).cast("int")).drop("_r", "_p", "_first", "_before")


@query("SELECT qname, ord, rname_id, pos, CASE WHEN flag & 16 <> 0 THEN 1 ELSE 0 END AS file_ordinal, CAST(row_number() OVER (PARTITION BY rname_id ORDER BY pos, qname, ord) AS INT) AS place FROM reads")
def merge_coordinate(spark, d):
    df = records(spark, d)
    merged = sampling.merge([df.where(~S.bit(F.col("flag"), S.REVERSED)), df.where(S.bit(F.col("flag"), S.REVERSED))], "qname", "ord")
    return _places(merged.select("qname", "ord", "rname_id", "pos", "file_ordinal")).select("qname", "ord", "rname_id", "pos", "file_ordinal", "place")


@query("SELECT r.qname, ord FROM reads r JOIN (SELECT qname FROM reads GROUP BY qname ORDER BY md5(qname), qname LIMIT 500) s ON r.qname = s.qname")
def sample_groups(spark, d):
    return sampling.sample_groups(records(spark, d), "qname", 500).select("qname", "ord")


@query("""SELECT rname_id, count(*) AS runs FROM (SELECT rname_id, rg, lag(rg) OVER (PARTITION BY rname_id ORDER BY pos, qname, ord) AS p FROM reads) WHERE p IS DISTINCT FROM rg GROUP BY rname_id""")
def run_grouping(spark, d):
    return sampling.run_ids(records(spark, d), "rg", ["pos", "qname", "ord"], ["rname_id"]).groupBy("rname_id").agg(F.max("run").alias("runs"))


@query("SELECT qname, ord, rname_id FROM reads WHERE rname_id IN (1, 2)")
def range_scan(spark, d):
    return sampling.range_scan(records(spark, d), "2-3").select("qname", "ord", "rname_id")
