"""Queries on the level of bases, names and lines, and the legacy variants of others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..fixtures import records, view
from ..operators import circular, dedup, intervals, meld, pairing, rewrite, sampling
from ..operators.expression import filter_records
from ..sources import sinks
from ..sources.fastq import remove_warts
from .queries import _KEY, _NEAREST, _SYMS, _alignments, _annotated, _pairs, _REPAIR, query


@query("SELECT qname, ord, concat('@', qname, CASE WHEN flag & 64 <> 0 THEN '/1' WHEN flag & 128 <> 0 THEN '/2' ELSE '' END, chr(10), seq, chr(10), '+', chr(10), qual) AS fastq FROM sequences")
def fastq_render(spark, d):
    return rewrite.fastq_lines(records(spark, d, True)).select("qname", "ord", "fastq")


@query("""SELECT qname, concat_ws(chr(9), qname, flag, n.sq_name, pos + 1, mapq, cigar, CASE WHEN mrnm_id IS NULL THEN '*' WHEN mrnm_id = s.rname_id THEN '=' ELSE m.sq_name END, mpos + 1, 0, seq, qual, 'RG:Z:' || rg, 'XM:i:' || xm, 'XO:i:' || xo) AS value
FROM sequences s JOIN refs n ON n.rname_id = s.rname_id LEFT JOIN refs m ON m.rname_id = mrnm_id""")
def sam_lines(spark, d):
    df = records(spark, d, True)
    return sinks.sam_lines(df, view(spark, d, "refs")).select(F.element_at(F.split("value", "\t"), 1).alias("qname"), "value")


_Q = "CASE WHEN flag & 16 <> 0 THEN list_reverse(q0) ELSE q0 END"


@query(f"""WITH a AS (SELECT *, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS q0 FROM sequences), b AS (SELECT *, {_Q} AS q FROM a),
k AS (SELECT *, CASE WHEN flag & 4 <> 0 THEN coalesce(list_max(list_filter(range(1, 21), lambda i: q[i] >= 20)), 0) ELSE 20 END AS n FROM b)
SELECT qname, ord, CASE WHEN flag & 16 <> 0 THEN right(seq, n) ELSE left(seq, n) END AS seq, CASE WHEN flag & 16 <> 0 THEN right(qual, n) ELSE left(qual, n) END AS qual FROM k""")
def trim_quality(spark, d):
    """Unmapped reads only: trimming breaks alignments."""
    return rewrite.trim_quality(records(spark, d, True)).select("qname", "ord", "seq", "qual")


@query(f"""WITH a AS (SELECT *, list_transform(string_split(qual, ''), lambda c: ascii(c) - 33) AS q0 FROM sequences), b AS (SELECT *, {_Q} AS q FROM a),
k AS (SELECT *, coalesce(list_min(list_filter(range(0, 20), lambda i: list_sum(q[i + 1 : 20]) <= 18 * (20 - i))), 20) AS n FROM b),
g AS (SELECT *, min(n) OVER (PARTITION BY qname) AS least FROM k)
SELECT qname, ord, CASE WHEN flag & 16 <> 0 THEN right(seq, n) ELSE left(seq, n) END AS seq FROM g WHERE least > 0""")
def trim_average(spark, d):
    return rewrite.trim_average(records(spark, d, True), 18, "qname").select("qname", "ord", "seq")


@query("WITH " + _KEY.format(library="library", strand="flag & 16").replace("FROM reads", "FROM sequences") + """,
z AS (SELECT key, cigar, count(*) AS n FROM c GROUP BY ALL), mc AS (SELECT key, cigar, sum(n) OVER (PARTITION BY key) AS xp, row_number() OVER (PARTITION BY key ORDER BY n DESC, cigar) AS r FROM z),
m AS (SELECT c.*, xp FROM c JOIN mc ON c.key = mc.key AND c.cigar = mc.cigar AND r = 1),
v AS (SELECT key, p, upper(substr(seq, p, 1)) AS b, ascii(substr(qual, p, 1)) - 33 AS q FROM (SELECT *, unnest(range(1, 21)) AS p FROM m)),
s AS (SELECT key, p, b, sum(q) AS q FROM v GROUP BY ALL), t AS (SELECT key, p, sum(q) AS total FROM s GROUP BY ALL),
w AS (SELECT s.*, total, row_number() OVER (PARTITION BY s.key, s.p ORDER BY q DESC, b) AS r FROM s JOIN t ON s.key = t.key AND s.p = t.p),
f AS (SELECT key, string_agg(CASE WHEN q > 0 THEN b ELSE 'N' END, '' ORDER BY p) AS seq, string_agg(chr(CAST(33 + least(greatest(2 * q - total, 0), 60) AS INT)), '' ORDER BY p) AS qual FROM w WHERE r = 1 GROUP BY key)
SELECT DISTINCT m.library, rname_id, cigar, f.seq, f.qual, CAST(xp AS BIGINT) AS xp, f.key AS id FROM f JOIN m ON m.key = f.key""".replace(", f.key AS id", ""))
def dedup_consensus(spark, d):
    df = dedup.clean(records(spark, d, True), improper=True)
    # The aligned length takes part in no key here: the reads aren't merged.
    df = dedup.with_key(dedup.label(df, view(spark, d, "read_groups")))
    return dedup.collapse_consensus(df, ["qname", "ord"], keep=["library", "rname_id"]).select("library", "rname_id", "cigar", "seq", "qual", "xp").distinct()


@query("""WITH n AS (SELECT qname, ord, rname_id, flag, cigar, CASE WHEN rname_id = 3 THEN pos % 500 ELSE pos END AS pos, CASE cigar WHEN '20M' THEN 20 ELSE 18 END AS len FROM sequences),
o AS (SELECT *, rname_id = 3 AND pos + len > 500 AS over, 500 - pos AS l, pos + len - 500 AS r FROM n)
SELECT qname, ord, CAST(pos AS INT) AS pos, CASE WHEN NOT over THEN cigar WHEN cigar = '20M' THEN concat(l, 'M', r, 'S') WHEN l < 12 THEN concat(l, 'M', r + 2, 'S') WHEN l = 12 THEN '12M2I6S' ELSE concat('12M2I', l - 12, 'M', r, 'S') END AS cigar, flag FROM o
UNION ALL SELECT qname, ord, 0, CASE WHEN cigar = '20M' THEN concat(l, 'S', r, 'M') WHEN l < 12 THEN concat(l, 'S', 12 - l, 'M2I6M') WHEN l = 12 THEN '14S6M' ELSE concat(l + 2, 'S', r, 'M') END, flag | 256 FROM o WHERE over""")
def wrap_split(spark, d):
    df = records(spark, d, True)
    return circular.wrap(df, {3: 500}).select("qname", "ord", "pos", "cigar", "flag")


@query("""SELECT qname, ord FROM sequences WHERE mapq >= 25 AND ((ord % 2 = 0 AND substr(seq, 2, 1) = 'T') OR (ord % 2 = 1 AND substr(seq, 20, 1) = 'A'))""")
def filter_deaminated(spark, d):
    """MD claims a C at the second place of even records, a G at the last of odd ones."""
    df = records(spark, d, True)
    n = F.when(F.col("cigar") == "20M", 18).otherwise(16)  # inserted bases have no place in MD
    md = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("1C"), n.cast("string"))).otherwise(F.concat((n + 1).cast("string"), F.lit("G0")))
    df = df.withColumn("tags", S.put_tags(F.col("tags"), {"MD": S.tag_text(md)}))
    return filter_records(df, "MAPQ >= 25 && deaminated 2").select("qname", "ord")


@query("""SELECT CAST(ord AS INT) AS ord, qname, CASE xm % 6 WHEN 0 THEN 64 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 0 END AS mate, CASE xm % 6 WHEN 3 THEN 2 WHEN 4 THEN 1 END AS ff, xm % 6 = 4 AS xp, CASE WHEN xm % 6 = 5 THEN 'ACGT' END AS xi, CASE WHEN xm % 6 = 5 THEN 'TTT' END AS xj FROM reads""")
def fastq_warts(spark, d):
    df = view(spark, d, "reads")
    kind = F.col("xm") % 6
    name = F.when(kind == 0, F.concat("qname", F.lit("/1"))).when(kind == 1, F.concat(F.lit("F_"), "qname")).when(kind == 2, F.concat(F.lit("R_"), "qname")).when(kind == 3, F.concat(F.lit("M_"), "qname"))
    name = name.when(kind == 4, F.concat(F.lit("C_T_"), "qname")).otherwise(F.concat("qname", F.lit("#ACGT,TTT")))
    raw = df.select("ord", name.alias("qname"), F.lit("").alias("description"), F.lit(S.UNMAPPED).alias("flag"), F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<t:string,i:bigint,f:double,s:string>>>")).alias("tags"))
    t = lambda k: S.tag(F.col("tags"), k)
    return remove_warts(raw).select("ord", "qname", F.col("flag").bitwiseAND(S.FIRST | S.SECOND).alias("mate"), t("FF")["i"].cast("int").alias("ff"), F.coalesce(t("XP")["i"] == -1, F.lit(False)).alias("xp"), t("XI")["s"].alias("xi"), t("XJ")["s"].alias("xj"))


@query("SELECT count(DISTINCT qname) AS groups FROM reads")
def count_groups(spark, d):
    return sampling.count_groups(records(spark, d), "qname")


@query("WITH " + _SYMS.format(strand="strand") + """, lb AS (SELECT chrom AS c2, strand AS s2, max(e) AS lb FROM a GROUP BY ALL),
lc AS (SELECT DISTINCT r.name AS rn, l.name, sym FROM r JOIN lb ON c2 = r.chrom AND s2 = st JOIN l ON l.chrom = r.chrom AND l.strand = st AND s <= r_start AND e >= least(r_end, lb) AND s < r_end AND e > r_start)
SELECT r.name, coalesce(h, '') AS hits FROM regions r LEFT JOIN (SELECT rn, string_agg(name, ':' ORDER BY sym) AS h FROM (SELECT DISTINCT rn, name, sym FROM lc) GROUP BY rn) ON rn = r.name""")
def annotate_covered_legacy(spark, d):
    return _annotated(spark, d, "covered", legacy_tail=True).select("name", F.array_join("hits", ":").alias("hits"))


@query("WITH " + _SYMS.format(strand="strand") + _NEAREST.replace("ORDER BY abs(d), d, sym", "ORDER BY d, sym") + " SELECT r.name, be.name AS near, CAST(d AS INT) AS distance FROM regions r LEFT JOIN be ON be.rn = r.name")
def annotate_nearest_legacy(spark, d):
    return _annotated(spark, d, "nearest", legacy_signed=True).select("name", "near", "distance")


@query("WITH " + _SYMS.format(strand="strand") + """ SELECT r.name, coalesce(h, '') || CASE WHEN h IS NULL THEN '' ELSE ':' || h END AS hits FROM regions r
LEFT JOIN (SELECT rn, string_agg(name, ':' ORDER BY sym) AS h FROM (SELECT DISTINCT rn, name, sym FROM i) GROUP BY rn) ON rn = r.name""")
def annotate_combined(spark, d):
    """Two sets that happen to be one: hits of both, not made distinct."""
    one = _annotated(spark, d, "inclusive")
    return intervals.combine([one, one], ["name"]).select("name", F.array_join("hits", ":").alias("hits"))


@query(_REPAIR + " SELECT qname, ord, CASE WHEN major THEN cf ELSE flag END AS flag FROM f3")
def pair_repair_legacy(spark, d):
    p = pairing.repair(_pairs(spark, d), legacy_fflag=True).where("kind = 'pair'")
    return pairing.records(p).select("qname", "ord", "flag")


@query("""WITH a AS (SELECT *, 30 * xm + 45 * xo + 15 * xg AS score, (file_ordinal + 1) % 3 AS o FROM alignments),
b AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY unmapped, CASE WHEN unmapped = 1 THEN 0 ELSE score END, o) AS n FROM a)
SELECT qname, coalesce(string_agg(CASE WHEN unmapped = 0 AND n > 1 THEN concat_ws(',', 'chr2', CASE WHEN xg = 1 THEN '-' ELSE '+' END || xm, '9M', xm) END, ';' ORDER BY n), '') AS xa FROM b GROUP BY qname HAVING min(unmapped) = 0""")
def meld_alternatives(spark, d):
    """The losing alignments as the XA tag of the best."""
    a = _alignments(spark, d)
    flag = F.when(F.col("xg") == 1, S.REVERSED).otherwise(0).bitwiseOR(F.when(F.col("unmapped") == 1, S.UNMAPPED).otherwise(0))
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:struct<t:string,i:bigint,f:double,s:string>>>"))
    a = a.select("qname", "file_ordinal", "mapq", "unmapped", flag.alias("flag"), F.lit(1).alias("rname_id"), F.col("xm").alias("pos"), F.lit("9M").alias("cigar"), S.put_tags(empty, {k: S.tag_int(F.col(c)) for k, c in (("XM", "xm"), ("XO", "xo"), ("XG", "xg"), ("NM", "xm"))}).alias("tags"))
    m = meld.meld(meld.by_name(a, ["mapq"]), 3, F.col("unmapped") == 1, meld.score(), refs=view(spark, d, "refs"))
    return m.where("unmapped = 0").select("qname", S.tag_string(F.col("tags"), "XA").alias("xa"))
