"""Queries on text formats, files written and read again, index reads, mates in step, and tags that mates share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..fixtures import records, view
from ..operators import dedup, merging, pairing, rewrite, sampling
from ..sources import bam, fastq, sinks, text
from .queries import _COUNTED, _COUNTS, _REPAIR, _keyed, _ORDER, _pairs, query


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names, or a local one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lociweave-")
    return f"{base.rstrip('/')}/files/{uuid.uuid4().hex}"


def _lines(df: DataFrame, value, number: str) -> DataFrame:
    return df.select(value.alias("value"), F.lit(0).alias("file_ordinal"), F.col(number).cast("long").alias("line_no"))


def _regions(spark, d) -> DataFrame:
    return view(spark, d, "regions").withColumn("n", F.substring("name", 2, 20).cast("long"))


_STRAND = "CASE n % 5 WHEN 0 THEN '*' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '*' ELSE '+' END"
_FIELDS = f"SELECT name, 'chr' || chrom AS chrom, {_STRAND} AS strand, r_start AS start, r_end AS \"end\", n AS line_no FROM (SELECT *, CAST(substr(name, 2) AS BIGINT) AS n FROM regions)"


def _strand():
    n = F.col("n") % 5
    return F.when(n == 0, "").when(n == 1, "+").when(n == 2, "-x").when(n == 3, "0").otherwise(".")


@query(f"{_FIELDS} WHERE n % 7 > 1")
def bed_parse(spark, d):
    """Lines of BED; every seventh is a comment, every seventh a track line."""
    bed = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chrom")), "r_start", "r_end", "name", F.lit("0"), _strand())
    n = F.col("n") % 7
    value = F.when(n == 0, F.concat(F.lit("#"), bed)).when(n == 1, F.concat(F.lit("track name="), bed)).otherwise(bed)
    return text.parse_bed(_lines(_regions(spark, d), value, "n")).select("name", "chrom", "strand", "start", "end", "line_no")


@query(f"{_FIELDS.replace('n % 5 WHEN 0', 'n % 5 WHEN 7')} WHERE n % 5 > 0")
def five_columns(spark, d):
    value = F.concat(F.lit("  "), F.concat_ws(" \t", "name", F.concat(F.lit("chr"), F.col("chrom")), "r_start", "r_end", _strand()))
    return text.parse_5col(_lines(_regions(spark, d).where("n % 5 > 0"), value, "n")).select("name", "chrom", "strand", "start", "end", "line_no")


@query("""WITH r AS (SELECT *, CAST(substr(name, 2) AS BIGINT) AS n FROM regions), b AS (SELECT n, chrom, r_start AS s, r_end AS e FROM r UNION ALL SELECT n, chrom + 1, r_start + 5, r_end + 9 FROM r WHERE n % 2 = 0)
SELECT concat('chr', chrom, ':-:', s, ':', e, 'x') AS name, 'chr' || chrom AS chrom, '-' AS strand, s AS start, e AS "end" FROM b""")
def fasta_regions(spark, d):
    """Headers with one or two regions, and lines of sequence between."""
    region = lambda c, s, e: F.concat(F.lit("chr"), c, F.lit(":-:"), s, F.lit(":"), e, F.lit("x"))
    r = _regions(spark, d)
    two = F.when(F.col("n") % 2 == 0, F.concat(F.lit(";"), region(F.col("chrom") + 1, F.col("r_start") + 5, F.col("r_end") + 9))).otherwise("")
    heads = _lines(r, F.concat(F.lit(">"), region(F.col("chrom"), F.col("r_start"), F.col("r_end")), two), "n")
    return text.parse_fasta_regions(heads.unionByName(_lines(r, F.lit("ACGTNacgt"), "n"))).select("name", "chrom", "strand", "start", "end")


@query("SELECT concat('c', n % 100) AS ensembl, concat('u', max(n)) AS ucsc, CAST(max(n) % 1000 AS INT) AS shift FROM (SELECT CAST(substr(name, 2) AS BIGINT) AS n FROM regions) GROUP BY n % 100")
def chromosome_table(spark, d):
    """Names that come again: the last line holds."""
    n = F.col("n")
    value = F.concat_ws("\t", F.concat(F.lit("c"), n % 100), F.concat(F.lit("u"), n), n % 1000)
    return text.parse_chromosomes(_lines(_regions(spark, d), value, "n"))


_RECORD = "qname, ord, flag, rname_id, pos, mapq, cigar, mrnm_id, mpos, 0 AS isize, seq, qual, rg, CAST(xm AS BIGINT) AS xm"


def _unpacked(df: DataFrame) -> DataFrame:
    t = lambda k: S.tag(F.col("tags"), k)
    return df.select("qname", t("XN")["i"].cast("int").alias("ord"), "flag", "rname_id", "pos", "mapq", "cigar", "mrnm_id", "mpos", "isize", "seq", "qual", t("RG")["s"].alias("rg"), t("XM")["i"].alias("xm"))


def _numbered(spark, d) -> DataFrame:
    return records(spark, d, True).withColumn("tags", S.put_tags(F.col("tags"), {"XN": S.tag_int(F.col("ord"))}))


@query(f"SELECT {_RECORD} FROM sequences")
def sam_parse(spark, d):
    """Records as lines of SAM, parsed again."""
    refs = view(spark, d, "refs")
    lines = sinks.sam_lines(_numbered(spark, d), refs)
    return _unpacked(text.parse_sam(lines.withColumn("line_no", F.col("rec_no")), refs))


@query(f"SELECT {_RECORD} FROM sequences")
def sam_files(spark, d):
    """Written as SAM with its header, and read again."""
    path = _scratch(spark)
    sinks.write_sam(_numbered(spark, d), view(spark, d, "refs"), path, view(spark, d, "read_groups"), "query sam_files")
    return _unpacked(text.read_sam(spark, path)[0])


@query(f"SELECT {_RECORD} FROM sequences")
def bam_files(spark, d):
    """Written as BAM and read again."""
    path = _scratch(spark).removeprefix("file://")
    bam.write_bam(S.have(_numbered(spark, d), "isize"), view(spark, d, "refs"), path)
    return _unpacked(bam.read_bam(spark, path)[0])


@query("SELECT * FROM refs")
def sam_header(spark, d):
    refs, groups = text.parse_sam_header(spark, sinks.header_lines(view(spark, d, "refs"), view(spark, d, "read_groups"), "query"))
    return refs


@query("SELECT * FROM read_groups")
def sam_read_groups(spark, d):
    return text.parse_sam_header(spark, sinks.header_lines(view(spark, d, "refs"), view(spark, d, "read_groups")))[1]


@query("SELECT qname AS name, sq_name AS chrom, CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END AS strand, pos AS start, pos + CASE cigar WHEN '20M' THEN 20 ELSE 18 END AS \"end\" FROM sequences JOIN refs USING (rname_id) WHERE flag & 4 = 0")
def records_as_regions(spark, d):
    return text.records_as_regions(records(spark, d, True), view(spark, d, "refs")).select("name", "chrom", "strand", "start", "end")


@query("""SELECT CASE kind WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 0 END AS mate, qname, seq, qual FROM (SELECT *, CASE flag & 192 WHEN 64 THEN 'first' WHEN 128 THEN 'second' ELSE 'unpaired' END AS kind FROM sequences)""")
def fastq_files(spark, d):
    """FastQ of both mates and of single reads, written and read again with what their names say."""
    out = None
    for stream in sinks.fastq_streams(records(spark, d, True)).values():
        path = _scratch(spark)
        stream.write.text(path)
        df = fastq.read_fastq(spark, path.removeprefix("file://") + "/part-*").select(F.when(S.bit(F.col("flag"), S.FIRST), 1).when(S.bit(F.col("flag"), S.SECOND), 2).otherwise(0).alias("mate"), "qname", "seq", "qual")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT library, folder, count(*) AS n, sum(ord) AS total FROM (SELECT ord, CASE WHEN rg = 'RG0' THEN 'libA' WHEN rg = 'RG1' THEN 'libB' ELSE 's2' END AS library, concat('of-', library, '.parquet') AS folder FROM reads) GROUP BY ALL")
def split_write(spark, d):
    """One folder per library, by a pattern."""
    labelled = dedup.label(records(spark, d), view(spark, d, "read_groups"))
    folders = sinks.split_by_library(labelled.drop("tags"), _scratch(spark), "of-%s.parquet")
    out = None
    for library, path in sorted(folders.items()):
        df = spark.read.parquet(path).groupBy("library").agg(F.count("*").alias("n"), F.sum("ord").alias("total")).select("library", F.lit(path.rsplit("/", 1)[1]).alias("folder"), "n", "total")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT CAST(5 * k + rname_id AS INT) AS rname_id, concat('f', f, '.', sq_name) AS sq_name, (SELECT count(*) FROM reads r WHERE r.rname_id = refs.rname_id AND flag % 3 = f) AS n FROM refs, (VALUES (0, 0), (2, 1), (1, 2)) AS o(f, k)")
def header_merge(spark, d):
    """Three files: the references of the last come after those of the first."""
    df, refs = records(spark, d), view(spark, d, "refs")
    inputs = [(df.where(F.col("flag") % 3 == f), refs.withColumn("sq_name", F.concat(F.lit(f"f{f}."), "sq_name"))) for f in range(3)]
    both, all_ = sampling.concat_refs(inputs)
    counts = both.groupBy(F.col("rname_id").alias("_r")).agg(F.count("*").alias("n"))
    return all_.join(counts, F.col("rname_id") == F.col("_r"), "left").select("rname_id", "sq_name", F.coalesce("n", F.lit(0)).alias("n"))


# ---- Tags, index reads, mates ----------------------------------------------------------------------------


@query("SELECT qname, ord, 3 AS tags FROM reads WHERE xm % 3 <> 2")
def strip_multimap(spark, d):
    """First alignments only, without the tags that number them."""
    hits = {"HI": S.tag_int(F.when(F.col("xm") % 3 == 2, 2).otherwise(1)), "NH": S.tag_int(F.col("xm") + 1), "IH": S.tag_int(F.lit(2))}
    df = records(spark, d).withColumn("tags", F.when(F.col("xm") % 3 > 0, S.put_tags(F.col("tags"), hits)).otherwise(F.col("tags")))
    return rewrite.strip_multimap(df, primary_only=True).select("qname", "ord", F.size("tags").alias("tags"))


def _mates(spark, d) -> DataFrame:
    return pairing.pair(records(spark, d, True), ["ord"]).where("kind <> 'widow'")


_COUPLES = """WITH a AS (SELECT s.*, count(*) OVER (PARTITION BY qname) AS c FROM sequences s WHERE flag & 1 <> 0), m AS (SELECT x.*, y.flag AS of, y.xm AS oxm, y.ord AS oord, y.seq AS oseq, y.qual AS oqual FROM a x JOIN a y ON x.qname = y.qname AND x.ord <> y.ord)"""


@query(f"""{_COUPLES}, s AS (SELECT qname, ord, flag, seq, qual, seq AS fseq, qual AS fqual FROM sequences WHERE flag & 1 = 0 UNION ALL SELECT qname, ord, flag, seq, qual, CASE WHEN flag & 64 <> 0 THEN seq ELSE oseq END, CASE WHEN flag & 64 <> 0 THEN qual ELSE oqual END FROM m)
SELECT qname, ord, CASE WHEN flag & 128 <> 0 THEN seq ELSE left(seq, 14) END AS seq, CASE WHEN flag & 128 <> 0 THEN qual ELSE left(qual, 14) END AS qual, right(fseq, 6) AS xi, right(fqual, 6) AS yi FROM s""")
def index_split(spark, d):
    """The last six bases of first mates and single reads are the index of both mates."""
    out = rewrite.explode_pairs(rewrite.split_index(_mates(spark, d), 6))
    return out.select("qname", "ord", "seq", "qual", S.tag_string(F.col("tags"), "XI").alias("xi"), S.tag_string(F.col("tags"), "YI").alias("yi"))


@query(f"""{_COUPLES} SELECT qname, ord, (flag & ~192) | 1 | CASE WHEN flag & 64 <> 0 THEN 64 ELSE 128 END | ((flag | of) & 512) AS flag,
CASE WHEN flag & 64 <> 0 THEN CASE WHEN xm > 3 THEN concat('i', ord) WHEN oxm > 3 THEN concat('i', oord) ELSE '' END ELSE CASE WHEN oxm > 3 THEN concat('i', oord) WHEN xm > 3 THEN concat('i', ord) ELSE '' END END AS xi FROM m""")
def force_mates(spark, d):
    """A failed mate fails both, and the first mate's index is preferred."""
    df = records(spark, d, True).where(S.bit(F.col("flag"), S.PAIRED))
    tags = F.when(F.col("xm") > 3, S.put_tags(F.col("tags"), {"YJ": S.tag_text(F.concat(F.lit("i"), "ord"))})).otherwise(F.col("tags"))
    pairs = pairing.pair(df.withColumn("tags", tags), ["ord"]).where("kind = 'pair'")
    return rewrite.explode_pairs(rewrite.force_mates(pairs)).select("qname", "ord", "flag", S.tag_string(F.col("tags"), "YJ").alias("xi"))


_NUMBER = "CAST(regexp_extract(qname, 'q([0-9]+)_', 1) AS BIGINT) * 100 + CAST(regexp_extract(qname, '_([0-9]+)$', 1) AS BIGINT)"


def _file(df: DataFrame) -> DataFrame:
    number = F.regexp_extract("qname", r"q(\d+)_", 1).cast("long") * 100 + F.regexp_extract("qname", r"_(\d+)$", 1).cast("long")
    return df.withColumns({"rec_no": number, "file_ordinal": F.lit(0)})


@query(f"{_COUPLES} SELECT qname, {_NUMBER} AS rec_no, seq AS first, oseq AS second FROM m WHERE flag & 64 <> 0")
def zip_mates(spark, d):
    """Two files in step."""
    pairs = pairing.pair(records(spark, d, True).select("qname", "ord", "flag", "seq"), ["ord"]).where("kind = 'pair'")
    both = fastq.zip_mates(_file(pairs.select("r1.*")), _file(pairs.select("r2.*")))
    return both.select("r1.qname", "r1.rec_no", F.col("r1.seq").alias("first"), F.col("r2.seq").alias("second"))


@query(f"{_COUPLES} SELECT qname, {_NUMBER} AS rec_no, seq, oseq AS xj, oqual AS yj FROM m WHERE flag & 64 <> 0")
def index_files(spark, d):
    """Reads with the index reads of a file in step with them."""
    pairs = pairing.pair(records(spark, d, True), ["ord"]).where("kind = 'pair'")
    out = fastq.with_index(_file(pairs.select("r1.*")), _file(pairs.select("r2.*")), 2)
    return out.select("qname", "rec_no", "seq", S.tag_string(F.col("tags"), "XJ").alias("xj"), S.tag_string(F.col("tags"), "YJ").alias("yj"))


def _tagged_pairs(spark, d) -> DataFrame:
    df = records(spark, d).withColumn("length", F.col("seq_len"))
    index = {"YI": S.tag_text(F.concat(F.lit("y"), F.col("xm").cast("string"))), "BC": S.tag_text(F.when(F.col("ord") % 2 == 1, "AC").otherwise("GT"))}
    return pairing.pair(df.withColumn("tags", S.put_tags(F.col("tags"), index)), ["ord"])


_INDEXES = "greatest(a.rg, b.rg) AS rg, greatest('y' || a.xm, 'y' || b.xm) AS yi, 'GT' AS bc"
_TWO = "FROM reads a JOIN reads b ON a.qname = b.qname AND a.ord <> b.ord AND a.flag & 1 <> 0"


@query(f"SELECT a.qname, a.ord, {_INDEXES}, a.xm {_TWO}")
def pair_repair_tags(spark, d):
    """Index tags that mates share are the greater ones of both."""
    t = lambda k: S.tag_string(F.col("tags"), k)
    out = pairing.records(pairing.repair(_tagged_pairs(spark, d)).where("kind = 'pair'"))
    return out.select("qname", "ord", t("RG").alias("rg"), t("YI").alias("yi"), t("BC").alias("bc"), S.tag_number(F.col("tags"), "XM").cast("int").alias("xm"))


@query(f"SELECT count(*) AS n_ixs FROM (SELECT a.ord, a.rg AS r, a.xm, {_INDEXES} {_TWO}) WHERE rg <> r OR yi <> 'y' || xm OR ord % 2 = 1")
def pair_index_count(spark, d):
    return pairing.statistics(pairing.repair(_tagged_pairs(spark, d))).select("n_ixs")


@query(_REPAIR + """, x AS (SELECT qname, CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate, f3.*, lpad(printf('%X', flag), 3, '0') || ' is ' AS old, ' (+' || lpad(printf('%X', cf & ~flag), 3, '0') || ',-' || lpad(printf('%X', flag & ~cf), 3, '0') || ')' AS diff FROM f3)
SELECT qname, mate, concat('MRNM ', coalesce(mrnm_id, -1), ' is wrong (', coalesce(br, -1), ')') AS line FROM x WHERE mrnm_id IS DISTINCT FROM br UNION ALL SELECT qname, mate, concat('MPOS ', mpos, ' is wrong (', bp, ')') FROM x WHERE mpos <> bp
UNION ALL SELECT qname, mate, concat('ISIZE 0 is wrong (', ci, ')') FROM x WHERE ci <> 0 UNION ALL SELECT qname, mate, concat('FLAG ', old, 'wrong', diff) FROM x WHERE major UNION ALL SELECT qname, mate, concat('FLAG ', old, 'technically wrong', diff) FROM x WHERE NOT major AND flag <> cf""".replace("qname, CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate, f3.*", "CASE WHEN flag & 64 <> 0 THEN 1 ELSE 2 END AS mate, f3.*"))
def pair_repair_lines(spark, d):
    """What was wrong in each record, and what is right."""
    return pairing.repair_lines(_pairs(spark, d))


@query(_COUNTS.replace("WITH ", "WITH RECURSIVE ", 1) + """, b(library, i, lo, hi) AS (
  SELECT library, 0, CAST(1e-12 AS DOUBLE), CAST(700 AS DOUBLE) FROM t WHERE single_mq20 > 0 AND single_mq20 < out_mq20
  UNION ALL SELECT b.library, i + 1, CASE WHEN m / (exp(m) - 1) > s THEN m ELSE lo END, CASE WHEN m / (exp(m) - 1) > s THEN hi ELSE m END
    FROM (SELECT b.*, (lo + hi) / 2 AS m, single_mq20 / out_mq20 AS s FROM b JOIN t USING (library) WHERE i < 200) b),
e AS (SELECT library, out_mq20 / (1 - exp(-lo)) * n_out / out_mq20 AS grand, 100 * out_mq20 / (out_mq20 / (1 - exp(-lo))) AS used FROM b JOIN t USING (library) WHERE i = 200)
SELECT concat_ws(chr(9), library, n_in, n_out, out_mq20, single_mq20, coalesce(printf('%.0f', grand - n_out), 'N/A'), coalesce(printf('%.0f', grand), 'N/A'), printf('%.1f', 100 * n_out / n_in), coalesce(printf('%.1f', used), 'N/A')) AS line FROM t LEFT JOIN e USING (library)""")
def report_lines(spark, d):
    return dedup.report_lines(dedup.complexity(dedup.library_counts(dedup.collapse_cheap(_keyed(spark, d), _ORDER, _COUNTED))))


@query("SELECT '#RegionName' || chr(9) || 'ID' AS value UNION ALL SELECT r.name || chr(9) || h FROM regions r JOIN (SELECT rn, string_agg(name, ':' ORDER BY sym) AS h FROM (SELECT DISTINCT r.name AS rn, a.name, sym FROM regions r JOIN (SELECT *, min(line_no) OVER (PARTITION BY name) AS sym FROM annotations) a ON a.chrom = r.chrom AND a_start < r_end AND a_end > r_start) GROUP BY rn) ON rn = r.name")
def table_file(spark, d):
    """The table as text, its header first."""
    from ..operators import intervals

    return intervals.table_file(intervals.annotate(view(spark, d, "regions"), view(spark, d, "annotations"), "inclusive", no_strand=True))


@query()
def merge_pairs(spark, d):
    """Overlapping mates merged: the second mate is made the first one's reverse complement, shifted by up to ten bases. Tested against brute force."""
    return merging.merge(overlapping_pairs(spark, d)).select("qname", "ord", "seq", "qual", "flag", S.tag_number(F.col("tags"), "FF").cast("int").alias("ff"))


def overlapping_pairs(spark, d) -> DataFrame:
    pairs = pairing.pair(records(spark, d, True), ["ord"]).where("kind <> 'widow'")
    back = F.translate(F.reverse(F.substring("r1.seq", 1, 20)), "ACGT", "TGCA")
    shift = (F.col("r1.xm") % 10).cast("int")
    mate = F.concat(F.translate(F.reverse(F.substring(F.col("r2.seq"), F.lit(1), shift)), "ACGT", "TGCA"), F.substring(back, F.lit(1), 20 - shift))
    return pairs.withColumn("r2", F.when(F.col("r2").isNotNull(), F.col("r2").withField("seq", mate)))
