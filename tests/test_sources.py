import gzip

import pytest
from pyspark.sql import functions as F

from lociweave import schema as S
from lociweave.sources import bam, fastq, sinks, text


def write(path, data):
    path.write_text(data)
    return str(path)


def test_bed(spark, tmp_path):
    p = write(tmp_path / "a.bed", "track name=x\ntrack\tx\n# c\n\nchr1\t1\t5\tn\t0\t-\nchr2\t3\t9\tm\n")
    got = [(r["name"], r.chrom, r.strand, r.start, r.end) for r in text.read_bed(spark, p).orderBy("start").collect()]
    assert got == [("n", "chr1", "-", 1, 5), ("m", "chr2", "*", 3, 9)]
    with pytest.raises(Exception, match="too few fields"):
        text.read_bed(spark, write(tmp_path / "b.bed", "chr1\t1\t5\n")).collect()


def test_5col_fasta_chromosomes(spark, tmp_path):
    p = write(tmp_path / "a.txt", "n c 1 5 +\nm c  3 9\n")
    assert sorted((r["name"], r.strand, r.start) for r in text.read_5col(spark, p).collect()) == [("m", "*", 3), ("n", "+", 1)]
    p = write(tmp_path / "a.fa", ">c:+:1:5:x;d:-:2:6\nACGT\n>e:0:3:7\n")
    assert sorted((r["name"], r.chrom, r.strand, r.start, r.end) for r in text.read_fasta_regions(spark, p).collect()) == [("c:+:1:5:x", "c", "+", 1, 5), ("d:-:2:6", "d", "-", 2, 6), ("e:0:3:7", "e", "*", 3, 7)]
    p = write(tmp_path / "t", "# h\n1 chr1 0\n1 chrI 5\n")
    assert [tuple(r) for r in text.read_chromosomes(spark, p).collect()] == [("1", "chrI", 5)]


SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100\n@SQ\tSN:chr2\tLN:50\n@RG\tID:g\tLB:l\tSM:s\nr1\t99\tchr1\t11\t30\t4M\t=\t21\t14\tACGT\tIIII\tRG:Z:g\tNM:i:1\tXF:f:1.5\tXB:B:c,1,2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n"


def test_sam_and_bam_round_trip(spark, tmp_path):
    p = write(tmp_path / "a.sam", SAM)
    records, refs, groups = text.read_sam(spark, p)
    r1, r2 = records.orderBy("qname").collect()
    assert (r1.flag, r1.rname_id, r1.pos, r1.mrnm_id, r1.mpos, r1.cigar, r1.tags["NM"].i, r1.tags["XF"].f, r1.tags["RG"].s, r1.tags["XB"].t) == (99, 0, 10, 0, 20, "4M", 1, 1.5, "g", "B")
    assert (r2.rname_id, r2.pos, r2.cigar, r2.qual) == (None, -1, None, None)
    assert [tuple(g) for g in groups.collect()] == [("g", "l", "s")]
    regions = [(r["name"], r.chrom, r.strand, r.start, r.end) for r in text.records_as_regions(records, refs).collect()]
    assert regions == [("r1", "chr1", "+", 10, 14)]
    out = str(tmp_path / "bam")
    files = bam.write_bam(records.coalesce(1), refs, out, "\n".join(SAM.split("\n")[:4]) + "\n")
    assert text.sniff(files[0]) == "bam"
    back, refs2, groups2 = bam.read_bam(spark, out)
    clean = lambda df: sorted((r.qname, r.flag, r.rname_id, r.pos, r.mapq, r.cigar, r.mrnm_id, r.mpos, r.isize, r.seq, r.qual, sorted((k, tuple(v)) for k, v in r.tags.items() if k != "XB")) for r in df.collect())
    assert clean(back) == clean(records)
    assert [tuple(r) for r in refs2.collect()] == [tuple(r) for r in refs.orderBy("rname_id").collect()]
    assert [tuple(g) for g in groups2.collect()] == [("g", "l", "s")]
    lines = [r.value for r in sinks.sam_lines(records, refs).collect()]
    assert "r1\t99\tchr1\t11\t30\t4M\t=\t21\t14\tACGT\tIIII\tNM:i:1\tRG:Z:g\tXF:f:1.5" in lines
    sinks.write_sam(records, refs, str(tmp_path / "out"), groups)
    assert text.read_sam(spark, str(tmp_path / "out"))[0].count() == 2


def test_sniffing(spark, tmp_path):
    assert text.sniff(write(tmp_path / "e", " \n")) == "empty"
    assert text.sniff(write(tmp_path / "f", "\n>x\n")) == "fasta"
    assert text.sniff(write(tmp_path / "s", SAM)) == "sam"
    assert text.sniff(write(tmp_path / "t", SAM[SAM.index("\nr1") + 1 :])) == "sam"
    assert text.sniff(write(tmp_path / "b", "c\t1\t2\tn\n")) == "bed"
    (tmp_path / "z").write_bytes(gzip.compress(b">x\n"))
    assert text.sniff(str(tmp_path / "z")) == "fasta"
    with pytest.raises(text.FormatError):
        text.sniff(write(tmp_path / "x", "a\0\1\n"))
    assert text.sniff(write(tmp_path / "y", "c\t1\t2\tn\n\0\1")) == "bed"  # the first line decides
    assert text.read_regions(spark, str(tmp_path / "b")).count() == 1


def test_fastq_names(spark, tmp_path):
    names = ["x/1", "F_x", "R_y", "M_x", "C_T_x", "x#ACGT,TTTT", "T_C_z/2", "d 1:Y:0:ACGT", "n#AC/1"]
    p = write(tmp_path / "a.fq", "".join(f"@{n}\nACGT\n+\nII@I\n" for n in names) + ">fa\nAC\nGT\n")
    df = fastq.read_fastq(spark, p)
    got = [(r.qname, r.flag & (S.FIRST | S.SECOND | S.FAILED), {k: v.s or v.i for k, v in r.tags.items()}, r.seq, r.qual) for r in df.orderBy("rec_no").collect()]
    q = ("ACGT", "II@I")
    assert got == [
        ("x", S.FIRST, {}, *q), ("x", S.FIRST, {}, *q), ("y", S.SECOND, {}, *q), ("x", 0, {"FF": 2}, *q), ("x", 0, {"FF": 1, "XP": -1}, *q), ("x", 0, {"XI": "ACGT", "XJ": "TTTT"}, *q),
        ("z", S.SECOND, {"FF": 1, "XP": -1}, *q), ("d", S.FIRST | S.FAILED, {"XI": "ACGT"}, *q), ("n", S.FIRST, {"XI": "AC"}, *q), ("fa", 0, {}, "ACGT", None),
    ]


def test_fastq_in_step(spark, tmp_path):
    a = fastq.read_fastq(spark, write(tmp_path / "1.fq", "@a/1\nAC\n+\nII\n@b/1\nAC\n+\nII\n"))
    b = fastq.read_fastq(spark, write(tmp_path / "2.fq", "@a/2\nGG\n+\nII\n@b/2\nGG\n+\nII\n"))
    assert sorted((r.r1.qname, r.r2.seq) for r in fastq.zip_mates(a, b).collect()) == [("a", "GG"), ("b", "GG")]
    i = fastq.read_fastq(spark, write(tmp_path / "i.fq", "@a\nTT\n+\nHH\n@b\nTT\n+\nHH\n"))
    assert {r.tags["XI"].s + r.tags["YI"].s for r in fastq.with_index(a, i).collect()} == {"TTHH"}
    wrong = fastq.read_fastq(spark, write(tmp_path / "w.fq", "@b\nTT\n+\nHH\n@a\nTT\n+\nHH\n"))
    with pytest.raises(Exception, match="names of mates differ"):
        fastq.zip_mates(a, wrong).collect()
    with pytest.raises(Exception, match="names of read and index differ"):
        fastq.with_index(a, wrong).collect()
    both = fastq.read_fastq(spark, write(tmp_path / "m.fq", "@a/1\nAC\n+\nII\n@a/2\nGG\n+\nII\n@c\nT\n+\nI\n"))
    assert sorted((r.r1.seq, r.r2 and r.r2.seq) for r in fastq.as_single_pairs(both).collect()) == [("AC", "GG"), ("T", None)]


def test_patterns_and_streams(spark, record, tmp_path):
    assert sinks.file_pattern("%p/%n-x%e %f %s %%", "a/b.bed") == "a/b-x.bed a/b a/b.bed %"
    assert sinks.library_pattern("%s.%%", "L") == "L.%"
    df = record([{"qname": "a", "flag": S.PAIRED | S.FIRST, "seq": "A", "qual": "I"}, {"qname": "b", "seq": "C", "qual": "I"}])
    out = {k: [r.value for r in v.collect()] for k, v in sinks.fastq_streams(df).items()}
    assert out == {"first": ["@a/1\nA\n+\nI"], "second": [], "unpaired": ["@b\nC\n+\nI"]}
    sinks.split_by_library(df.withColumn("library", F.col("qname")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l" / "a")).count() == 1


def test_histogram_lines(spark):
    h = spark.createDataFrame([(2, 5), (0, 0), (1, 7)], "n int, clusters bigint")
    assert [r.value for r in sinks.histogram_lines(h).collect()] == ["0\t0", "1\t7", "2\t5"]
