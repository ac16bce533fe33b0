"""Mates, duplicates, melding, circular references, rewrites and sampling on small frames."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lociweave import schema as S
from lociweave.operators import circular, dedup, meld, merging, pairing, rewrite, sampling

FIRST, SECOND = S.PAIRED | S.FIRST, S.PAIRED | S.SECOND


def test_pairs_by_name_and_number(record):
    df = record([
        {"qname": "p", "flag": SECOND}, {"qname": "p", "flag": FIRST}, {"qname": "p", "flag": FIRST, "pos": 7}, {"qname": "p", "flag": SECOND, "pos": 8}, {"qname": "w", "flag": FIRST},
        {"qname": "s", "flag": 0}, {"qname": "s", "flag": 0}, {"qname": "i", "flag": FIRST, "tags": {"XI": 1}}, {"qname": "i", "flag": SECOND, "tags": {"XI": 2}},
    ])
    got = sorted((r.kind, r.r1.qname, r.r1.pos, r.r2 and r.r2.pos) for r in pairing.pair(df).collect())
    assert got == [("pair", "p", 0, 0), ("pair", "p", 7, 8), ("single", "s", 0, None), ("single", "s", 0, None), ("widow", "i", 0, None), ("widow", "i", 0, None), ("widow", "w", 0, None)]


def test_wrong_roles(record):
    df = record([{"qname": "x", "flag": S.PAIRED}])
    with pytest.raises(Exception, match="no first or second mate: x"):
        pairing.pair(df).collect()
    assert [r.kind for r in pairing.pair(df, wrong_roles="quarantine").collect()] == ["wrong"]


def test_repair(record):
    df = record([
        {"qname": "p", "flag": FIRST | S.PROPER | S.FAILED, "pos": 100, "cigar": "10M", "mrnm_id": 3, "mpos": 1, "tags": {"XI": "AC", "BC": "x"}},
        {"qname": "p", "flag": SECOND | S.REVERSED, "pos": 200, "cigar": "5M2D5M", "mrnm_id": 0, "mpos": 100, "tags": {"XI": "AA"}},
    ])
    fixed = pairing.repair(pairing.pair(df))
    a, b = (fixed.first()[k] for k in ("r1", "r2"))
    assert (a.mrnm_id, a.mpos, a.isize, b.isize) == (0, 200, 112, -112)
    assert a.flag == FIRST | S.PROPER | S.FAILED | S.MATE_REVERSED
    assert b.flag == SECOND | S.REVERSED | S.FAILED
    assert {k: v.s for k, v in b.tags.items()} == {"XI": "AC", "XJ": "", "YI": "", "YJ": "", "RG": "", "BC": "x"}
    s = pairing.statistics(fixed).first()
    assert (s.n_in, s.n_mrnm, s.n_mpos, s.n_isize, s.n_flags, s.n_fflag) == (2, 1, 1, 2, 1, 1)
    again = pairing.statistics(pairing.repair(fixed.select("kind", "r1", "r2"))).first()
    assert (again.n_mrnm, again.n_mpos, again.n_isize, again.n_flags, again.n_fflag, again.n_ixs) == (0,) * 6
    legacy = pairing.repair(pairing.pair(df), legacy_fflag=True)
    assert legacy.first().r2.flag == SECOND | S.REVERSED
    assert pairing.statistics(legacy).first().n_fflag == 1


def test_widows(record):
    df = record([{"qname": "m", "flag": FIRST | S.MATE_REVERSED, "mpos": 4}, {"qname": "u", "flag": SECOND | S.UNMAPPED}])
    p = pairing.pair(df)
    left = lambda kill: sorted((r.r1.qname, r.r1.flag, r.r1.mpos) for r in pairing.settle_widows(p, kill).collect())
    assert left("none") == [("m", 0, -1), ("u", S.UNMAPPED, -1)]
    assert left("unmapped") == [("m", 0, -1)]
    assert left("all") == []


def test_single_keeps_mate_reversed(record):
    df = record([{"flag": FIRST | S.MATE_REVERSED}, {"flag": SECOND}, {"flag": S.UNMAPPED}])
    assert [r.flag for r in rewrite.make_single(df).collect()] == [S.MATE_REVERSED]
    assert [r.flag for r in rewrite.divorce(df.limit(1)).collect()] == [0]


def test_multimap(record):
    df = record([{"qname": "a", "tags": {"HI": 1, "NH": 3}}, {"qname": "b", "tags": {"HI": 2, "NH": 3}}, {"qname": "c", "tags": {}}])
    assert sorted((r.qname, len(r.tags)) for r in rewrite.strip_multimap(df, True).collect()) == [("a", 0), ("c", 0)]
    with pytest.raises(Exception, match="multiple alignments"):
        rewrite.strip_multimap(df).collect()
    assert rewrite.strip_multimap(df.where("qname = 'c'")).count() == 1


def cluster(record, rows):
    return dedup.with_key(dedup.label(record(rows), None, True))


def test_collapse(record):
    df = cluster(record, [
        {"qname": "a", "seq": "ACGT", "qual": "IIII", "cigar": "4M"}, {"qname": "b", "seq": "ACGA", "qual": "IIII", "cigar": "4M"}, {"qname": "c", "seq": "ACGA", "qual": "5555", "cigar": "4M"},
        {"qname": "d", "seq": "ACGTT", "qual": "JJJJJ", "cigar": "4M1I"}, {"qname": "e", "pos": 9, "seq": "A", "qual": "~", "cigar": "1M"},
    ])
    cheap = {r.qname: r.xp for r in dedup.collapse_cheap(df, ["qname"]).collect()}
    assert cheap == {"d": 4, "e": 1}
    deep = {r.pos: r for r in dedup.collapse_consensus(df, ["qname"]).collect()}
    assert (deep[0].seq, deep[0].cigar, deep[0].xp) == ("ACGA", "4M", 4)
    assert deep[0].qual == dedup.consensus_of(["ACGT", "ACGA", "ACGA"], ["IIII", "IIII", "5555"], 60)[1]
    assert deep[9].qual == chr(60 + 33)
    assert sorted(r.qname for r in dedup.mark(df, ["qname"]).where(F.col("flag").bitwiseAND(S.DUPLICATE) == 0).collect()) == ["d", "e"]


def test_counts_and_complexity(spark):
    df = spark.createDataFrame([("l", 0, 30, 3), ("l", 0, 30, 1), ("l", S.PAIRED, 10, 1), ("l", S.PAIRED, 30, -1), ("", 0, 30, 1)], "library string, flag int, mapq int, xp bigint")
    c = {r.library: tuple(r)[1:] for r in dedup.library_counts(df).collect()}
    assert c == {"l": ((2 * 3 + 2 + 1 - 1) // 2, 3, 2, 1), "": (1, 1, 1, 1)}
    lines = sorted(r.line for r in dedup.report_lines(dedup.complexity(dedup.library_counts(df))).collect())
    assert lines[0].startswith("--\t1\t1\t1\t1\tN/A\tN/A\t100.0\tN/A")


@pytest.mark.parametrize("molecules", [100.0, 1e6])
def test_estimate_finds_its_own_model(molecules):
    import numpy as np

    for x in (0.01, 0.5, 3.0):
        total = molecules * -np.expm1(-x)
        assert dedup.estimate(total, molecules * x * np.exp(-x)) == pytest.approx(molecules, rel=1e-6)
    assert dedup.estimate(5, 0) is None and dedup.estimate(5, 5) is None


def test_shadowed(record):
    pair = {"rname_id": 0, "mrnm_id": 0}
    df = cluster(record, [{"qname": "p", "flag": FIRST, "pos": 5, "mpos": 50, **pair}, {"qname": "p", "flag": SECOND, "pos": 50, "mpos": 5, **pair}, {"qname": "s", "pos": 5}, {"qname": "t", "pos": 6}])
    assert sorted(r.qname for r in dedup.drop_shadowed(df).collect()) == ["p", "p", "t"]


def test_meld(record, spark):
    refs = spark.createDataFrame([(0, "c0", 9), (1, "c1", 9)], S.REFS)
    rows = [
        {"qname": "t", "file_ordinal": n, "mapq": 37, "pos": n, "cigar": "4M", "tags": {"XM": 1, "NM": n, "XA": f"old{n};"}} for n in (1, 2, 3)
    ] + [{"qname": "u", "file_ordinal": n, "flag": S.UNMAPPED, "mapq": n} for n in (1, 2, 3)] + [{"qname": "o", "file_ordinal": 1, "mapq": 5, "tags": {"XM": 9}}]
    df = meld.by_name(record(rows), ["rec_no"])
    got = {r.qname: r for r in meld.meld(df, 3, S.bit(F.col("flag"), S.UNMAPPED), meld.score(), refs=refs).collect()}
    assert (got["t"].file_ordinal, got["t"].mapq) == (2, 0)
    assert got["t"].tags["XA"].s == "c0,+3,4M,3;c0,+1,4M,1;old2;old3;old1"
    assert (got["u"].file_ordinal, got["u"].mapq, got["u"].tags) == (2, 2, {})
    assert (got["o"].mapq, got["o"].tags["XA"].s) == (5, "")


def test_meld_in_step(record):
    good = record([{"qname": "a", "file_ordinal": f, "rec_no": 0} for f in (1, 2)])
    assert meld.in_step(good).count() == 2
    bad = record([{"qname": "a", "file_ordinal": 1, "rec_no": 0}, {"qname": "b", "file_ordinal": 2, "rec_no": 0}])
    with pytest.raises(Exception, match="names differ"):
        meld.in_step(bad).collect()


REFS = [(0, "chr1", 100), (1, "chrM", 120), (2, "chrMT", 50)]


def test_circular_names():
    assert circular.resolve(REFS, ["chrMT:50", "chr1:7"]) == {2: 50, 0: 7}
    for bad in ("chr:9", "chrM:100", "chrX:9", "chrM:121", "chrM", "chrM:0"):
        with pytest.raises(ValueError):
            circular.resolve(REFS, [bad])


def test_normalize(record, spark):
    refs = spark.createDataFrame(REFS, S.REFS)
    df = record([
        {"qname": "a", "rname_id": 1, "pos": 5, "mpos": -1, "mrnm_id": 1, "mapq": 0, "tags": {"XA": "chrM,+106,4M,0;"}}, {"qname": "b", "rname_id": 1, "pos": 50, "tags": {"XA": "chrM,-51,4M,0;"}, "mapq": 0},
        {"qname": "c", "rname_id": 0, "pos": 5}, {"qname": "d", "rname_id": 1, "pos": 110, "mapq": 3, "tags": {"XA": "chrM,+11,4M,0;chr1,+4,4M,0"}},
    ])
    once = circular.normalize(df, refs, {1: 100})
    got = {r.qname: (r.pos, r.mpos, r.mapq, "XA" in r.tags) for r in once.collect()}
    assert got == {"a": (105, -1, 37, False), "b": (50, -1, 0, True), "c": (5, -1, 30, False), "d": (110, -1, 3, True)}
    assert {r.qname: r.pos for r in circular.normalize(once, refs, {1: 100}).collect()} == {k: v[0] for k, v in got.items()}


def test_wrap(record):
    df = record([{"qname": "w", "rname_id": 1, "pos": 95, "cigar": "2S4M1D3M1S", "seq": "A" * 10}, {"qname": "x", "rname_id": 1, "pos": 190, "cigar": "5M"}, {"qname": "y", "rname_id": 0, "pos": 95, "cigar": "9M"}])
    got = sorted((r.qname, r.pos, r.cigar, r.flag) for r in circular.wrap(df, {1: 100}).collect())
    assert got == [("w", 0, "6S3M1S", S.SECONDARY), ("w", 95, "2S4M1D4S", 0), ("x", 90, "5M", 0), ("y", 95, "9M", 0)]


def test_trimming(record):
    df = record([
        {"qname": "f", "flag": S.UNMAPPED, "seq": "ACGTA", "qual": "I#I##"}, {"qname": "r", "flag": S.UNMAPPED | S.REVERSED, "seq": "ACGTA", "qual": "##I#I"},
        {"qname": "m", "flag": S.UNMAPPED, "seq": "ACGTA", "qual": "#####", "tags": {"FF": 2}}, {"qname": "a", "seq": "ACGTA", "qual": "#####"}, {"qname": "n", "flag": S.UNMAPPED, "seq": "ACGTA"},
    ])
    assert {r.qname: (r.seq, r.qual) for r in rewrite.trim_quality(df).collect()} == {"f": ("ACG", "I#I"), "r": ("GTA", "I#I"), "m": ("ACGTA", "#####"), "a": ("ACGTA", "#####"), "n": ("ACGTA", None)}
    got = {r.qname: r.seq for r in rewrite.trim_average(df, 10).collect()}
    assert got == {"f": "ACG", "r": "GTA", "n": "ACGTA"}


def test_index_reads_and_mates(record):
    df = record([{"qname": "p", "flag": S.FAILED, "seq": "ACGTA", "qual": "IIIHH", "tags": {}}])
    p = df.select(F.struct(*df.columns).alias("r1")).withColumn("r2", F.col("r1"))
    cut = rewrite.split_index(p, 2).first()
    assert (cut.r1.seq, cut.r1.qual, cut.r2.seq) == ("ACG", "III", "ACGTA")
    assert {k: v.s for k, v in cut.r2.tags.items()} == {"XI": "TA", "YI": "HH"}
    m = rewrite.force_mates(rewrite.split_index(p, 2)).first()
    assert m.r1.flag == FIRST | S.FAILED and m.r2.flag == SECOND | S.FAILED
    assert rewrite.fastq_lines(df).first().fastq == "@p\nACGTA\n+\nIIIHH"


def test_merging(record):
    whole = "ACGTTGCATCAGGATCCATTAGCATCGGAT"
    a, b = whole[:22], merging.reverse_complement(whole[8:])
    n, ym, yn, seq, qual = merging.merge_pair(a, "I" * 22, b, "I" * 22)
    assert (n, seq) == (30, whole) and ym > 20
    short = whole[:12]
    r1, r2 = (short + merging.ADAPTERS[0])[:20], (merging.reverse_complement(short) + merging.ADAPTERS[1])[:20]
    assert merging.merge_pair(r1, "I" * 20, r2, "I" * 20)[0::3] == (12, short)
    df = record([{"qname": "p", "flag": FIRST, "seq": r1, "qual": "I" * 20}])
    other = record([{"qname": "p", "flag": SECOND, "seq": r2, "qual": "I" * 20}])
    p = df.select("qname", F.struct(*df.columns).alias("r1")).join(other.select("qname", F.struct(*other.columns).alias("r2")), "qname").drop("qname")
    got = merging.merge(p, high=40).collect()
    assert [(r.seq, r.flag, r.tags["FF"].i) for r in got] == [(short, 0, 3)]
    got = sorted((r.flag, r.tags["FF"].i) for r in merging.merge(p, high=10**6).collect())
    assert got == [(0, 3), (FIRST, 4), (SECOND, 4)]
    assert sorted(r.flag for r in merging.merge(p, low=10**6).collect()) == [FIRST, SECOND]


def test_sampling(record):
    df = record([{"qname": f"q{n // 2}"} for n in range(20)])
    for m in (0, 3, 10):
        out = sampling.sample_groups(df, "qname", m)
        assert out.count() == 2 * m and out.select("qname").distinct().count() == m
    with pytest.raises(Exception, match="fewer than 11 groups"):
        sampling.sample_groups(df, "qname", 11).collect()


def test_ranges_and_sorting(record):
    df = record([{"qname": str(n), "rname_id": r, "pos": p} for n, (r, p) in enumerate([(None, 0), (1, 5), (0, 9), (1, 2)])])
    assert [r.qname for r in sampling.sort_records(df).collect()] == ["2", "3", "1", "0"]
    assert sorted(r.qname for r in sampling.range_scan(df, "2").collect()) == ["1", "3"]
    assert [r.qname for r in sampling.range_scan(df, "U").collect()] == ["0"]
    assert sampling.range_scan(df, "A").count() == 4 and sampling.range_scan(df, "7-9").count() == 0
    with pytest.raises(ValueError):
        sampling.parse_range("x")


def test_sort_check(record):
    assert sampling.ensure_sorted(record([{"qname": "a"}, {"qname": "b"}, {"qname": "b"}]), "qname").count() == 3
    with pytest.raises(Exception, match="not sorted: a"):
        sampling.ensure_sorted(record([{"qname": "b"}, {"qname": "a"}]), "qname").collect()


def test_many_merges():
    """All at once as one by one, for reads of several lengths, lower-case and empty ones too."""
    r = random.Random(4)
    rows = []
    for _ in range(400):
        insert = "".join(r.choice("ACGT") for _ in range(r.randint(5, 60)))
        n1, n2 = r.choice([20, 33]), r.choice([20, 31])
        reads = [(insert + merging.ADAPTERS[0])[:n1], (merging.reverse_complement(insert) + merging.ADAPTERS[1])[:n2]]
        reads = ["".join(r.choice("ACGTN") if r.random() < 0.05 else c for c in x) for x in reads]
        rows.append(sum(([x.lower() if r.random() < 0.1 else x, "".join(chr(33 + r.randint(0, 40)) for _ in x)] for x in reads), []))
    rows += [["", "", "ACG", "III"], ["A", "I", "T", "I"]]
    assert merging.merge_many(*map(list, zip(*rows))) == [merging.merge_pair(*x) for x in rows]


def test_merged_pairs_of_the_tables(spark):
    from lociweave.plans.source_queries import merge_pairs, overlapping_pairs

    d = "/root/testdata/sf0.001"
    want = []
    for p in overlapping_pairs(spark, d).collect():
        if p.r2 is None:
            n, ym = merging.trim_adapter(p.r1.seq, p.r1.qual)
            want.append((p.r1.qname, p.r1.seq[:n] if ym > 200 else None, ym))
        else:
            n, ym, yn, seq, _ = merging.merge_pair(p.r1.seq, p.r1.qual, p.r2.seq, p.r2.qual)
            want.append((p.r1.qname, seq if min(ym, yn) > 200 else None, min(ym, yn)))
    got = collections.defaultdict(list)
    for x in merge_pairs(spark, d).collect():
        got[x.qname].append(x)
    assert {n for n, _, _ in want} == set(got)
    for name, seq, sure in want:
        if seq is not None and sure > 200:
            assert [x.seq for x in got[name]] == [seq]
        elif sure < 20:
            assert all(x.ff in (0, None) for x in got[name])


def test_header_merge(record, spark):
    refs = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], S.REFS)
    df = record([{"rname_id": 1, "mrnm_id": None}])
    records, all_ = sampling.concat_refs([(df, refs), (df, refs)])
    assert sorted((r.file_ordinal, r.rname_id, r.mrnm_id) for r in records.collect()) == [(0, 1, None), (1, 3, None)]
    third = [(r.file_ordinal, r.rname_id) for r in sampling.concat_refs([(df, refs)] * 3)[0].collect()]
    assert sorted(third) == [(0, 1), (1, 5), (2, 3)]
    assert [r.rname_id for r in all_.orderBy("rname_id").collect()] == [0, 1, 2, 3]
