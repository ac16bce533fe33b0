"""Steps that must not grow faster than their input: each against the plain way, and what its plan carries."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociweave import fixtures
from lociweave.catalog import QUERIES
from lociweave.operators import dedup, sampling
from lociweave.plans import queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_need_one_window(spark):
    """Mates found within the order: the same rows as by the view's SQL, without a second shuffle."""
    got = fixtures.view(spark, DATA, "reads")
    want = spark.sql(fixtures.VIEWS["reads"].replace("FROM lineitem", f"FROM parquet.`{DATA}/lineitem.parquet`"))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert plan(got).count("Window [") == 1


def test_collapse_carries_what_is_kept(spark):
    """Tags, sequences and the like aren't carried through the aggregate where they aren't wanted."""
    for name in ("dedup_cheap", "dedup_clusters", "dedup_library_counts", "dedup_ignore_rg"):
        aggregates = [x for x in plan(QUERIES[name](spark, DATA)).split("\n") if "Aggregate [" in x]
        assert aggregates and not any("tags#" in x or "seq_len#" in x for x in aggregates)


def reads_of(record, r, n):
    rows = []
    for i in range(n):
        k = r.randrange(1, 6)
        rows.append({"qname": f"r{i}", "pos": r.randrange(12), "mapq": r.randrange(40), "cigar": r.choice(["4M", "4M", f"{k}M"]), "seq": "".join(r.choice("ACGTNacg") for _ in range(k)), "qual": "".join(r.choice("!\"+5I]^~") for _ in range(k))})
    return dedup.with_key(dedup.label(record(rows), None, True))


def test_consensus_by_lists_and_by_votes(spark, record, monkeypatch):
    """Whatever counts as deep, the consensus is that of brute force; only the deep clusters' bases become rows."""
    df = reads_of(record, random.Random(5), 90)
    members = {}
    for m in df.collect():
        members.setdefault(m.pos, []).append(m)
    want = []
    for pos, ms in members.items():
        main = min({m.cigar for m in ms}, key=lambda c: (-sum(m.cigar == c for m in ms), c))
        mine = [m for m in ms if m.cigar == main]
        n = max(len(m.seq) for m in mine)
        seq, qual = dedup.consensus_of([m.seq.ljust(n, "N") for m in mine], [m.qual.ljust(n, "!") for m in mine], 60)
        best = min(mine, key=lambda m: (-sum(map(ord, m.qual)) + 33 * len(m.qual), -m.mapq, m.qname))
        want.append((pos, main, seq, qual, len(ms), best.qname))
    for deep in (0, 7, 1000):
        monkeypatch.setattr(dedup, "DEEP", deep)
        out = dedup.collapse_consensus(df, ["qname"])
        assert sorted((x.pos, x.cigar, x.seq, x.qual, x.xp, x.qname) for x in out.collect()) == sorted(want)
    assert "posexplode" not in plan(out)


def test_runs_over_stretches(spark, monkeypatch):
    """Runs go on across stretches; nulls are runs of their own."""
    monkeypatch.setattr(sampling, "STRETCH", 20)
    r = random.Random(3)
    rows = [(r.choice([0, 0, 1, None]), r.choice([None, *range(15)]), i, r.choice(["a", "a", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, pos int, n int, k string")
    w = Window.partitionBy("g").orderBy("pos", "n")
    before = F.lag("k").over(w)
    want = df.withColumn("_new", F.when(before.isNull() | ~before.eqNullSafe(F.col("k")), 1).otherwise(0)).withColumn("run", F.sum("_new").over(w)).drop("_new")
    got = sampling.run_ids(df, "k", ["pos", "n"], ["g"])
    assert "bucketizer" in plan(got).lower()  # it is cut
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["sort_coordinate", "merge_coordinate"])
def test_places_without_a_window_per_reference(spark, name):
    df = QUERIES[name](spark, DATA)
    windows = [x for x in plan(df).split("\n") if "Window [row_number" in x]
    assert not windows and df.count() == 6000


def test_places_of_references_over_partitions(spark):
    df = spark.range(0, 100, 1, 7).select(F.col("id"), F.when(F.col("id") < 90, (F.col("id") / 40).cast("int")).alias("rname_id"))
    want = {i: i % 40 + 1 if i < 90 else i - 89 for i in range(100)}
    assert {r.id: r.place for r in queries._places(df).collect()} == want
