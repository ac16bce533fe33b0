import random

import pytest
from pyspark.sql import functions as F

from lociweave.operators import intervals

REGION = "name string, chrom string, strand string, r_start int, r_end int"
ANNOTATION = "name string, chrom string, strand string, a_start int, a_end int, line_no int"


def brute(regions, annotations, mode):
    order = {}
    for a in annotations:
        order.setdefault(a[0], len(order))
    anno = [(c, s, min(x, y), max(x, y), n) for n, c, st, x, y, _ in annotations if x != y for s in ("+-" if st == "*" else st)]
    out = {}
    for n, c, st, b, t in regions:
        hits, cand = set(), []
        for s in "+-" if st == "*" else st:
            mine = [a for a in anno if a[:2] == (c, s)]
            over = {a[4] for a in mine if a[2] < t and a[3] > b} if b < t else set()
            full = {x for x in over if all(any(a[4] == x and a[2] <= p < a[3] for a in mine) for p in range(b, t))}
            hits |= {"inclusive": over, "nearest": over, "covered": full, "partial": over - full}[mode]
            points = sorted({p for a in mine for p in a[2:4]})
            left = [a for a in mine if a[3] <= b]
            right = [a for a in mine if a[2] >= t]
            if left:
                e = max(a[3] for a in left)
                cand += [(abs(e - b), e - b, order[a[4]], a[4]) for a in left if a[3] == e]
            if right:
                k = min(a[2] for a in right)
                d = min(p for p in points if p > k) - t + 1
                cand += [(abs(d), d, order[a[4]], a[4]) for a in right if a[2] == k]
        near = min(cand) if mode == "nearest" and not hits and cand else None
        out[n] = (sorted(hits, key=order.get), near and near[3], near and near[1])
    return out


@pytest.mark.parametrize("mode", intervals.MODES)
def test_against_brute_force(spark, mode):
    r = random.Random(mode)
    annotations = []
    for k in range(40):
        s = r.randrange(150)
        annotations.append((f"n{r.randrange(12)}", r.choice("xy"), r.choice("+-*"), s, s + r.choice([0, 1, 3, 9, 30]), k))
    regions = []
    for k in range(150):
        s = r.randrange(200)
        regions.append((f"q{k}", r.choice("xyz"), r.choice("+-*"), s, s + r.choice([0, 1, 4, 20, 60])))
    got = intervals.annotate(spark.createDataFrame(regions, REGION), spark.createDataFrame(annotations, ANNOTATION), mode)
    assert {x["name"]: (x.hits, x.near, x.distance) for x in got.collect()} == brute(regions, annotations, mode)


def one(spark, annotations, region, mode, **options):
    a = spark.createDataFrame([(n, "c", "+", s, e, k) for k, (n, s, e) in enumerate(annotations)], ANNOTATION)
    q = spark.createDataFrame([("q", "c", "+", *region)], REGION)
    r = intervals.annotate(q, a, mode, **options).collect()
    assert len(r) == 1
    return r[0].hits, r[0].near, r[0].distance


def test_quirks(spark):
    assert one(spark, [("a", 0, 10)], (5, 100), "covered") == ([], None, None)
    assert one(spark, [("a", 0, 10)], (5, 100), "covered", legacy_tail=True) == (["a"], None, None)
    assert one(spark, [("a", 0, 10), ("a", 10, 20)], (5, 15), "covered") == (["a"], None, None)
    assert one(spark, [("a", 30, 40)], (10, 20), "nearest") == ([], "a", 21)
    assert one(spark, [("a", 30, 40)], (10, 20), "nearest", true_distance=True) == ([], "a", 10)
    both = [("l", 0, 10), ("r", 121, 122)]
    assert one(spark, both, (110, 120), "nearest") == ([], "r", 3)
    assert one(spark, both, (110, 120), "nearest", legacy_signed=True) == ([], "l", -100)
    assert one(spark, [("a", 0, 10)], (5, 5), "inclusive") == ([], None, None)
    assert one(spark, [], (5, 9), "nearest") == ([], None, None)


def test_repeated_regions_and_sets(spark):
    a = spark.createDataFrame([("n", "c", "+", 0, 5, 0)], ANNOTATION)
    b = spark.createDataFrame([("m", "c", "+", 20, 25, 0)], ANNOTATION)
    q = spark.createDataFrame([("q", "c", "+", 1, 2)] * 2 + [("p", "c", "+", 10, 12)], REGION)
    x, y = (intervals.annotate(q, s, "nearest") for s in (a, b))
    assert x.count() == 3
    got = {r["name"]: (r.hits, r.near, r.distance) for r in intervals.combine([x, y], ["name"]).collect()}
    assert got["p"] == ([], "n", -5)
    assert got["q"][0][:1] == ["n"]


def test_strands(spark):
    from pyspark.sql import functions as F

    rows = [(None, "*"), ("", "*"), ("0", "*"), ("-", "-"), ("-1", "-"), ("+", "+"), (".", "+"), ("1", "+")]
    df = spark.createDataFrame(rows, "s string, want string")
    assert df.where(intervals.parse_strand(F.col("s")) != F.col("want")).count() == 0


def test_cache(spark):
    calls = []
    cache = intervals.AnnotationCache()
    load = lambda: calls.append(1) or spark.range(3)
    assert cache.get("a", load).count() == cache.get("a", load).count() == 3
    assert calls == [1]
    cache.drop("a")


def test_intervals_of_all_lengths(spark):
    """From single bases to whole chromosomes: as brute force has it, and none in more than two bins a level."""
    r = random.Random(6)
    length = lambda: min(2_000_000_000, int(2 ** r.uniform(0, 31)))
    rows = []
    for k in range(120):
        n = length()
        a = r.randrange(0, 2_000_000_001 - n)
        rows.append((f"n{k}", "c", r.choice("+-*"), a, a + n, k))
    rows += [("all", "c", "*", 0, 2_000_000_000, 200), ("base", "c", "*", 999_999_999, 1_000_000_000, 201)]
    annotations, regions = spark.createDataFrame(rows[::2], ANNOTATION), spark.createDataFrame([x[:5] for x in rows[1::2]], REGION)
    idx = intervals.index(annotations, ["line_no"])
    counts = idx.select("s", intervals._bins(F.col("s"), F.col("e"), intervals.LEVELS).alias("b")).groupBy("s", "b.k").count()
    assert idx.select(intervals._bins(F.col("s"), F.col("e"), intervals.LEVELS)).count() <= 20 * idx.count() and counts.count()
    strands = lambda x: "+-" if x == "*" else x
    want = {x[0]: [y[0] for y in rows[::2] if y[3] < x[4] and y[4] > x[3] and set(strands(x[2])) & set(strands(y[2]))] for x in rows[1::2]}
    got = {x.name: list(x.hits) for x in intervals.annotate(regions, annotations).collect()}
    assert got == want


@pytest.mark.parametrize("mode", intervals.MODES)
def test_many_annotations_are_not_broadcast(spark, mode):
    """Spark takes them for small, as it doesn't see that a row becomes one for each of its bins."""
    annotations = spark.sql("select concat('n', id % 3) name, 'c' chrom, '*' strand, cast(id * 40 as int) a_start, cast(id * 40 + 20 as int) a_end, cast(id as int) line_no from range(40000)")
    regions = spark.sql("select concat('r', id) name, 'c' chrom, '+' strand, cast(id * 2000 as int) r_start, cast(id * 2000 + 10 as int) r_end from range(50)")
    df = intervals.annotate(regions, annotations, mode)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "Join Inner" in x and "_bin" in x and "strategy=merge" in x]
    assert df.count() == 50
    assert {len(r.hits) for r in df.collect()} == ({0} if mode == "partial" else {1})
