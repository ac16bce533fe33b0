"""Near-duplicates by bottom-k sketches of one hash function, confirmed on the full shingle sets.

1. Each text's set of word shingles is hashed with one function; the k least hashes are its sketch. Texts with
   one set (exact copies too) become one node, so a group of copies is one node whatever its size.
2. Inverted lists of retained values: two sets at the similarity sought share so many of their k values (see
   ``least_overlap``; the chance that a link at the very threshold is missed is below 1e-7, and 0 for sets
   within the sketch) that they must share one among each one's rarest values. Only those enter the lists.
3. In each list the most central node (whose values are the most frequent) is compared with the others: as many
   pairs as entries. Sketches of unions estimate the similarity and drop the hopeless; the rest is confirmed on whole sets.
4. Lists whose members are then known to be of one component are done. For the members of all others the sketches are
   taken up to the whole sets, so that there is no sampling error to allow for: a set enters the lists of
   its rarest shingles only, no more than two sets of that size at the similarity sought can do without, by classes
   of size (see ``_whole_entries``). Texts that share boilerplate but aren't similar have no such list in common, however
   many they are. In each list the members outside its largest component are compared with the others.
   With this every pair of similar sets is compared, or known to lie in one component already. Pairs grow with the entries but for lists in which several
   components share rare shingles at just less than the similarity sought: those meet their list's largest component.

Defined results: a text without words, or null, has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows share a component; a null doc_id takes part, but never
names a component unless all its ids are null; other columns play no part. Sets are compared by 64-bit
hashes of their shingles; sets with one 64-bit hash are told apart by another one.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, map_arrow, materialize, mix, rows_by_key, slices, word_hashes
from .graph import components

K = 64
CLASSES = 3
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_overlap(k: int, percent: int, miss: float = 1e-7) -> int:
    """Values that two sketches share, but for a chance of ``miss``: each of k draws is common with a chance of percent/100 at least."""
    p, tail, t = percent / 100, 0.0, 0
    while t < k:
        tail += comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(array, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes (sorted, signed) of each text of an Arrow array."""
    data, offsets = buffer_of(array)
    out = []
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        h, first = word_hashes(data[offsets[i] : offsets[j]], at)
        n = max(0, len(h) - width + 1)
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s += h[k : k + n] * _MULTIPLIERS[k]
        s = mix(s).view(np.int64)
        for r in range(j - i):
            a, b = first[r], first[r + 1]
            if b - a >= width:
                out.append(np.unique(s[a : b - width + 1]))
            elif b > a:  # the whole sequence; its length takes part
                out.append(mix((h[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out


def signatures(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, text_hash, n_shingles, sid and sid2 (hashes of the whole set), sketch (k least hashes) of every row."""

    def whole(s: np.ndarray, how, add: int) -> int | None:
        return int(mix(np.array([how(mix(s.view(np.uint64) + np.uint64(add)))], np.uint64) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else None

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(2), width)
            sid, sid2 = [whole(s, np.bitwise_xor.reduce, 0) for s in sets], [whole(s, np.add.reduce, 1) for s in sets]
            cut = [s[:k] for s in sets]
            at = np.zeros(len(cut) + 1, np.int32)
            np.cumsum([len(c) for c in cut], out=at[1:])
            sketch = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cut) if cut else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sid, pa.int64()), pa.array(sid2, pa.int64()), sketch], ["doc_id", "text_hash", "n_shingles", "sid", "sid2", "sketch"])

    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return map_arrow(src, run, "doc_id long, text_hash long, n_shingles long, sid long, sid2 long, sketch array<long>")


def _entries(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Inverted lists: v, sid, n, score. Each node enters the lists of its rarest values only."""
    e = nodes.select("sid", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    often = e.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = e.join(often, "v").groupBy("sid").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("df").alias("score"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    need = F.greatest(F.lit(1), F.floor(least_overlap(k, percent) * F.least(F.lit(1.0), F.col("n") / F.lit(float(k)))))
    room = (F.col("m") - need + 1 - (F.col("m") - F.size("vs"))).cast("int")  # values that no other has come first
    return shared.select("sid", "n", "score", F.explode(F.slice("vs", F.lit(1), F.greatest(F.lit(0), room))).alias("x")).select("x.v", "sid", "n", "score")


def _plausible(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and union sketch allow the similarity."""
    side = lambda c: nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    p = p.withColumn("u", union).withColumn("same", F.size(F.array_intersect(F.array_intersect("u", "s_a"), "s_b")))
    least = F.when(F.size("u") < k, F.lit(percent / 100) * F.size("u") - 0.001).otherwise(F.lit(float(least_overlap(k, percent, 1e-9))))
    # A union of fewer than k values is the whole union only where both sketches are whole sets.
    whole = (F.size("s_a") == F.col("n_a")) & (F.size("s_b") == F.col("n_b"))
    return p.where(F.when((F.size("u") < k) & ~whole, True).otherwise(F.col("same") >= least)).select("a", "b")


def _confirm(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, common, total: sizes of intersection and union of the full sets."""

    def run(batches):
        last, kept = None, None
        for b in batches:
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            ta, tb = b.column(2), b.column(3)
            common, total = [], []
            for start in range(0, b.num_rows, 64):
                stop = min(b.num_rows, start + 64)
                sets = shingle_sets(tb.slice(start, stop - start), width)
                for r in range(start, stop):
                    if left[r] != last:  # rows of one centre stand together
                        last, kept = left[r], shingle_sets(ta.slice(r, 1), width)[0]
                    s = sets[r - start]
                    c = int(np.isin(s, kept, assume_unique=True, kind="sort").sum())
                    common.append(c)
                    total.append(len(s) + len(kept) - c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    t = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"t_{c}"))
    return map_arrow(pairs.join(t("b"), "b").join(t("a"), "a").select("a", "b", "t_a", "t_b"), run, "a long, b long, common long, total long")


def _whole_entries(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists of whole sets: key, sid, n, side; nodes: sid, n.

    Sets of sizes n and m at the similarity t share t / (1 + t) * (n + m) shingles, so one of the n less that many, and one
    more, first ones in any common order is shared. The order is the rarest first. A list is of one shingle and two classes of
    size (CLASSES to a factor 1 / t), so that the least sum of sizes is known closely; side tells the smaller (0) from the larger (1),
    2 is both. ``sets``: sid, v (hash of a shingle), each once.
    """
    often = sets.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = sets.join(often, "v").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs")).join(nodes, "sid")
    step = log(100 / percent) / CLASSES
    size_class = F.floor(F.log("n") / step + 1e-9)
    low = lambda c: F.greatest(F.lit(1), F.floor(F.exp(c * step)) - 1).cast("long")  # noqa: E731, one less for rounding
    least = F.floor((percent * F.col("n") + 99) / 100).cast("long")

    def role(d: int) -> Column:
        """d < 0: the larger of a pair whose smaller is d classes below; d > 0: the smaller; 0: both."""
        c = F.col("c")
        other = F.greatest(low(c + d), F.col("n") if d > 0 else least)
        first = F.col("n") - F.floor((percent * (F.col("n") + other) + 99 + percent) / (100 + percent)).cast("long") + 1
        # Shingles that no other set has come first of all.
        return F.struct(F.least(c, c + d).alias("small"), F.greatest(c, c + d).alias("large"), F.lit(2 if d == 0 else int(d < 0)).alias("side"), (first - F.col("n") + F.size("vs")).cast("int").alias("take"))

    e = shared.withColumn("c", size_class.cast("long")).select("sid", "n", "vs", F.explode(F.array(*[role(d) for d in range(-CLASSES - 1, CLASSES + 2)])).alias("r")).where("r.take > 0")
    return e.select("sid", "n", "r.side", "r.small", "r.large", F.explode(F.slice("vs", F.lit(1), F.col("r.take"))).alias("x")).select(F.xxhash64("x.v", "small", "large").alias("key"), "sid", "n", "side")


def _resolve_collisions(sigs: DataFrame) -> DataFrame:
    """sigs in which different sets have different sids: those that share one get another, made of both hashes."""
    clash = sigs.where("n_shingles > 0").groupBy("sid").agg(F.min("sid2").alias("lo"), F.max("sid2").alias("hi")).where("lo <> hi").select(F.col("sid").alias("_c"))
    clash = materialize(clash)
    if not clash.limit(1).count():
        return sigs
    return sigs.join(clash, F.col("sid") == F.col("_c"), "left").withColumn("sid", F.when(F.col("_c").isNull(), F.col("sid")).otherwise(F.xxhash64("sid", "sid2"))).drop("_c")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row; links: 100 * intersection >= percent * union."""
    sigs = _resolve_collisions(materialize(signatures(docs, width, k)))
    nodes = materialize(sigs.where("n_shingles > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).select("sid", "r.doc_id", "r.text_hash", "n", "sketch"))
    lists = _entries(nodes, k, percent)
    centre = lists.groupBy("v").agg(F.max(F.struct("score", "sid")).alias("c"), F.count("*").alias("members")).where("members > 1").select("v", F.col("c.sid").alias("centre"))
    lists = materialize(lists.join(centre, "v"))
    star = lists.where("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b")).distinct()
    star = materialize(_plausible(star, nodes, k, percent))
    # Whole texts of the nodes in lists, once each.
    named = nodes.join(lists.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_k"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = materialize(source.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_k"))).select("sid", "text").dropDuplicates(["sid"]))
    seen = materialize(_confirm(star, texts, width))
    link = F.col("common") * 100 >= F.col("total") * percent
    labels = materialize(components(seen.where(link), rounds=2))
    # Members of lists of more than one component.
    part = lists.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid")).select("v", "sid", "n", "label")
    several = part.groupBy("v").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("v")
    open_nodes = materialize(part.join(several, "v", "left_semi").select("sid", "n", "label").distinct())
    rest = materialize(_rest(open_nodes, _sets(texts.join(open_nodes.select("sid"), "sid", "left_semi"), width), seen, percent))
    rest = materialize(_plausible(rest, nodes, k, percent))
    more = materialize(_confirm(rest, texts, width))
    labels = components(seen.where(link).select("a", "b").union(more.where(link).select("a", "b")))
    named = nodes.select("sid", "doc_id").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "label").select("sid", "component_id")
    out = sigs.select("doc_id", "text_hash", "n_shingles", "sid").join(of, "sid", "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """sid, v: the shingle hashes of each text, each once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = shingle_sets(part.column(1), width)
                sid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                v = np.concatenate(sets)
                for c in range(0, len(v), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(sid[c : c + (1 << 16)], pa.int64()), pa.array(v[c : c + (1 << 16)], pa.int64())], ["sid", "v"])

    return map_arrow(texts, run, "sid long, v long")


def _rest(nodes: DataFrame, sets: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that the lists of whole sets leave to be compared; nodes: sid, n, label; seen: pairs already compared."""
    lists = materialize(_whole_entries(nodes.select("sid", "n"), materialize(sets), percent).join(nodes.select("sid", "label"), "sid"))
    sizes = lists.groupBy("key", "label").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("x.label").alias("main"))
    mixed = lists.join(largest, "key")
    other = mixed.where("label <> main").select("key", *[F.col(c).alias(f"o_{c}") for c in ("sid", "n", "label", "side")])
    rest = mixed.join(other, "key").where(F.col("label") != F.col("o_label")).where((F.col("label") == F.col("main")) | (F.col("sid") < F.col("o_sid")))
    rest = rest.where((F.col("side") != F.col("o_side")) | (F.col("side") == 2)).where(100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n"))
    rest = rest.select(F.least("sid", "o_sid").alias("a"), F.greatest("sid", "o_sid").alias("b")).distinct()
    tried = seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rest.join(tried, ["a", "b"], "left_anti")


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns kept. Of repeated rows one stays."""
    found = materialize(near_duplicates(docs, width, percent).select("doc_id", "text_hash", "kept"))
    out = rows_by_key(docs, materialize(found.where(~F.col("kept")).select("doc_id", "text_hash").distinct()), "left_anti")
    twice = materialize(found.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1"))
    if not twice.limit(1).count():
        return out
    again = rows_by_key(out, twice, "left_semi").withColumn("__lw_x", F.xxhash64("text")).dropDuplicates(["doc_id", "__lw_x"]).drop("__lw_x")
    return rows_by_key(out, twice, "left_anti").unionByName(again)


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
