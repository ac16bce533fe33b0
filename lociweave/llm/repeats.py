"""Repeated byte strings across documents: every byte covered by a 50-byte string that also starts in a document with a smaller id.

The method that was asked for, matching statistics over a run-length compressed Burrows-Wheeler index, needs one
index over all text (or every document streamed against every shard's index); see the README for why it gave way
to this exact substitute, which keeps its two ideas: repeats are stored once, and only the ends of matches are
looked at closely.

1. In each 50-byte window the least of its 35 16-byte grams (the leftmost of equal ones) is its anchor. It depends on
   the window's bytes only, so equal windows have equal anchors. One anchor serves about 18 windows in a row.
2. Chunks ask which anchors other documents have, too; each distinct anchor once, 64 bits.
3. For those they send each distinct context (the anchor's windows, joined) with its least doc_id. A bucket
   finds each window's least doc_id, looking at each distinct context once.
4. Each chunk marks the windows whose least doc_id is smaller than their document's, and removes what they cover.

Windows are compared by 64-bit hashes. Defined results: null and empty texts have no bytes; texts below 50 bytes keep all;
rows with one id are one document, so that they never remove each other's bytes; a null id counts as
larger than all; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, buffer_of, materialize, mix, powers, prefix_sums, range_hash, ship_code, slices
from .exchange import BUNDLES, BUNDLES_SQL, Route, bucket_of, chunk_of, opened, pack, parts, split, table, unpack

GRAM = 16
SUB = 8  # a bucket of contexts is worked off in as many parts, to bound memory
LAST = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h, at, lo, hi: each anchor's hash and position, and the first and last start of the windows it serves."""
    grams, n = length - GRAM + 1, len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none
    sums = prefix_sums(data)
    g = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n - GRAM + 1, INVERSE))
    # Least of each run of grams, by doubling.
    low, width = g, 1
    while width * 2 <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if grams > width:
        low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
    starts = len(low)
    valid = np.ones(starts + 1, bool)
    valid[starts] = False
    for back in range(1, length):  # windows that would cross the end of a text
        cross = offsets[1:-1] - back
        valid[cross[(cross >= 0) & (cross < starts)]] = False
    new = valid[:-1].copy()
    new[1:] &= ~valid[:-2] | (low[1:] != low[:-1])
    s = np.flatnonzero(new)
    if not len(s):
        return none.view(np.uint64), none, none, none
    last = valid[:-1] & ~valid[1:]
    last[:-1] |= valid[:-2] & (low[1:] != low[:-1])
    e = np.flatnonzero(last)
    out = []
    while len(s):
        at, want = np.full(len(s), -1, np.int64), low[s]
        todo = np.arange(len(s))
        for k in range(grams):
            same = g[s[todo] + k] == want[todo]
            at[todo[same]] = s[todo[same]] + k
            todo = todo[~same]
            if not len(todo):
                break
        hi = np.minimum(e, at)
        out.append((want, at, s, hi))
        more = hi < e  # the same least gram again further on
        s, e = hi[more] + 1, e[more]
    h, at, lo, hi = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(lo, kind="stable")
    return h[order], at[order], lo[order], hi[order]


class _Chunk:
    """Anchors of all texts of a chunk, positions in its whole buffer."""

    def __init__(self, texts, length: int):
        self.data, self.offsets = buffer_of(texts)
        got = []
        for i, j in slices(self.offsets, 1 << 20):
            base = self.offsets[i]
            h, at, lo, hi = anchors(self.data[base : self.offsets[j]], self.offsets[i : j + 1] - base, length)
            # Least hashes are small numbers; mixed again they spread over the buckets.
            got.append((mix(h + BASE), at + base, lo + base, hi + base))
        self.h, self.at, self.lo, self.hi = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.row = np.searchsorted(self.offsets, self.lo, "right") - 1
        self.length = length

    def contexts(self, shared: np.ndarray):
        """Anchors that are shared: their indexes, and the number of each one's context; contexts by bucket order: key, hash and an example."""
        use = np.flatnonzero(np.isin(self.h, shared))
        key = np.zeros(len(use), np.uint64)
        lo, hi = self.lo[use], self.hi[use]
        for i, j in slices(self.offsets, 1 << 20):
            base, end = self.offsets[i], self.offsets[j]
            a, b = np.searchsorted(lo, [base, end])
            if b > a:
                key[a:b] = range_hash(prefix_sums(self.data[base:end]), lo[a:b] - base, hi[a:b] + self.length - base)
        key = mix(key + mix((self.at[use] - lo).astype(np.uint64) * np.uint64(64) + (hi - lo).astype(np.uint64)))
        order = np.lexsort((key, self.h[use]))
        k, hh = key[order], self.h[use][order]
        first = np.ones(len(order), bool)
        first[1:] = (k[1:] != k[:-1]) | (hh[1:] != hh[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(first) - 1
        return use, number, use[order[first]]


def _ids(column) -> np.ndarray:
    return column.combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.fill_null(LAST).to_numpy(zero_copy_only=False)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("message", pa.binary())])
_MESSAGE_SQL = "bucket int, chunk int, message binary"
_PARTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("message", pa.list_(pa.binary()))])
_PARTS_SQL = "bucket int, chunk int, message array<binary>"


def _ask(length: int, n: int):
    def run(t: pa.Table) -> pa.Table:
        c = _Chunk(t["text"], length)
        ids = _ids(t["doc_id"])[c.row]
        order = np.argsort(c.h, kind="stable")
        h, ids = c.h[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)
        h = h[start]
        at = split(bucket_of(h, n), n)
        some = [b for b in range(n) if at[b + 1] > at[b]]
        return table({"bucket": some, "chunk": [t["chunk"][0].as_py()] * len(some), "message": [pack(h[at[b] : at[b + 1]], several[at[b] : at[b + 1]], deltas=True) for b in some]}, _MESSAGE)

    return run


def _shared(t: pa.Table) -> pa.Table:
    chunks, got = t["chunk"].to_pylist(), [unpack(m.as_py(), True) for m in t["message"]]
    h = np.concatenate([x[0] for x in got])
    several = np.concatenate([x[1] for x in got])
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(start, len(s)))
    both = (size > 1) | (np.maximum.reduceat(several[order], start) > 0)
    yes = np.empty(len(h), bool)
    yes[order] = np.repeat(both, size)
    out, at = {"bucket": [], "chunk": [], "message": []}, 0
    for c, x in zip(chunks, got):
        keep = x[0][yes[at : at + len(x[0])]]
        at += len(x[0])
        if len(keep):
            out["bucket"].append(t["bucket"][0].as_py())
            out["chunk"].append(c)
            out["message"].append(pack(keep, deltas=True))
    return table(out, _MESSAGE)


def _messages(t: pa.Table, deltas: bool) -> list[list[np.ndarray]]:
    """A chunk's messages in order of bucket."""
    buckets = t["bucket"].to_numpy()
    out = []
    for i in np.argsort(buckets, kind="stable"):
        m = t["message"][int(i)]
        out += [unpack(x.as_py(), deltas) for x in (m if pa.types.is_list(m.type) else [m])]
    return out


def _send(length: int, n: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        shared = [x[0] for x in _messages(replies, True)]
        if not docs.num_rows or not shared:
            return _PARTS.empty_table()
        c = _Chunk(docs["text"], length)
        use, number, example = c.contexts(np.concatenate(shared))
        least = np.full(len(example), LAST, np.int64)
        np.minimum.at(least, number, _ids(docs["doc_id"])[c.row[use]])
        at = split(bucket_of(c.h[example], n * SUB), n * SUB)
        size = c.hi[example] - c.lo[example] + length
        out = {"bucket": [], "chunk": [], "message": []}

        def message(i: slice) -> bytes:
            lo, sz = c.lo[example[i]], size[i]
            ends = np.cumsum(sz)
            index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sz), sz)
            return pack(least[i], sz.astype(np.int32), c.data[index])

        for b in range(n):
            if at[(b + 1) * SUB] > at[b * SUB]:
                out["bucket"].append(b)
                out["chunk"].append(docs["chunk"][0].as_py())
                out["message"].append([message(slice(at[k], at[k + 1])) for k in range(b * SUB, (b + 1) * SUB)])
        return table(out, _PARTS)

    return run


def _least_of(got: list[list[np.ndarray]], length: int) -> list[np.ndarray]:
    """Each window's least doc_id, for the contexts of each message in order."""
    ids, sizes = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]).astype(np.int64)
    if not len(ids):
        return [ids] * len(got)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    data = np.concatenate([x[2] for x in got])
    key = np.zeros(len(sizes), np.uint64)
    ranges = slices(np.concatenate([[0], ends]), 1 << 20)
    for i, j in ranges:
        key[i:j] = range_hash(prefix_sums(data[begin[i] : ends[j - 1]]), begin[i:j] - begin[i], ends[i:j] - begin[i])
    _, pick, number = np.unique(mix(key + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
    low = np.full(len(pick), LAST, np.int64)
    np.minimum.at(low, number, ids)
    order = np.argsort(pick)
    rank = np.empty(len(pick), np.int64)
    rank[order] = np.arange(len(pick))
    pick, low, number = pick[order], low[order], rank[number]
    wins = sizes[pick] - length + 1
    to = np.concatenate([[0], np.cumsum(wins)])
    hashes = np.zeros(to[-1], np.uint64)
    edge = np.searchsorted(pick, [i for i, _ in ranges] + [len(sizes)])
    for (i, j), a, b in zip(ranges, edge[:-1], edge[1:]):
        if b > a:
            p = np.arange(to[a], to[b]) + np.repeat(begin[pick[a:b]] - begin[i] - to[a:b], wins[a:b])
            hashes[to[a] : to[b]] = range_hash(prefix_sums(data[begin[i] : ends[j - 1]]), p, p + length)
    owner = np.repeat(low, wins)
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    best = np.empty(len(s), np.int64)
    best[order] = np.repeat(np.minimum.reduceat(owner[order], start), np.diff(np.append(start, len(s))))
    out, at = [], 0
    for x in got:
        num = number[at : at + len(x[0])]
        at += len(num)
        w = wins[num]
        stop = np.cumsum(w)
        out.append(best[np.arange(stop[-1] if len(stop) else 0) + np.repeat(to[num] - (stop - w), w)])
    return out


def _least(length: int):
    def run(t: pa.Table) -> pa.Table:
        replies = [[] for _ in range(t.num_rows)]
        for k in range(SUB):
            for reply, x in zip(replies, _least_of([unpack(m[k].as_py()) for m in t["message"]], length)):
                reply.append(pack(x))
        return table({"bucket": t["bucket"].to_pylist(), "chunk": t["chunk"].to_pylist(), "message": replies}, _PARTS)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _mark(length: int, with_text: bool):
    def run(docs: pa.Table, shared: pa.Table | None, replies: pa.Table | None) -> pa.Table:
        c = _Chunk(docs["text"], length)
        cover = np.zeros(len(c.data) + 1, np.int32)
        if shared is not None:
            use, number, example = c.contexts(np.concatenate([x[0] for x in _messages(shared, True)]))
            best = np.concatenate([x[0] for x in _messages(replies, False)])
            ids = _ids(docs["doc_id"])
            wins = c.hi[example] - c.lo[example] + 1
            to = np.cumsum(wins) - wins
            for a in range(0, len(use), 1 << 16):
                u, num = use[a : a + (1 << 16)], number[a : a + (1 << 16)]
                w = wins[num]
                stop = np.cumsum(w)
                step = np.arange(stop[-1]) - np.repeat(stop - w, w)
                hit = best[np.repeat(to[num], w) + step] < np.repeat(ids[c.row[u]], w)
                p = (np.repeat(c.lo[u], w) + step)[hit]
                np.add.at(cover, p, 1)
                np.add.at(cover, p + length, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out = {f.name: [] for f in _RESULT}
        for r in range(docs.num_rows):
            a, b = c.offsets[r], c.offsets[r + 1]
            x, d = gone[a:b], c.data[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]])))
            kept = d[~x].tobytes() if len(edge) else d.tobytes()
            out["n_bytes"].append(int(b - a))
            out["spans"].append(edge)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_text else None)
        out["doc_id"], out["text_hash"] = docs["doc_id"].combine_chunks(), docs["text_hash"].combine_chunks()
        return table(out, _RESULT)

    return run


def find(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, text_hash, n_bytes, spans (begin and end of each removed run, alternating), kept_sha256, kept (remaining bytes) of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    chunks, n = parts(docs)
    route = Route.of("chunk", "bucket", max(chunks, n))
    back = route.back()
    key, text_hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    src = docs.select(key.alias("doc_id"), text_hash.alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), chunk_of(chunks, key, text_hash).alias("chunk"))
    ask, share, send, least, mark = _ask(length, n), _shared, _send(length, n), _least(length), _mark(length, with_text)
    asked = route.relay(src.groupBy("chunk").applyInArrow(lambda t: route.bundle(ask(t)), BUNDLES_SQL))
    shared = materialize(back.relay(asked.groupBy("p").applyInArrow(lambda t: back.bundle(share(opened(t))), BUNDLES_SQL)))

    def sends(d: pa.Table, r: pa.Table) -> pa.Table:
        return route.bundle(send(d, opened(r))) if d.num_rows and r.num_rows else BUNDLES.empty_table()

    sent = route.relay(src.groupBy("chunk").cogroup(shared.groupBy("p")).applyInArrow(sends, BUNDLES_SQL))
    replies = materialize(back.relay(sent.groupBy("p").applyInArrow(lambda t: back.bundle(least(opened(t))), BUNDLES_SQL)))
    both = shared.withColumn("kind", F.lit(0)).unionByName(replies.withColumn("kind", F.lit(1)))

    def finish(d: pa.Table, r: pa.Table) -> pa.Table:
        if not d.num_rows:
            return _RESULT.empty_table()
        kind = r["kind"].to_numpy()
        got = [r.take(np.flatnonzero(kind == k)) for k in (0, 1)]
        return mark(d, *(opened(x) if x.num_rows else None for x in got))

    return src.groupBy("chunk").cogroup(both.groupBy("p")).applyInArrow(finish, "doc_id long, text_hash long, n_bytes long, spans array<long>, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs with the repeated bytes cut from the texts (incomplete characters at the cuts are dropped), all other columns kept."""
    text = F.regexp_replace(F.decode("kept", "UTF-8"), "\uFFFD", "")
    found = find(docs, length, True).where(F.size("spans") > 0).select(F.col("doc_id").alias("__lw_d"), F.col("text_hash").alias("__lw_k"), text.alias("__lw_t")).dropDuplicates(["__lw_d", "__lw_k"])
    cols = docs.columns
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__lw_d")) & (F.xxhash64("text") == F.col("__lw_k")), "left").withColumn("text", F.coalesce("__lw_t", "text")).select(*cols)


def report(docs: DataFrame) -> DataFrame:
    d = find(docs)
    pairs = F.transform(F.sequence(F.lit(1), F.size("spans"), F.lit(2)), lambda i: F.element_at("spans", i + 1) - F.element_at("spans", i))
    total = F.when(F.size("spans") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(0).cast("long")
    return d.select("doc_id", "n_bytes", total.alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
