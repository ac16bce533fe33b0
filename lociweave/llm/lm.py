"""Language-model scoring by deleted interpolation.

P(w | v) = a2 * c(v w) / c(v) + a1 * c(w) / N + a0 / (V + 1), the weights a depending on how often the context v
was seen (buckets of powers of two). Expectation-maximisation learns them on held-out counts: each training
token in turn is taken out of all counts (c(v w) - 1, c(v) - 1, c(w) - 1), which is the deleted estimate. The
tokens are summed in a grid over (context bucket, the two ratios in quarter octaves), whose size doesn't depend
on the corpus; that is all that reaches the driver.

Counts cover all training texts. Chunks send each distinct word and word pair once with its count; a bucket of
the key space adds them up and answers each chunk. Words and pairs are told apart by 64-bit hashes.

Defined results: a null or empty text is one end token; a null doc_id is never held out; without training
documents N and V are 0 and the model is the weight of the uniform part; repeated rows
count and are scored each; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, materialize, mix, ship_code, slices, word_hashes
from .exchange import BUNDLES, BUNDLES_SQL, Route, bucket_of, chunk_of, opened, pack, parts, split, table, unpack

START, END = np.uint64(0x51A7C0DE51A7C0DE), np.uint64(0xE0DE0DE0E0DE0DE1)
_FIRST, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
BUCKETS, STEPS = 40, 4
ROUNDS = 100


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts with their end tokens, contexts of each, and where each text begins."""
    data, offsets = buffer_of(texts)
    got, begin, n_all = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(offsets):
        h, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(first)
        out = np.full(len(h) + j - i, END, np.uint64)
        out[np.arange(len(h)) + np.repeat(np.arange(j - i), n)] = h
        got.append(out)
        begin.append(n_all + np.cumsum(n + 1))
        n_all += len(out)
    t = np.concatenate(got) if got else np.zeros(0, np.uint64)
    at = np.concatenate(begin)
    context = np.empty_like(t)
    context[1:] = t[:-1]
    context[at[:-1]] = START
    return t, context, at


def _keys(t: pa.Table):
    tok, context, at = tokens(t["text"])
    held = t["held"].to_numpy(zero_copy_only=False).astype(bool)
    train = ~np.repeat(held, np.diff(at))
    # Contexts are words or the start, so that the words and the start give their counts, too.
    words = np.concatenate([tok, np.full(len(held), START, np.uint64)])
    uni, of_word = np.unique(words, return_inverse=True)
    bi, of_pair = np.unique(mix(context * _FIRST + tok * _SECOND), return_inverse=True)
    return at, held, train, uni, of_word, bi, of_pair


_ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("uni", pa.binary()), ("bi", pa.binary())])
#: Bundles with a bucket's tokens and distinct words, in one of them.
_ANSWER = pa.schema([*BUNDLES, ("n", pa.int64()), ("v", pa.int64())])
_ANSWER_SQL = BUNDLES_SQL + ", n long, v long"


def _ask(n: int):
    def run(t: pa.Table) -> pa.Table:
        at, held, train, uni, of_word, bi, of_pair = _keys(t)
        cu = np.bincount(of_word, weights=np.concatenate([train, ~held]), minlength=len(uni)).astype(np.uint64)
        cb = np.bincount(of_pair, weights=train, minlength=len(bi)).astype(np.uint64)
        u, b = split(bucket_of(uni, n), n), split(bucket_of(bi, n), n)
        some = [k for k in range(n) if u[k + 1] > u[k] or b[k + 1] > b[k]]
        return table({
            "bucket": some, "chunk": [t["chunk"][0].as_py()] * len(some),
            "uni": [pack(uni[u[k] : u[k + 1]], cu[u[k] : u[k + 1]], deltas=True) for k in some],
            "bi": [pack(bi[b[k] : b[k + 1]], cb[b[k] : b[k + 1]], deltas=True) for k in some],
        }, _ASK)

    return run


def _sum(messages) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Total count of each key, by message; the distinct keys and their totals."""
    got = [unpack(m.as_py(), True) for m in messages]
    h, c = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    if not len(h):
        return [np.zeros(0, np.uint64)] * len(got), h, c
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    total = np.add.reduceat(c[order], start)
    out = np.empty(len(h), np.uint64)
    out[order] = np.repeat(total, np.diff(np.append(start, len(s))))
    return np.split(out, np.cumsum([len(x[0]) for x in got])[:-1]), s[start], total


def _answer(back: Route):
    def run(bundles: pa.Table) -> pa.Table:
        t = opened(bundles)
        uni, keys, total = _sum(t["uni"])
        bi, _, _ = _sum(t["bi"])
        real = (total > 0) & (keys != START)
        out = back.bundle(table({"bucket": t["bucket"].to_pylist(), "chunk": t["chunk"].to_pylist(), "uni": [pack(x) for x in uni], "bi": [pack(x) for x in bi]}, _ASK))
        first = np.arange(out.num_rows) == 0
        return pa.Table.from_arrays([*out.columns, pa.array(first * int(total[real].sum()), pa.int64()), pa.array(first * int(real.sum()), pa.int64())], schema=_ANSWER)

    return run


def _counts(d: pa.Table, bundles: pa.Table):
    r = opened(bundles)
    at, held, train, uni, of_word, bi, of_pair = _keys(d)
    order = np.argsort(r["bucket"].to_numpy(), kind="stable")
    cu = np.concatenate([unpack(r["uni"][int(i)].as_py())[0] for i in order]).astype(np.int64)
    cb = np.concatenate([unpack(r["bi"][int(i)].as_py())[0] for i in order]).astype(np.int64)
    k = len(of_word) - len(held)
    word, pair = cu[of_word[:k]], cb[of_pair]
    before = np.empty_like(word)  # count of the context
    before[1:] = word[:-1]
    if len(held):
        before[at[:-1]] = cu[of_word[k]]
    return at, held, train, word, pair, before


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that wasn't seen, else one more than the logarithm."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1), 0)


_GRID = pa.schema([("b", pa.int32()), ("q2", pa.int32()), ("q1", pa.int32()), ("n", pa.int64())])


def _grid(n: int, v: int):
    def run(d: pa.Table, r: pa.Table) -> pa.Table:
        if not d.num_rows:
            return _GRID.empty_table()
        _, _, train, word, pair, before = _counts(d, r)
        w, p, c = word[train] - 1, pair[train] - 1, before[train] - 1
        level = lambda x: np.where(x > 0, np.round(STEPS * np.log2(np.maximum(x, 1e-300))).astype(np.int64), -9999)
        q2 = level(p / np.maximum(c, 1) * (v + 1))
        q1 = level(w / max(n - 1, 1) * (v + 1))
        key, count = np.unique(((bucket(c) << 32) + ((q2 + 10000) << 16) + q1 + 10000), return_counts=True)
        return table({"b": key >> 32, "q2": ((key >> 16) & 0xFFFF) - 10000, "q1": (key & 0xFFFF) - 10000, "n": count}, _GRID)

    return run


def learn(b: np.ndarray, q2: np.ndarray, q1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights (BUCKETS x 3: pair, word, uniform) by expectation-maximisation; one token of each kind is added, so that no weight is 0 but that of pairs after an unseen context."""
    back = lambda q: np.where(q > -9999, 2.0 ** (q / STEPS), 0.0)
    f = np.stack([back(q2), back(q1), np.ones(len(n))], 1)
    weights = np.tile([1 / 3, 1 / 3, 1 / 3], (BUCKETS, 1))
    weights[0] = [0, 0.5, 0.5]
    prior = np.ones((BUCKETS, 3))
    prior[0, 0] = 0
    for _ in range(ROUNDS):
        part = weights[b] * f
        part *= (n / part.sum(1))[:, None]
        new = prior.copy()
        np.add.at(new, b, part)
        weights = new / new.sum(1, keepdims=True)
    return weights


_SCORE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(weights: np.ndarray, n: int, v: int):
    def run(d: pa.Table, r: pa.Table) -> pa.Table:
        if not d.num_rows:
            return _SCORE.empty_table()
        at, held, _, word, pair, before = _counts(d, r)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        a = weights[bucket(before)]
        p = a[:, 0] * pair / np.maximum(before, 1) + a[:, 1] * word / max(n, 1) + a[:, 2] / (v + 1)
        add = lambda x: np.add.reduceat(x, at[:-1])
        return table({
            "doc_id": d["doc_id"].combine_chunks(), "text_hash": d["text_hash"].combine_chunks(), "held_out": held, "n_tokens": np.diff(at), "n_known": add((word > 0).astype(np.int64)),
            "train_tokens": np.full(len(held), n), "base_score": add(base), "score": add(np.log10(p)),
        }, _SCORE)

    return run


def score(docs: DataFrame, folds: int = 10) -> DataFrame:
    """doc_id, text_hash, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    ship_code(docs.sparkSession)
    chunks, buckets = parts(docs)
    route = Route.of("chunk", "bucket", max(chunks, buckets))
    back, ask = route.back(), _ask(buckets)
    key, text_hash = F.col("doc_id").cast("long"), F.xxhash64("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    src = docs.select(key.alias("doc_id"), text_hash.alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held"), chunk_of(chunks, key, text_hash).alias("chunk"))
    asked = route.relay(src.groupBy("chunk").applyInArrow(lambda t: route.bundle(ask(t)), BUNDLES_SQL))
    answers = materialize(asked.groupBy("p").applyInArrow(_answer(back), _ANSWER_SQL))
    size = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = size["n"] or 0, size["v"] or 0
    replies = answers.select("p", "q", "bundle")
    if back.hops > 1:
        replies = materialize(back.relay(replies))
    both = src.groupBy("chunk").cogroup(replies.groupBy("p"))
    grid = materialize(both.applyInArrow(_grid(n, v), "b int, q2 int, q1 int, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))).toPandas()
    weights = learn(grid["b"].to_numpy(np.int64), grid["q2"].to_numpy(np.int64), grid["q1"].to_numpy(np.int64), grid["n"].to_numpy(np.float64))
    return both.applyInArrow(_score(weights, n, v), "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    return score(docs).drop("text_hash")
