"""The queries over test tables: SQL where there is any, else brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from lociweave.llm import queries

DATA = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    form = lambda v: f"{v:.12g}" if isinstance(v, float) else v
    want = sorted(repr([form(dict(zip(names, r))[k]) for k in cols]) for r in cur.fetchall())
    assert sorted(repr([form(r[k]) for k in cols]) for r in df.collect()) == want


def near_duplicate_classes(texts, width, percent):
    """{doc_id: (set size, least id of its component)} by comparing all pairs."""
    sets = {}
    for d, t in texts:
        w = spaced((t or "").translate(ASCII))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            i = len(x & y)
            if 100 * i >= percent * (len(x) + len(y) - i):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates(spark):
    want = near_duplicate_classes(documents(), 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_near_dedup"](spark, DATA).collect()}
    assert got == want


def repeats(texts, length=50):
    first, out = {}, {}
    for d, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first.setdefault(x[p : p + length], d) != d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[d] = (len(x), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op7_repeats"](spark, DATA).collect()}
    assert got == repeats(documents())


def test_language_model(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op10_lm_score"](spark, DATA).collect()}
    tokens = {d: spaced((t or "").translate(ASCII)) + [""] for d, t in documents()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in tokens}
    count = collections.Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(count.values()), len(count)
    base = model = 0
    assert set(got) == set(tokens)
    for d, t in tokens.items():
        r = got[d]
        b = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score < 0
        if held[d]:
            base, model = base + b, model + r.score
    assert model > 0.9 * base  # log probabilities: the model is the better one on held-out text


def test_pages(spark):
    df = queries.QUERIES["op3_html_text"](spark, DATA)
    pages = dict(duckdb.sql(f"select page_id, html from '{DATA}/pages.parquet'").fetchall())
    got = {r.page_id: r for r in df.collect()}
    assert set(got) == set(pages)
    for k, r in got.items():
        assert r.n_chars == len(r.text)
        body = re.search(r"<article>(.*?)</article>", pages[k], re.S)[1]
        for p in re.findall(r"<p>([^<&]+)</p>", body):
            assert " ".join(p.split()) in r.text
        ad = re.search(r'<div class="ad">([^<]+)</div>', pages[k])
        assert ad is None or ad[1] not in r.text or ad[1] in re.sub(r"<[^>]+>", "", body)


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows, against brute force where there is one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, DATA)
        if name != names[-1]:
            assert out.columns == docs.columns
            out = corpus_pipeline.materialize(out)
        if name == "quality rules":
            from lociweave.llm import quality

            assert ids(out) == sorted(r.doc_id for r in quality.judge(docs).where("kept").collect())
        elif name == "near-duplicates":
            c = near_duplicate_classes([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert ids(out) == sorted(d for d, (_, root) in c.items() if d == root)
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
            windows = set()
            for (t,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall():
                w = words(t)
                windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(w) for w in windows}
            hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
            assert ids(out) == sorted(r.doc_id for r in before.collect() if not hit(r.text))
        elif name == "source mix":
            from lociweave.llm import mixing

            kept = {r.doc_id: r.text for r in before.collect()}
            got = collections.Counter(r.doc_id for r in out.collect())
            assert all(n <= 2 for n in got.values()) and {r.text for r in out.collect()} <= set(kept.values())
            for r in mixing.allot(before).collect():
                assert abs(got[r.doc_id] * r.size - r.taken) <= r.size / 2
        else:
            packed = collections.Counter(d for r in out.collect() for d, p in zip(r.doc_ids, r.parts) if p == 0)
            assert packed == collections.Counter(ids(before))
    assert sum(r.n_tokens for r in out.collect()) == sum(r.n_tokens for r in corpus_pipeline.run(spark, DATA).collect())


def test_names():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
