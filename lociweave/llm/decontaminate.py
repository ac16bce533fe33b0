"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams against all windows of the texts.

Native: DataFrame functions only. The windows of the benchmark (bounded, and its size is checked) are
broadcast as a hash set; each text's window hashes are exploded inside one stage of generated code, probed,
and every hit is verified on its words, so that only hits and one row per text are shuffled.

Defined results: a null or empty text has no words and is never hit; an item without words has no window;
the same window in several items counts for each of them; items with one id count once; a null item id is
shown as the empty string; repeated rows each get their own result; other columns of the inputs, whatever
their names, play no part in the scan and are kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, ALNUM_GAP, ascii_lower, materialize, rows_by_key, words

#: A broadcast beyond this many bytes of window text gives way to a shuffled join.
BROADCAST_BYTES = 64 << 20
SALT = 16


def _window_hash(ws: Column, length: Column) -> Column:
    return F.when(F.size(ws) >= length, F.transform(F.sequence(F.lit(1), F.size(ws) - length + 1), lambda i: F.xxhash64(F.slice(ws, i, length))))


def item_windows(items: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: h, len, w (words), items (ids as sorted distinct strings). An item of fewer than n words, but not none, is one window."""
    ws = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"), words(ascii_lower(F.col("text")), ALNUM_GAP).alias("_ws"))
    ws = ws.where(F.size("_ws") > 0).withColumn("_len", F.least(F.size("_ws"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("_ws") - F.col("_len") + 1))
    w = ws.select("_item", "_len", "_ws", at.alias("_i")).select("_item", "_len", F.slice("_ws", F.col("_i"), F.col("_len")).alias("_w"))
    return w.groupBy("_len", "_w").agg(F.collect_set("_item").alias("_items")).withColumn("_h", F.xxhash64("_w"))


def scan(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit, items (sorted), spans (sorted hit windows: at, len)."""
    known = item_windows(items, n)
    size = known.agg(F.sum(F.octet_length(F.concat_ws(" ", "_w")) + 64).alias("b"), F.collect_set("_len").alias("lens")).first()
    lens = sorted(size["lens"])  # at most n values
    ws = docs.select("doc_id", F.xxhash64("text").alias("_key"), words(ascii_lower(F.col("text")), ALNUM_GAP).alias("_ws"))
    counts = ws.select("doc_id", "_key", F.size("_ws").cast("long").alias("_n"), F.lit(-1).alias("_at"), F.lit(0).alias("_len"), F.array().cast("array<string>").alias("_items"))
    if not lens:
        hits = counts
    elif (size["b"] or 0) <= broadcast_bytes:
        # Each text also sends one row of its own through the probe, so it need not be read twice nor joined again.
        own = known.select("_len", "_w", "_items", "_h").unionByName(
            docs.sparkSession.sql("select 0 as _len, cast(array() as array<string>) as _w, cast(array() as array<string>) as _items, cast(0 as bigint) as _h")
        )
        own = F.broadcast(own.select(F.col("_len").alias("k_len"), F.col("_w").alias("k_w"), F.col("_items"), F.col("_h").alias("k_h")))
        probe = ws
        probe = probe.withColumn("_len", F.lit(lens[0])) if len(lens) == 1 else probe.withColumn("_len", F.explode(F.array(*map(F.lit, lens))))
        first = F.col("_len") == lens[0]
        probe = probe.select("doc_id", "_key", "_ws", "_len", F.posexplode(F.concat(F.when(first, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.coalesce(_window_hash(F.col("_ws"), F.col("_len")), F.array().cast("array<bigint>")))).alias("_p", "_h"))
        at = F.col("_p") - F.when(F.col("_len") == lens[0], 1).otherwise(0)
        hits = probe.join(own, (F.col("_h") == F.col("k_h")) & F.when(at < 0, F.col("k_len") == 0).otherwise((F.col("k_len") == F.col("_len")) & (F.slice("_ws", at + 1, F.col("_len")) == F.col("k_w"))))
        hits = hits.select("doc_id", "_key", F.size("_ws").cast("long").alias("_n"), at.alias("_at"), F.when(at < 0, 0).otherwise(F.col("_len")).alias("_len"), "_items")
    else:
        probe = ws.withColumn("_len", F.explode(F.array(*map(F.lit, lens))))
        probe = probe.select("doc_id", "_key", "_ws", "_len", F.posexplode(_window_hash(F.col("_ws"), F.col("_len"))).alias("_at", "_h"))
        probe = probe.select("doc_id", "_key", F.size("_ws").cast("long").alias("_n"), "_at", "_len", "_h", F.slice("_ws", F.col("_at") + 1, F.col("_len")).alias("_w"))
        # A window may be in a third of all texts: its rows are dealt out among copies of the known one.
        probe = probe.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_key", "_at"), F.lit(SALT)).cast("int"))
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = probe.join(known, ["_h", "_len", "_w", "_salt"]).select("doc_id", "_key", "_n", "_at", "_len", "_items").unionByName(counts)
    got = hits.groupBy("doc_id", "_key").agg(
        F.first("_n").alias("n_words"),
        F.count(F.when(F.col("_at") < 0, 1)).alias("_rows"),
        F.array_sort(F.collect_set(F.when(F.col("_at") >= 0, F.struct(F.col("_at").alias("at"), F.col("_len").alias("len"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(
        "spans", start,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["len"] - F.greatest(a["to"], s["at"]))).cast("long").alias("n"), F.greatest(a["to"], s["at"] + s["len"]).alias("to")),
        lambda a: a["n"],
    )
    got = got.select("doc_id", F.col("_key").alias("text_hash"), "n_words", covered.alias("n_hit"), "items", "spans", "_rows")
    return got.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows")))).drop("_copy", "_rows")


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, mode: str = "document") -> DataFrame:
    """docs without hit documents (mode "document"), or with the hit words and the gaps after them cut from the texts ("span")."""
    if mode not in ("document", "span"):
        raise ValueError(mode)
    hit = scan(docs, items, n).where("n_hit > 0")
    if mode == "document":
        return rows_by_key(docs, materialize(hit.select("doc_id", "text_hash").distinct()), "left_anti")
    found = hit.select(F.col("doc_id").alias("__lw_d"), F.col("text_hash").alias("__lw_k"), F.col("spans").alias("__lw_spans")).dropDuplicates(["__lw_d", "__lw_k"])
    on = F.col("doc_id").eqNullSafe(F.col("__lw_d")) & (F.xxhash64("text") == F.col("__lw_k"))
    # Flags per word by one pass over the sorted spans would need state; a merged list of positions is as good.
    hit = F.array_distinct(F.flatten(F.transform("__lw_spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    parts, gaps = F.regexp_extract_all("text", F.lit(f"({ALNUM_ANY})"), 1), F.split("text", ALNUM_ANY)
    cut = F.concat(F.element_at("__lw_gaps", 1), F.array_join(F.transform("__lw_parts", lambda w, i: F.when(F.array_contains("__lw_hit", i), "").otherwise(F.concat(w, F.get("__lw_gaps", i + 1)))), ""))
    kept = docs.columns
    out = docs.join(found, on, "left").withColumn("__lw_hit", hit).withColumn("__lw_parts", F.when(F.col("__lw_k").isNotNull(), parts)).withColumn("__lw_gaps", F.when(F.col("__lw_k").isNotNull(), gaps))
    return out.withColumn("text", F.when(F.col("__lw_k").isNull(), F.col("text")).otherwise(cut)).select(*kept)


#: Words before lower-casing: the same characters and A-Z.
ALNUM_ANY = ALNUM.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def report(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """The columns that are asked for: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    got = scan(docs, items, n)
    return got.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i : i + least(len(ws), 10) - 1], ' '))) AS w FROM b WHERE len(ws) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
