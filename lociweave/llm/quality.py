"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Native: DataFrame functions only. Each document gets whole numbers (words, symbols, repeated lines and so on);
six ratios in ten-thousandths are sketched per (lang, source) as counts in logarithmic buckets of 1/64
relative width. Sketches merge by adding counts, so partial sums are formed before the shuffle, a hot source
costs no more than another, and the sketches of a language or of everything are sums of those of its sources.

The upper bound of a ratio is an upper quantile of its group's sketch, plus so many times that quantile's distance from
the median, plus a slack that only covers rounding (see RULES); lower bounds mirror it. So a source whose clean
documents are full of symbols or short lines widens its own bounds and nobody else's. The shares differ:
junk of symbols, echoes or shouting may make up a tenth of a source before it moves the bounds; repeated lines
and windows are rare in any source, hence the last hundredth. Every group's sketch has its language's
mixed in with the weight of PRIOR documents, and a language's that of all, so that small groups lean on their
language by degrees; no size switches anything.

Defined results: null and empty texts have no words and fail; null lang and source are values like any other;
repeated rows each get a result; other columns, whatever their names, play no part in the rules and are kept by
``filter_quality``; equal values all lie on one side of a bound; an empty table gives an empty result.
Equal windows are found by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, materialize, words

#: Documents' worth of the wider sketch that every narrower one has mixed in.
PRIOR = 10
BROADCAST_ROWS = 100_000
SALT = 64
#: Ratio -> upper quantile in permille, times its distance from the median, slack in ten-thousandths.
RULES = {"r_length": (900, 3, 1000), "r_symbols": (900, 3, 200), "r_lines": (990, 1, 500), "r_repeat": (990, 1, 300), "r_upper": (900, 3, 100), "r_echo": (900, 3, 150)}
#: Those with a lower bound as well, from the mirrored quantile.
LOW = {"r_length"}
RATIOS = list(RULES)
NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_echo"]


def _repeated(h: Column, s: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more; s: sorted (hash, start), null where all hashes differ."""
    same = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
    at = F.array_sort(F.transform(same, lambda e: e["i"]))
    init = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1_000_000).alias("last"))
    return F.aggregate(at, init, lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])


def measure(docs: DataFrame, window: int = 8, whole: bool = False) -> DataFrame:
    """doc_id, lang, source and the numbers of every document; with whole also row, all its columns."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*docs.columns) if whole else F.lit(None).cast("struct<x:int>")
    d = docs.select("doc_id", "lang", "source", row.alias("row"), text.alias("_t"), words(F.col("text"), SPACE).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", "source", "row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))).cast("long").alias("n_echo"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= window, F.transform(F.sequence(F.lit(1), F.size("_w") - window + 1), lambda i: F.xxhash64(F.slice("_w", i, F.lit(window))))).alias("_h"),
    )
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    return d.select(
        "doc_id", "lang", "source", "row", "n_words", "word_chars", "n_symbols", "n_upper", "n_echo",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated(F.col("_h"), F.col("_s"), window), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _ratios(d: DataFrame) -> DataFrame:
    part = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 10000 / F.greatest(F.col(b), F.lit(1)))).otherwise(0).cast("long")
    return d.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        part("word_chars", "n_words").alias("r_length"), part("n_symbols", "n_words").alias("r_symbols"), part("n_dup_lines", "n_lines").alias("r_lines"),
        part("n_repeat_words", "n_words").alias("r_repeat"), part("n_upper", "word_chars").alias("r_upper"), part("n_echo", "n_words").alias("r_echo"),
    )


def sketches(d: DataFrame) -> DataFrame:
    """lang, source, ratio, bucket, n: counts of the documents that pass the base rules; d: with ratios."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.col(r).alias("v")) for r in RATIOS]))
    v = d.where(~F.col("base_failed")).select("lang", "source", pairs.alias("p")).select("lang", "source", "p.ratio", "p.v")
    bits = F.greatest(F.length(F.bin("v")) - 7, F.lit(0))
    step = F.pow(F.lit(2.0), bits).cast("long")
    return v.withColumn("bucket", (F.floor(F.col("v") / step) * step).cast("long")).groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def _blend(own: DataFrame, prior: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """own with n in thousandths, and PRIOR documents of the prior (which has by as keys) added to every group of keys."""
    total = prior.groupBy(*by, "ratio").agg(F.sum("n").alias("_all"))
    match = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    share = prior.alias("p").join(total.alias("t"), match("p", "t", [*by, "ratio"])).select(*[F.col(f"p.{c}") for c in [*by, "ratio", "bucket"]], F.expr(f"({PRIOR} * 1000 * n) div _all").alias("n"))
    groups = own.select(*keys, "ratio").distinct()
    added = groups.alias("g").join(share.alias("s"), match("g", "s", [*by, "ratio"])).select(*[F.col(f"g.{c}") for c in keys], "s.ratio", "s.bucket", "s.n")
    thousands = own.select(*keys, "ratio", "bucket", (F.col("n") * 1000).alias("n"))
    return thousands.unionByName(added).groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def blended(sketch: DataFrame) -> DataFrame:
    """The sketches of all groups with their language's share in them. A sketch has few rows (bounded by the logarithm), however many documents."""
    every = sketch.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    language = sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    return _blend(sketch, _blend(language, every, ["lang"], []), ["lang", "source"], ["lang"])


def bounds(sketch: DataFrame) -> DataFrame:
    """k_lang, k_source, and hi_ and lo_ of each ratio: one row per group; sketch: blended."""
    group = Window.partitionBy("lang", "source", "ratio")
    c = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda permille: F.min(F.when(F.col("upto") * 1000 >= F.col("total") * permille, F.col("bucket")))
    rule = F.create_map(*[x for r, (q, _, _) in RULES.items() for x in (F.lit(r), F.lit(q))])[F.col("ratio")]
    q = c.withColumn("_q", rule).groupBy("lang", "source", "ratio").agg(at(F.col("_q")).alias("up"), at(F.lit(500)).alias("mid"), at(1000 - F.col("_q")).alias("down"))
    pick = lambda r, e: F.max(F.when(F.col("ratio") == r, e))
    return q.groupBy(F.col("lang").alias("k_lang"), F.col("source").alias("k_source")).agg(
        *[pick(r, F.col("up") + times * (F.col("up") - F.col("mid")) + slack).alias(f"hi_{r}") for r, (_, times, slack) in RULES.items()],
        *[pick(r, F.col("down") - RULES[r][1] * (F.col("mid") - F.col("down")) - RULES[r][2]).alias(f"lo_{r}") for r in LOW],
    )


def judge(docs: DataFrame, window: int = 8, whole: bool = False) -> DataFrame:
    """doc_id, row (if whole), numbers, base_failed and kept of every document. Numbers are written once, with the rows if they are wanted; texts are neither read twice nor shuffled."""
    d = _ratios(materialize(measure(docs, window, whole)))
    b = materialize(bounds(blended(materialize(sketches(d)))))
    if b.count() <= BROADCAST_ROWS:
        d = d.join(F.broadcast(b), F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left")
    else:  # a third of all rows may be of one group: its rows are dealt out among SALT copies of its bounds
        salted = b.withColumn("k_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        d = d.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)).cast("int"))
        d = d.join(salted, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("_salt") == F.col("k_salt")), "left")
    fine = F.lit(True)
    for r in RATIOS:
        fine = fine & (F.col(r) <= F.col(f"hi_{r}"))
        if r in LOW:
            fine = fine & (F.col(r) >= F.col(f"lo_{r}"))
    # A group without bounds has no document that passes the base rules.
    return d.select("doc_id", *(["row"] if whole else []), *NUMBERS, "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject, all columns kept."""
    return judge(docs, whole=True).where("kept").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS BIGINT) AS n_echo,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars * 10000 // n_words ELSE 0 END AS r_length, CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS r_symbols,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS r_lines, CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS r_repeat,
  CASE WHEN word_chars > 0 THEN n_upper * 10000 // word_chars ELSE 0 END AS r_upper,
  CASE WHEN n_words > 0 THEN n_echo * 10000 // n_words ELSE 0 END AS r_echo FROM m),
v AS (SELECT lang, source, 'r_length' AS ratio, r_length AS v FROM r WHERE NOT base_failed UNION ALL SELECT lang, source, 'r_symbols', r_symbols FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'r_lines', r_lines FROM r WHERE NOT base_failed UNION ALL SELECT lang, source, 'r_repeat', r_repeat FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'r_upper', r_upper FROM r WHERE NOT base_failed UNION ALL SELECT lang, source, 'r_echo', r_echo FROM r WHERE NOT base_failed),
k AS (SELECT lang, source, ratio, v // CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) * CAST(pow(2, greatest(length(bin(v)) - 7, 0)) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL),
e AS (SELECT ratio, bucket, CAST(10000 * sum(n) AS BIGINT) // CAST(sum(sum(n)) OVER (PARTITION BY ratio) AS BIGINT) AS n FROM k GROUP BY ratio, bucket),
l AS (SELECT lang, ratio, bucket, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, ratio, bucket, 1000 * n AS n FROM k UNION ALL SELECT g.lang, ratio, bucket, n FROM e, (SELECT DISTINCT lang FROM k) g) GROUP BY ALL),
ls AS (SELECT lang, ratio, bucket, CAST(10000 * n AS BIGINT) // CAST(sum(n) OVER (PARTITION BY lang, ratio) AS BIGINT) AS n FROM l),
b AS (SELECT lang, source, ratio, bucket, sum(n) AS n FROM (SELECT lang, source, ratio, bucket, 1000 * n AS n FROM k UNION ALL
  SELECT g.lang, g.source, ratio, bucket, n FROM ls JOIN (SELECT DISTINCT lang, source FROM k) g ON g.lang IS NOT DISTINCT FROM ls.lang) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total,
  CASE WHEN ratio IN ('r_lines', 'r_repeat') THEN 990 ELSE 900 END AS q, CASE WHEN ratio IN ('r_lines', 'r_repeat') THEN 1 ELSE 3 END AS times,
  CASE ratio WHEN 'r_length' THEN 1000 WHEN 'r_symbols' THEN 200 WHEN 'r_lines' THEN 500 WHEN 'r_repeat' THEN 300 WHEN 'r_upper' THEN 100 ELSE 150 END AS slack FROM b),
f AS (SELECT lang, source, ratio, times, slack, min(bucket) FILTER (1000 * upto >= q * total) AS up, min(bucket) FILTER (2 * upto >= total) AS mid, min(bucket) FILTER (1000 * upto >= (1000 - q) * total) AS down FROM u GROUP BY ALL),
p AS (SELECT r.doc_id, x.ratio, up + times * (up - mid) + slack AS hi, down - times * (mid - down) - slack AS lo,
  CASE x.ratio WHEN 'r_length' THEN r_length WHEN 'r_symbols' THEN r_symbols WHEN 'r_lines' THEN r_lines WHEN 'r_repeat' THEN r_repeat WHEN 'r_upper' THEN r_upper ELSE r_echo END AS v
  FROM r CROSS JOIN (SELECT unnest(['r_length', 'r_symbols', 'r_lines', 'r_repeat', 'r_upper', 'r_echo']) AS ratio) x
  LEFT JOIN f ON f.ratio = x.ratio AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source),
ok AS (SELECT doc_id, bool_and(coalesce(v <= hi AND (ratio <> 'r_length' OR v >= lo), false)) AS fine FROM p GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM r JOIN ok USING (doc_id)
"""
