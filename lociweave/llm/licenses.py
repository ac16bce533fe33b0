"""Licence scan by canonical digests.

Native: DataFrame functions only. A text is normalised (case, punctuation, white space, copyright lines,
equivalent spellings) and the SHA-256 of all of it is looked up in the digests of known licences; each line's
digest is looked up among known notices too, since documents name their licence in a line of its own. A line that
says that something is under a licence goes by what follows (see PHRASE), so that one digest serves every wording.

Known are the texts and names in ``license_texts``, and the digests in ``license_digests`` of whole licences, with and without the
appendices that tell how to apply them: Apache 2.0, Artistic 1.0, BSD, CC0, GFDL 1.2 and 1.3, GPL 1 to 3, LGPL 2 to 3, MPL 1.1 and
2.0, besides MIT, BSD 2 and 3, ISC, 0BSD, Zlib, Unlicense and Boost. Other licences come as a table of texts (``known``).
The digests are a constant list, so the join broadcasts it; a table of more than BROADCAST_ROWS texts is
joined by a shuffle in which hot digests are dealt out. Only matches and one row per text are shuffled else.

Defined results: null and empty texts have the digest of the empty string and match nothing; a text or
line with several known ids has the least; repeated rows each get a result; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, materialize, rows_by_key
from .license_digests import DIGESTS
from .license_texts import KNOWN

BROADCAST_ROWS = 100_000
SALT = 16

#: A copyright line: a mark or a year follows the word, so that "copyright holders" in a sentence stays. On lower-cased text.
COPYRIGHT = r"(?:^|\n)[\x20\t*#/;-]*(?:copyright[\x20\t]*(?:\(c\)|©|[0-9]{4})|\(c\)[\x20\t]*[0-9]{4}|©)[^\n]*"
RESERVED = r"(?:^|\n)[\x20\t*#/;-]*all rights reserved\.?[\x20\t*/]*(?:\n|$)"
#: Spellings that count as equal, as words of the normalised text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "acknowledgement": "acknowledgment", "merchantibility": "merchantability", "favour": "favor", "https": "http", "noncommercial": "non commercial", "centre": "center", "judgement": "judgment"}


#: What a line says of the licence it goes on to name; on flattened text.
PHRASE = (
    r"^(?:(?:(?:this|the|our|all) (?:work|works|project|software|code|source code|document|documentation|text|texts|content|contents|file|files|program|library|repository|article|articles|dataset|data|page|site|package) (?:is|are) )?"
    r"(?:dual )?(?:licensed|released|distributed|published|available|made available|provided|shared) under (?:the terms of )?(?:the |an |a )?|spdx license identifier |license )"
)


def flatten(text: Column) -> Column:
    """Words of lower-cased text, one space between them, equivalent spellings made one."""
    t = F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’„«»–—©]+", "  ")  # two, so that neighbours don't share one
    t = F.concat(F.lit(" "), F.trim(t), F.lit(" "))
    for a, b in SPELLINGS.items():
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    low = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    return flatten(F.regexp_replace(F.regexp_replace(low, COPYRIGHT, "\n"), RESERVED, "\n"))


def _digests(raw: DataFrame) -> DataFrame:
    low = flatten(ascii_lower(F.col("text")))
    what = F.when(F.col("kind") == "text", canonical(F.col("text"))).otherwise(low)
    return raw.select("kind", F.sha2(what, 256).alias("digest"), "license_id")


def known_digests(spark, known: DataFrame | None = None) -> DataFrame:
    """kind, digest, license_id, each digest once; known: further license_id, kind ("text", "notice", "name"), text."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = lambda x, names: spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in x)} AS t({names})")
    d = _digests(rows(KNOWN, "license_id, kind, text")).unionByName(rows(DIGESTS, "license_id, kind, digest"))
    if known is not None:
        d = d.unionByName(_digests(known.select("license_id", "kind", "text")))
    return d.groupBy("kind", "digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_sha256 (of the normalised text), license (of the whole text, null if none), notices (sorted ids of lines), n_notices (lines), licensed."""
    low = F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), r"\r\n?", "\n")
    d = docs.select("doc_id", F.xxhash64("text").alias("_key"), canonical(F.col("text")).alias("_canon"), F.split(low, "\n").alias("_lines"))
    units = d.select("doc_id", "_key", F.posexplode(F.concat(F.array(F.col("_canon")), F.filter(F.transform("_lines", flatten), lambda x: x != ""))).alias("_at", "_unit"))
    name = (F.col("_at") > 0) & F.col("_unit").rlike(PHRASE)
    kind = F.when(F.col("_at") == 0, "text").when(name, "name").otherwise("notice")
    units = units.select("doc_id", "_key", "_at", kind.alias("_k"), F.sha2(F.when(name, F.regexp_replace("_unit", PHRASE, "")).otherwise(F.col("_unit")), 256).alias("_digest"))
    k = known_digests(docs.sparkSession, known).select(F.col("kind").alias("_kind"), F.col("digest").alias("_d"), "license_id")
    on = (F.col("_digest") == F.col("_d")) & (F.col("_k") == F.col("_kind"))
    if known is None or known.count() <= BROADCAST_ROWS:
        hits = units.join(F.broadcast(k), on, "left")
    else:
        k = k.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = units.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_key", "_at"), F.lit(SALT)).cast("int")).join(k, on & (F.col("_salt") == F.col("_s")), "left")
    hits = hits.where("_at = 0 or license_id is not null")
    got = hits.groupBy("doc_id", "_key").agg(
        F.max(F.when(F.col("_at") == 0, F.col("_digest"))).alias("text_sha256"),
        F.max(F.when(F.col("_at") == 0, F.col("license_id"))).alias("license"),
        F.array_sort(F.collect_set(F.when(F.col("_at") > 0, F.col("license_id")))).alias("_ids"),
        F.count(F.when(F.col("_at") > 0, 1)).alias("_n"),
        F.count(F.when(F.col("_at") == 0, 1)).alias("_rows"),
    )
    got = got.select("doc_id", "text_sha256", "license", F.array_join("_ids", ",").alias("notices"), F.floor(F.col("_n") / F.col("_rows")).cast("long").alias("n_notices"), (F.col("license").isNotNull() | (F.col("_n") > 0)).alias("licensed"), "_rows")
    return got.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_rows").cast("int")))).drop("_copy", "_rows")


def filter_licenses(docs: DataFrame, denied: list[str], known: DataFrame | None = None) -> DataFrame:
    """docs without those whose text or notices carry a denied licence id; all columns kept."""
    if not denied:
        return docs
    found = scan_keys(docs, known).where(F.arrays_overlap("ids", F.array(*map(F.lit, denied)))).select("doc_id", "text_hash").distinct()
    return rows_by_key(docs, materialize(found), "left_anti")


def scan_keys(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash and all licence ids of distinct texts."""
    one = docs.select("doc_id", "text").distinct()
    keyed = one.select(F.struct("doc_id", F.xxhash64("text").alias("k")).alias("doc_id"), "text")
    s = scan(keyed, known)
    ids = F.concat(F.when(F.col("license").isNotNull(), F.array("license")).otherwise(F.array().cast("array<string>")), F.split("notices", ","))
    return s.select("doc_id.doc_id", F.col("doc_id.k").alias("text_hash"), ids.alias("ids"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_flat(x: str) -> str:
    x = f"' ' || trim(regexp_replace({x}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F“”‘’„«»–—©]+', '  ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        x = f"replace({x}, ' {a} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({x}, '  ', ' '))"


def _sql_low(x: str) -> str:
    return f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '\\r\\n?', chr(10), 'g')"


def _sql_canon(x: str) -> str:
    cut = lambda e, p: f"regexp_replace({e}, {_q(p)}, chr(10), 'g')"
    return _sql_flat(cut(cut(_sql_low(x), COPYRIGHT), RESERVED))


ORACLE = f"""
WITH known(license_id, kind, text) AS (VALUES {", ".join(f"({_q(i)}, {_q(k)}, {_q(t)})" for i, k, t in KNOWN)}),
digests(license_id, kind, digest) AS (VALUES {", ".join(f"({_q(i)}, {_q(k)}, {_q(t)})" for i, k, t in DIGESTS)}),
kd AS (SELECT kind, digest, min(license_id) AS license_id FROM (SELECT license_id, kind, sha256(CASE kind WHEN 'text' THEN {_sql_canon("text")} ELSE {_sql_flat(_sql_low("text"))} END) AS digest FROM known UNION ALL FROM digests) GROUP BY ALL),
d AS (SELECT doc_id, sha256({_sql_canon("text")}) AS digest, list_transform(string_split({_sql_low("text")}, chr(10)), lambda x: {_sql_flat("x")}) AS ls FROM documents),
l AS (SELECT doc_id, CASE WHEN regexp_matches(x, {_q(PHRASE)}) THEN 'name' ELSE 'notice' END AS kind, sha256(regexp_replace(x, {_q(PHRASE)}, '')) AS digest FROM (SELECT doc_id, unnest(ls) AS x FROM d) WHERE x <> ''),
n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n FROM l JOIN kd USING (kind, digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest AS text_sha256, kd.license_id AS license, coalesce(n.notices, '') AS notices, CAST(coalesce(n.n, 0) AS BIGINT) AS n_notices, kd.license_id IS NOT NULL OR n.n IS NOT NULL AS licensed
FROM d LEFT JOIN kd ON kd.kind = 'text' AND kd.digest = d.digest LEFT JOIN n USING (doc_id)
"""
