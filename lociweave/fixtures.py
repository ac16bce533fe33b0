"""Records, regions, annotations and alignments derived from the driver's tables by SQL that runs unchanged in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "reads": """
WITH raw AS (
  SELECT l_orderkey, l_suppkey, l_partkey, l_returnflag, CAST(l_quantity AS INT) AS qty, CAST(round(l_tax * 100) AS INT) AS tax100, CAST(round(l_discount * 100) AS INT) AS disc100,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS ord
  FROM lineitem),
base AS (
  SELECT concat('q', l_orderkey, '_', CAST(floor((ord - 1) / 2.0) AS INT)) AS qname,
    CAST((CASE WHEN l_orderkey % 4 <> 0 THEN 1 + CASE WHEN ord % 2 = 1 THEN 64 ELSE 128 END ELSE 0 END) + (CASE WHEN qty <= 3 THEN 4 ELSE 0 END)
      + (CASE WHEN l_orderkey % 8 IN (1, 2, 3, 5) THEN 2 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END) + (CASE WHEN tax100 >= 7 THEN 512 ELSE 0 END) AS INT) AS flag,
    CAST(l_suppkey % 5 AS INT) AS rname_id, CAST(l_partkey AS INT) AS pos, qty AS mapq, CAST(30 + l_suppkey % 40 AS INT) AS seq_len, concat('RG', l_suppkey % 3) AS rg, disc100 AS xm, tax100 AS xo, ord
  FROM raw)
SELECT base.*,
  CASE WHEN flag % 2 = 0 THEN NULL WHEN xm = 10 THEN 0 WHEN ord % 2 = 1 THEN lead(rname_id) OVER w ELSE lag(rname_id) OVER w END AS mrnm_id,
  CASE WHEN flag % 2 = 0 THEN -1 WHEN xm = 9 THEN 0 WHEN ord % 2 = 1 THEN coalesce(lead(pos) OVER w, -1) ELSE coalesce(lag(pos) OVER w, -1) END AS mpos
FROM base WINDOW w AS (PARTITION BY qname ORDER BY ord)""",
    "sequences": """
SELECT reads.*, translate(substr(md5(concat(qname, '/', ord)), 1, 20), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, translate(substr(md5(concat(ord, '.', qname)), 1, 20), '0123456789abcdef', '##+-.5:=?@BDFGHI') AS qual,
  CASE WHEN xm % 5 = 0 THEN '12M2I6M' ELSE '20M' END AS cigar FROM reads""",
    "regions": """
SELECT concat('o', o_orderkey) AS name, CAST(o_custkey % 5 AS INT) AS chrom, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '*' END AS strand,
  CAST((o_orderkey * 5) % 2000000000 AS INT) AS r_start, CAST((o_orderkey * 5) % 2000000000 + 1 + o_orderkey % 50 AS INT) AS r_end
FROM orders""",
    "annotations": """
SELECT p_brand AS name, CAST(p_partkey % 5 AS INT) AS chrom, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand,
  CAST((p_partkey * 37) % 2000000000 AS INT) AS a_start, CAST((p_partkey * 37) % 2000000000 + p_size AS INT) AS a_end, p_partkey AS line_no
FROM part""",
    "alignments": """
SELECT concat('a', o_orderkey) AS qname, f.ordinal AS file_ordinal, CAST((o_orderkey + f.ordinal) % 7 = 0 AS INT) AS unmapped, CAST(o_orderkey % 61 AS INT) AS mapq,
  CAST((o_orderkey * 7 + f.ordinal * 3) % 6 AS INT) AS xm, CAST((o_orderkey + f.ordinal) % 3 AS INT) AS xo, CAST((o_orderkey * 5 + f.ordinal) % 2 AS INT) AS xg
FROM orders CROSS JOIN (SELECT 1 AS ordinal UNION ALL SELECT 2 UNION ALL SELECT 3) f""",
    "refs": "SELECT * FROM (VALUES (0, 'chr1', 250000000), (1, 'chr2', 250000000), (2, 'chr3', 250000000), (3, 'chrM', 250000000), (4, 'chrX', 250000000)) AS t(rname_id, sq_name, sq_length)",
    "read_groups": "SELECT * FROM (VALUES ('RG0', 'libA', 's1'), ('RG1', 'libB', 's1'), ('RG2', NULL, 's2')) AS t(rg_id, lb, sm)",
}


def _one_window(sql: str) -> str:
    """The view reads with one window: a name belongs to one order, so that the mate is the line before or behind in the order, and no second shuffle by name is needed."""
    order = re.search(r"PARTITION BY l_orderkey ORDER BY [^)]*", sql)[0]
    both = ", ".join(f"{f}({c}) OVER l AS {f}_{c}" for f in ("lead", "lag") for c in ("l_suppkey", "l_partkey"))
    sql = sql.replace(f"OVER ({order})", "OVER l").replace("AS ord\n  FROM lineitem)", f"AS ord, {both}\n  FROM lineitem WINDOW l AS ({order}))")
    sql = sql.replace("ord\n  FROM raw)", "ord, " + ", ".join(f"CAST(CASE WHEN ord % 2 = 1 THEN lead_{c} ELSE lag_{c} END{m} AS INT) AS {n}" for c, m, n in (("l_suppkey", " % 5", "other_id"), ("l_partkey", "", "other_pos"))) + "\n  FROM raw)")
    sql = sql.replace("WHEN ord % 2 = 1 THEN lead(rname_id) OVER w ELSE lag(rname_id) OVER w END", "ELSE other_id END").replace("WHEN ord % 2 = 1 THEN coalesce(lead(pos) OVER w, -1) ELSE coalesce(lag(pos) OVER w, -1) END", "ELSE coalesce(other_pos, -1) END")
    return sql.replace("SELECT base.*,", "SELECT base.* EXCEPT (other_id, other_pos),").replace("FROM base WINDOW w AS (PARTITION BY qname ORDER BY ord)", "FROM base")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reads = _one_window(VIEWS["reads"])
    text = reads if name == "reads" else VIEWS[name].replace("FROM reads", f"FROM ({reads}) AS reads")
    return spark.sql(re.sub(r"(?<=FROM )(lineitem|orders|part)\b", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def records(spark: SparkSession, sf_dir: str, sequences: bool = False) -> DataFrame:
    """reads with the tags and columns of a record, and with sequences if asked for."""
    more = ["seq", "qual", "cigar"] if sequences else []
    return view(spark, sf_dir, "sequences" if sequences else "reads").selectExpr(
        *more, "qname", "flag", "rname_id", "pos", "mapq", "mrnm_id", "mpos", "0 as isize", "seq_len", "rg", "ord", "cast(ord as bigint) as rec_no", "0 as file_ordinal", "xm", "xo",
        """map('RG', named_struct('t', 'Z', 'i', cast(null as bigint), 'f', cast(null as double), 's', rg), 'XM', named_struct('t', 'i', 'i', cast(xm as bigint), 'f', cast(null as double), 's', cast(null as string)),
        'XO', named_struct('t', 'i', 'i', cast(xo as bigint), 'f', cast(null as double), 's', cast(null as string))) as tags""",
    )


def with_views(sql: str) -> str:
    """SQL with the views that it names as common table expressions."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql) or n == "reads" and "sequences" in sql]
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().startswith(head):
            return f"{head}{views}, {sql.lstrip()[len(head) :]}"
    return f"WITH {views} {sql}"
