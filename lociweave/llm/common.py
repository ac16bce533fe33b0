"""What the text operators share: word patterns, the shared folder, hashing of words with NumPy.

Rows are never identified by position: where an operator must bring results back to its rows it uses
``doc_id`` together with a hash of the text, so repeated rows each get their result and two texts that
share an id stay apart.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_code

#: Java patterns. ASCII white space is all that separates SPACED words.
SPACE = r"[\x20\x09-\x0D]+"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Keys of rows (some 100 bytes each in a hash table) that are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 500_000

_tables: list[str] = []


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; ``lower`` does the same, faster, where all is ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, gap: str) -> Column:
    """The words between the gaps; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names; a local one only on a single machine that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="lociweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    _tables.append(path)
    return path


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables that this process has materialized; results that haven't been written yet need them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Writes to the shared folder and reads again: cuts the lineage so that any executor may be lost."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def rows_by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with ("left_semi") or without ("left_anti") the rows of these keys; keys: doc_id and text_hash, written. Few keys are sent to the texts, so that these need no shuffle."""
    k = keys.select(F.col("doc_id").alias("__lw_d"), F.col("text_hash").alias("__lw_k"))
    on = F.col("doc_id").eqNullSafe(F.col("__lw_d")) & (F.xxhash64("text") == F.col("__lw_k"))
    return docs.join(F.broadcast(k) if keys.count() <= BROADCAST_KEYS else k, on, how)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of jobs that are done: Spark deletes them once the driver has collected what refers to them, which it would otherwise do only when its heap is full."""
    spark.range(1).collect()  # what ran last is still referred to
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    ship_code(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: sizes the chunks by the data, not by a setting."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


# ---- NumPy side: many texts in one byte buffer -------------------------------------------------------

_rng = np.random.default_rng(20240611)
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of TABLE[byte] * BASE**position, with a leading 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, the same wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums), INVERSE)[start])


def buffer_of(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without copying; null is empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)
    at = at.astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text has its own range."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SPACED words of every text with A-Z lower-cased, and the index of each text's first word (one more at the end)."""
    data = TO_LOWER[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return range_hash(prefix_sums(data), s, e), np.searchsorted(s, offsets)
