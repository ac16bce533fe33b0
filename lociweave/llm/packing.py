"""Token ids packed into fixed-length rows by best-fit-decreasing with a segment tree over capacities.

Texts are tokenized and packed within their partition, in groups of a bounded number of tokens: nothing is
shuffled, memory doesn't grow with the data, and a lost task is simply run again. A document longer than a row
is split into full rows and a rest, whose token ids joined give the document's again.

Defined results: a null or empty text has no tokens and no segment; every other document ends with the
end token; repeated rows are packed each; which documents share a row depends on how the input is split, so that
reruns give the same rows only for equal splits, but the same documents, segments and tokens for any; an empty table gives no rows; special tokens' strings in a text are ordinary text; other columns
play no part. Unused places at a row's end hold the end token.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LENGTH = 2048
GROUP_TOKENS = 2 << 20
MOST_VOCABULARY = 64 << 20


class Capacities:
    """A segment tree over 0..most: how many open rows have each capacity left, and the least capacity that fits."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.size + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of at least ``need``, removed from the tree."""
        i, count = self.size + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> np.ndarray:
    """The row of each segment; sizes are at most length. Equal sizes keep their order."""
    tree, out, rows = Capacities(length), np.empty(len(sizes), np.int64), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        got = tree.take(size)
        if got is None:
            got = (length, rows)
            rows += 1
        out[k] = got[1]
        if got[0] > size:
            tree.add(got[0] - size, got[1])
    return out


ROWS = pa.schema([
    ("ids", pa.binary()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32())),
])
ROWS_SQL = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, parts array<int>"


def pack_group(doc_ids: list, tokens: list[np.ndarray], length: int, end: int) -> pa.RecordBatch:
    """Packs documents' tokens. ids: little-endian, 16 bits where the end token fits, else 32."""
    dtype = "<u2" if end < 1 << 16 else "<u4"
    docs = [d for d, t in zip(doc_ids, tokens) for _ in range(-(-len(t) // length))]
    part = [p for t in tokens for p in range(-(-len(t) // length))]
    segments = [t[a : a + length] for t in tokens for a in range(0, len(t), length)]
    sizes = np.array([len(s) for s in segments], np.int64)
    row = best_fit_decreasing(sizes, length)
    order = np.lexsort((np.arange(len(row)), row))
    out = {f.name: [] for f in ROWS}
    for members in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
        ids = np.full(length, end, dtype)
        bounds = np.concatenate([[0], np.cumsum(sizes[members])])
        for k, a, b in zip(members, bounds[:-1], bounds[1:]):
            ids[a:b] = segments[k]
        out["ids"].append(ids.tobytes())
        out["n_tokens"].append(int(bounds[-1]))
        out["cu_seqlens"].append(bounds.astype(np.int32))
        out["position_resets"].append(bounds[:-1].astype(np.int32))
        out["doc_ids"].append([docs[k] for k in members])
        out["parts"].append([part[k] for k in members])
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in ROWS], schema=ROWS)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per packed row: ids (length of them), n_tokens used, cu_seqlens (bounds of the segments from 0 to n_tokens),
    position_resets (where positions start at 0 again), doc_ids and parts (which piece of the document) of each segment."""
    spark = docs.sparkSession
    ship_code(spark)
    if os.path.getsize(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"{vocabulary} is too large to send to every executor")
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.value.splitlines())}
        end = max(table.values()) + 1
        encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": end}).encode_ordinary
        dtype = np.uint16 if end < 1 << 16 else np.uint32
        ids, group, held = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                if not text:
                    continue
                x = np.array(encode(text) + [end], dtype)
                ids.append(d)
                group.append(x)
                held += len(x)
                if held >= group_tokens:
                    yield pack_group(ids, group, length, end)
                    ids, group, held = [], [], 0
        if group:
            yield pack_group(ids, group, length, end)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS_SQL)


def write_binary(packed: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Writes each partition's id matrix, cumulative segment lengths and position resets into the shared folder ``path``.

    Files: NAME.ids.bin (rows x length), NAME.cu.bin and NAME.resets.bin (32 bits each, rows one after another),
    NAME.rows.bin (64 bits: number of bounds in each row). Returns the manifest: name, rows, tokens. A file
    of a task that was run twice isn't in the manifest; the manifest's names are the data set.
    """
    base = path.removeprefix("file://")

    def run(batches):
        from pyarrow import fs

        where, inner = (fs.LocalFileSystem(), base) if "://" not in base else fs.FileSystem.from_uri(base)
        where.create_dir(inner, recursive=True)
        name, rows, tokens = uuid.uuid4().hex, 0, 0
        files = {k: where.open_output_stream(f"{inner}/{name}.{k}.bin") for k in ("ids", "cu", "resets", "rows")}
        for b in batches:
            rows += b.num_rows
            tokens += sum(b.column("n_tokens").to_pylist())
            for x in b.column("ids").to_pylist():
                files["ids"].write(x)
            cu = b.column("cu_seqlens").to_pylist()
            files["cu"].write(np.array([v for x in cu for v in x], "<i4").tobytes())
            files["resets"].write(np.array([v for x in b.column("position_resets").to_pylist() for v in x], "<i4").tobytes())
            files["rows"].write(np.array([len(x) for x in cu], "<i8").tobytes())
        for f in files.values():
            f.close()
        yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows], "tokens": [tokens]})

    from .common import materialize

    return materialize(packed.mapInArrow(run, "name string, rows long, tokens long"))
