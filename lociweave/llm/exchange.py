"""Questions from chunks of documents to a table that is too large for any one task, and the answers.

Documents are put into chunks of bounded size by a hash of their id and text. Each chunk asks about each distinct key
once, in one packed message per bucket of the key space; a bucket sees the messages of all chunks and packs
an answer for each. A key that is in most documents thus costs one entry per chunk, not one per row.

Chunks and buckets both grow with the data, but the rows that are shuffled don't grow with their product: a Route
numbers both in digits of at most MOST and sends in as many hops. In each hop a task holds what sources of one group have for
destinations of one group; it gathers the bundles of the sources that differ in one digit and splits them by the destinations'
next one. So every task handles about a chunk's worth, rows are MOST times the chunks per hop at most, and hops grow
with the logarithm: one up to MOST chunks, two up to MOST squared. Messages without entries aren't sent, so there are no more than entries.

Defined results: rows equal in id and text lie in one chunk, in the order in which they come; without documents there are no messages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

CHUNK_BYTES = 4 << 20
MOST = 256


def parts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[int, int]:
    """Chunks and buckets for these documents. A bucket sees about two chunks' worth of keys."""
    chunks = max(1, -(-text_bytes(docs) // chunk_bytes))
    return chunks, -(-chunks // 2)


def chunk_of(n: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


BUNDLES = pa.schema([("p", pa.int32()), ("q", pa.int32()), ("bundle", pa.binary())])
BUNDLES_SQL = "p int, q int, bundle binary"


@dataclass(frozen=True)
class Route:
    """How tables with the columns src and dst get from the tasks of src to those of dst: hops of radix digits."""

    src: str
    dst: str
    hops: int
    radix: int

    @classmethod
    def of(cls, src: str, dst: str, n: int, most: int | None = None) -> Route:
        most = most or MOST
        hops = 1
        while most**hops < n:
            hops += 1
        radix = 1
        while radix**hops < n:
            radix += 1
        return cls(src, dst, hops, radix)

    def back(self) -> Route:
        return Route(self.dst, self.src, self.hops, self.radix)

    def bundle(self, t: pa.Table, hop: int = 1) -> pa.Table:
        """The table's rows for this hop: one for each group of destinations that has any."""
        t = t.combine_chunks()
        p = t[self.dst].to_numpy() // self.radix ** (self.hops - hop)
        q = t[self.src].to_numpy() // self.radix**hop
        order = np.lexsort((q, p))
        p, q = p[order], q[order]
        start = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])) if len(p) else np.zeros(0, np.int64)
        sorted_ = t.take(order)
        out = []
        for i, j in zip(start, np.append(start[1:], len(p))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(sorted_.slice(i, j - i))
            out.append(sink.getvalue().to_pybytes())
        return pa.Table.from_arrays([pa.array(p[start], pa.int32()), pa.array(q[start], pa.int32()), pa.array(out, pa.binary())], schema=BUNDLES)

    def relay(self, bundles: DataFrame) -> DataFrame:
        """Bundles of the first hop after the last one: p is the destination."""

        def step(hop: int):
            return lambda t: self.bundle(opened(t), hop)

        for hop in range(2, self.hops + 1):
            bundles = bundles.groupBy("p", "q").applyInArrow(step(hop), BUNDLES_SQL)
        return bundles


def opened(t: pa.Table) -> pa.Table:
    """The rows in all bundles; t has some."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in t["bundle"]])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash: equal ranges of its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray, deltas: bool = False) -> bytes:
    """Arrays in one message; each is compressed by byte planes. With deltas the first array is sorted and stored by differences."""
    out = [len(arrays).to_bytes(2, "little")]
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        if deltas and k == 0 and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        kind = a.dtype.str.encode().ljust(4)
        out += [kind, len(a).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(out)


def unpack(message: bytes, deltas: bool = False) -> list[np.ndarray]:
    n, at, out = int.from_bytes(message[:2], "little"), 2, []
    for k in range(n):
        dtype = np.dtype(message[at : at + 4].strip().decode())
        rows, size = int.from_bytes(message[at + 4 : at + 12], "little"), int.from_bytes(message[at + 12 : at + 20], "little")
        at += 20
        if rows:
            raw = pa.decompress(message[at : at + size], decompressed_size=rows * dtype.itemsize, codec="zstd", asbytes=True)
            a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, rows).T).view(dtype).reshape(rows)
            if deltas and k == 0:
                a = np.cumsum(a, dtype=dtype)
        else:
            a = np.zeros(0, dtype)
        out.append(a)
        at += size
    return out


def split(buckets: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each bucket in rows sorted by bucket."""
    return np.searchsorted(buckets, np.arange(n + 1))


def table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
