"""Streams of records: duplicates within a watermark, mates that arrive apart, running counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship_code


def drop_duplicates(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first record of each key; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def count_by_library(stream: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), "library").agg(F.count("*").alias("n"))


def join_mates(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """First and second mates of a name that arrive within ``delay`` of each other."""
    s = stream.withWatermark(time, delay)
    side = lambda mask, p: s.where(F.col("flag").bitwiseAND(mask) != 0).select(*[F.col(c).alias(f"{p}_{c}") for c in stream.columns])
    a, b = side(0x40, "a"), side(0x80, "b")
    near = (F.col(f"b_{time}") >= F.col(f"a_{time}") - F.expr(f"interval {delay}")) & (F.col(f"b_{time}") <= F.col(f"a_{time}") + F.expr(f"interval {delay}"))
    return a.join(b, (F.col("a_qname") == F.col("b_qname")) & near)


_MATED = T.StructType([T.StructField("qname", T.StringType()), T.StructField("first_pos", T.IntegerType()), T.StructField("second_pos", T.IntegerType()), T.StructField("kind", T.StringType())])
_WAITING = T.StructType([T.StructField("flag", T.IntegerType()), T.StructField("pos", T.IntegerType())])


def mate(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """qname, first_pos, second_pos, kind: pairs as soon as both mates are there, widows when the watermark has passed them."""

    ship_code(stream.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            flag, pos = state.get
            state.remove()
            yield pd.DataFrame({"qname": [key[0]], "first_pos": [pos if flag & 0x40 else None], "second_pos": [None if flag & 0x40 else pos], "kind": ["widow"]}, columns=_MATED.names).astype({"first_pos": "Int32", "second_pos": "Int32"})
            return
        held = state.get if state.exists else None
        out, latest = [], None
        for b in batches:
            for flag, pos, t in zip(b["flag"], b["pos"], b[time]):
                latest = t if latest is None else max(latest, t)
                if held is None:
                    held = (int(flag), int(pos))
                else:
                    a, c = (held[1], int(pos)) if held[0] & 0x40 else (int(pos), held[1])
                    out.append((key[0], a, c, "pair"))
                    held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            at = int(latest.timestamp() * 1000)
            state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=_MATED.names).astype({"first_pos": "Int32", "second_pos": "Int32"})

    s = stream.withWatermark(time, delay).select("qname", "flag", "pos", time)
    return s.groupBy("qname").applyInPandasWithState(step, _MATED, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
