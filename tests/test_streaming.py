import datetime as dt

import pytest

from lociweave.streaming import records

SCHEMA = "qname string, flag int, pos int, library string, ts timestamp"


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    """Two batches, and a late record that moves the watermark."""
    src = str(tmp_path / "in")
    batches = [[("a", 0x41, 5, "l", at(0)), ("w", 0x41, 6, "l", at(1))], [("a", 0x81, 9, "l", at(2)), ("a2", 0x41, 5, "l", at(3))], [("z", 0x41, 1, "l", at(1000))], [("y", 0x41, 1, "l", at(2000))]]
    for n, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"{src}/b={n}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(src)


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_mates(stream):
    got = sorted((r.qname, r.kind, r.first_pos, r.second_pos) for r in run(records.mate(stream, "ts", "10 seconds"), "mates"))
    assert ("a", "pair", 5, 9) in got and ("w", "widow", 6, None) in got


def test_duplicates(stream):
    got = [r.pos for r in run(records.drop_duplicates(stream.where("ts < '2024-01-01 00:10:00'"), ["pos"], "ts", "60 seconds"), "dups")]
    assert sorted(got) == [5, 6, 9]


def test_joined_mates(stream):
    got = [(r.a_qname, r.a_pos, r.b_pos) for r in run(records.join_mates(stream, "ts", "10 seconds"), "joined")]
    assert got == [("a", 5, 9)]


def test_counts_by_library(stream):
    """Windows are given out when the watermark has passed them."""
    got = {(r.window.start, r.library): r.n for r in run(records.count_by_library(stream, "ts", "10 seconds", "1 minute"), "counted")}
    assert got == {(at(0), "l"): 4, (at(960), "l"): 1}
