import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def record(spark):
    """Builds records: record([{...}, ...]); tags as {key: int | float | str}."""
    from lociweave import schema as S

    def tag(v):
        if isinstance(v, int):
            return ("i", v, None, None)
        return ("f", None, v, None) if isinstance(v, float) else ("Z", None, None, v)

    def build(rows):
        base = {"qname": "r", "flag": 0, "rname_id": 0, "pos": 0, "mapq": 30, "cigar": None, "mrnm_id": None, "mpos": -1, "isize": 0, "seq": None, "qual": None, "tags": {}, "file_ordinal": 0}
        out = []
        for n, r in enumerate(rows):
            x = {**base, "rec_no": n, **r}
            x["tags"] = {k: tag(v) for k, v in x["tags"].items()}
            out.append(tuple(x[f.name] for f in S.RECORD))
        return spark.createDataFrame(out, S.RECORD)

    return build
