import pytest

from lociweave import schema as S
from lociweave.operators.expression import ExpressionError, filter_records, parse, print_values, sum_values


def names(df):
    return sorted(r.qname for r in df.collect())


@pytest.fixture
def df(record):
    return record([
        {"qname": "a", "flag": S.FAILED, "tags": {"ZQ": "W", "XF": 1.5}},
        {"qname": "b", "flag": S.FAILED, "tags": {"ZQ": "WQ"}},
        {"qname": "c", "flag": S.PAIRED | S.PROPER, "mapq": 10, "tags": {"RG": "B0815", "FF": 2}},
        {"qname": "d", "flag": S.PAIRED, "tags": {"RG": "B0815", "LB": "own"}, "mrnm_id": 1},
    ])


def test_documented_examples(df):
    assert names(filter_records(df, "properly || not paired")) == ["a", "b", "c"]
    assert names(filter_records(df, 'ZQ ~ "^W$" || ! failed')) == ["a", "c", "d"]
    out = filter_records(df, '! failed || ZQ ~ "^W$" && clear-failed')
    assert {r.qname: r.flag & S.FAILED for r in out.collect()} == {"a": 0, "c": 0, "d": 0}
    assert sum_values(filter_records(df, 'MAPQ >= 25 && RG ~ "^B0815$"'), "1").first().total == 1.0


def test_modifiers_change_what_follows(df):
    assert names(filter_records(df, "clear-failed && good")) == ["a", "b", "c", "d"]
    assert {r.flag & S.FAILED for r in filter_records(df, "failed && (good || clear-failed)").collect()} == {0}
    assert {r.flag & S.FAILED for r in filter_records(df.where("qname = 'd'"), "good || set-failed").collect()} == {0}
    out = {r.qname: r.tags for r in filter_records(df, "set-merged && merged && defined FF && FF == 2").collect()}
    assert set(out) == {"a", "b", "c", "d"} and out["a"]["FF"].i == 2


def test_not_keeps_the_changed_state(df):
    assert {r.flag & S.FAILED for r in filter_records(df, "! clear-failed || good").collect()} == {0}


def test_tags(df):
    assert names(filter_records(df, "isnum XF && isstring ZQ")) == ["a"]
    assert names(filter_records(df, "XF > 1.2")) == ["a"]
    assert names(filter_records(df, "unknownness == 0 && rgquality == 9999 && defined LB")) == ["d"]
    assert names(filter_records(df, 'ZQ ~ "Q" && ZQ !~ "^Q"')) == ["b"]


def test_library_and_sample(df, spark):
    groups = spark.createDataFrame([("B0815", "lib", "smp"), ("half", None, "x")], S.READ_GROUPS)
    assert {r.qname: r.line for r in print_values(df, "library", read_groups=groups, keep=("qname",)).collect()} == {"a": "", "b": "", "c": "lib", "d": "own"}
    assert {r.line for r in print_values(df, "sample", read_groups=groups).collect()} == {"", "smp"}
    assert {r.line for r in print_values(df, "XF").collect()} == {""}
    assert {r.line for r in print_values(df, "POS").collect()} == {"0.0"}


def test_reference_names(df, spark):
    refs = spark.createDataFrame([(0, "chr1", 10), (1, "chrM", 10)], S.REFS)
    assert names(filter_records(df, 'RNAME ~ "^chr1" && MRNM ~ "M$"', refs=refs)) == ["d"]
    assert names(filter_records(df, "MRNM == 1")) == ["d"]


@pytest.mark.parametrize("text", ["a&&!b", "nonsense", "MAPQ", "MAPQ >", "defined ABC", "(paired", "paired paired", "deaminated 1.5", "MAPQ ~ 3", ""])
def test_errors(text):
    with pytest.raises(ExpressionError):
        parse(text)


def test_spaces_matter_between_operators():
    assert parse("paired && !failed") == parse("paired&& ! failed")


def test_limit_is_after_the_filter(df):
    assert names(filter_records(df, "paired", limit=1, order=["qname"])) == ["c"]


def test_deaminated(record):
    df = record([
        {"qname": "first", "seq": "TACGT", "cigar": "5M", "tags": {"MD": "0C4"}}, {"qname": "third", "seq": "AATGT", "cigar": "5M", "tags": {"MD": "2C2"}},
        {"qname": "last", "seq": "ACGTA", "cigar": "5M", "tags": {"MD": "4G0"}}, {"qname": "no md", "seq": "TACGT", "cigar": "5M"},
        {"qname": "clip", "seq": "GGTACGT", "cigar": "2S2M1D3M", "tags": {"MD": "0C1^A3"}},
    ])
    assert names(filter_records(df, "deaminated 1")) == ["clip", "first", "last"]
    assert names(filter_records(df, "deaminated 3")) == ["clip", "first", "last", "third"]
