"""The filter language: one boolean, number or string expression per record, compiled to Spark columns.

Modifiers (``set-failed`` and the like) change what later parts of the same expression see, and the record that passes.
The compiler threads that state: each part gives its value and the flag and FF columns after it, and the right side
of ``&&`` and ``||`` changes the state only where it would be evaluated. Expressions without modifiers leave the
columns as they are, so their filters reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.alignment import deaminated

_TOKEN = re.compile(r'\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_-]*)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<paren>[()])|(?P<op>[!:#$%&*+./<=>?@\\^|~-]+))')

FLAGS = {
    "paired": (S.PAIRED, True), "properly": (S.PROPER, True), "unmapped": (S.UNMAPPED, True), "mapped": (S.UNMAPPED, False), "mate-unmapped": (S.MATE_UNMAPPED, True), "mate-mapped": (S.MATE_UNMAPPED, False),
    "reversed": (S.REVERSED, True), "mate-reversed": (S.MATE_REVERSED, True), "first-mate": (S.FIRST, True), "second-mate": (S.SECOND, True), "auxillary": (S.SECONDARY, True),
    "failed": (S.FAILED, True), "good": (S.FAILED, False), "duplicate": (S.DUPLICATE, True),
}
EXTRA = {"trimmed": S.TRIMMED, "merged": S.MERGED, "alternative": S.ALTERNATIVE, "exact-index": S.EXACT_INDEX}
MODIFIERS = {"clear-failed", "set-failed", "set-trimmed", "set-merged"}
NUMBERS = {"RNAME": "rname_id", "POS": "pos", "MRNM": "mrnm_id", "RNEXT": "mrnm_id", "MPOS": "mpos", "PNEXT": "mpos", "ISIZE": "isize", "TLEN": "isize", "MAPQ": "mapq", "LENGTH": "length", "LEN": "length"}
PSEUDO = {"unknownness": ("Z0", 0), "rgquality": ("Z1", 9999), "wrongness": ("Z2", 0)}
STRINGS = {"RNAME": "_rname", "MRNM": "_mrnm", "RNEXT": "_mrnm", "library": "_library", "sample": "_sample"}


class ExpressionError(ValueError):
    """The text is no expression of the language."""


@dataclass
class Node:
    kind: str
    value: object = None
    args: list[Node] = field(default_factory=list)


def tokenize(text: str) -> list[tuple[str, str]]:
    """Operator characters are taken as long as they go on, so ``a&&!b`` has the unknown operator ``&&!``."""
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[:10]!r}")
        at = m.end()
        kind = m.lastgroup
        out.append((kind, re.sub(r"\\(.)", r"\1", m[kind][1:-1]) if kind == "str" else m[kind]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def accept(self, kind: str, *values: str) -> str | None:
        k, v = self.peek()
        if k == kind and (not values or v in values):
            self.at += 1
            return v
        return None

    def expect(self, kind: str, *values: str) -> str:
        v = self.accept(kind, *values)
        if v is None:
            raise ExpressionError(f"expected {' or '.join(values) or kind}, found {self.peek()[1] or 'the end'!r}")
        return v

    def whole(self, rule):
        out = rule()
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def boolean(self) -> Node:
        left = self.conjunction()
        while self.accept("op", "||"):
            left = Node("or", args=[left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.atom()
        while self.accept("op", "&&"):
            left = Node("and", args=[left, self.atom()])
        return left

    def attempt(self, rule) -> Node | None:
        mark = self.at
        try:
            return rule()
        except ExpressionError:
            self.at = mark
            return None

    def atom(self) -> Node:
        if self.accept("paren", "("):
            inner = self.boolean()
            self.expect("paren", ")")
            return inner
        if self.accept("op", "!") or self.accept("word", "not"):
            return Node("not", args=[self.atom()])
        word = self.accept("word", "defined", "isnum", "isstring")
        if word:
            return Node(word, self.tag_name(self.expect("word")))
        if self.accept("word", "deaminated"):
            n = self.expect("num")
            if not n.isdigit():
                raise ExpressionError(f"deaminated needs a natural number, not {n}")
            return Node("deaminated", int(n))
        return self.attempt(self.match) or self.attempt(self.comparison) or self.predicate()

    @staticmethod
    def tag_name(word: str) -> str:
        if len(word) != 2:
            raise ExpressionError(f"{word} is no tag")
        return word

    def match(self) -> Node:
        left = self.string()
        op = self.expect("op", "~", "!~")
        return Node("match", op, [left, self.string()])

    def comparison(self) -> Node:
        left = self.number()
        op = self.expect("op", "==", "<=", ">=", "!=", "<", ">")
        return Node("compare", op, [left, self.number()])

    def string(self) -> Node:
        k, v = self.peek()
        if k == "str":
            self.at += 1
            return Node("text", v)
        word = self.expect("word")
        return Node("string", word) if word in STRINGS else Node("tag-string", self.tag_name(word))

    def number(self) -> Node:
        n = self.accept("num")
        if n is not None:
            return Node("number", float(n))
        word = self.expect("word")
        if word in NUMBERS or word in PSEUDO:
            return Node("field", word)
        return Node("tag-number", self.tag_name(word))

    def predicate(self) -> Node:
        word = self.expect("word")
        if word in ("true", "false"):
            return Node("constant", word == "true")
        if word in FLAGS or word in EXTRA:
            return Node("predicate", word)
        if word in MODIFIERS:
            return Node("modifier", word)
        raise ExpressionError(f"unknown predicate {word}")

    def value(self) -> Node:
        """A string if it can be one, else a number."""
        return self.attempt(self.string) or self.number()


def parse(text: str) -> Node:
    p = _Parser(text)
    return p.whole(p.boolean)


def parse_value(text: str) -> Node:
    p = _Parser(text)
    return p.whole(p.value)


def parse_number(text: str) -> Node:
    p = _Parser(text)
    return p.whole(p.number)


def names(node: Node) -> set[str]:
    return ({node.value} if node.kind == "string" else set()).union(*map(names, node.args)) if node.args or node.kind == "string" else set()


@dataclass
class State:
    flag: Column
    ff: Column
    ff_defined: Column

    def choose(self, where: Column, new: State) -> State:
        if new is self:
            return self
        pick = lambda a, b: b if a is b else F.when(where, a).otherwise(b)
        return State(pick(new.flag, self.flag), pick(new.ff, self.ff), pick(new.ff_defined, self.ff_defined))


def start() -> State:
    return State(F.coalesce("flag", F.lit(0)), S.tag_number(F.col("tags"), "FF").cast("int"), F.coalesce(F.map_contains_key("tags", F.lit("FF")), F.lit(False)))


def _posix(pattern: Column, node: Node) -> Column:
    if node.kind == "text":
        return F.lit(re.sub(r"\[:(\w)(\w+):\]", lambda m: rf"\p{{{m[1].upper()}{m[2]}}}", node.value))
    return pattern


def compile_boolean(node: Node, s: State) -> tuple[Column, State]:
    tags = F.col("tags")
    if node.kind in ("and", "or"):
        left, after = compile_boolean(node.args[0], s)
        right, then = compile_boolean(node.args[1], after)
        return (left & right, after.choose(left, then)) if node.kind == "and" else (left | right, after.choose(~left, then))
    if node.kind == "not":
        v, after = compile_boolean(node.args[0], s)
        return ~v, after
    if node.kind == "constant":
        return F.lit(node.value), s
    if node.kind == "predicate":
        if node.value in EXTRA:
            return s.ff.bitwiseAND(EXTRA[node.value]) != 0, s
        mask, wanted = FLAGS[node.value]
        hit = s.flag.bitwiseAND(mask)
        return (hit != 0 if wanted else hit == 0), s
    if node.kind == "modifier":
        if node.value == "set-failed":
            return F.lit(True), State(s.flag.bitwiseOR(S.FAILED), s.ff, s.ff_defined)
        if node.value == "clear-failed":
            return F.lit(True), State(s.flag.bitwiseAND(~S.FAILED), s.ff, s.ff_defined)
        ff = s.ff.bitwiseOR(S.TRIMMED if node.value == "set-trimmed" else S.MERGED)
        return F.lit(True), State(s.flag, ff, s.ff_defined | (ff != s.ff))
    if node.kind in ("defined", "isnum", "isstring"):
        if node.value == "FF" and node.kind != "isstring":
            other = F.coalesce(S.tag(tags, "FF")["t"].isin("i", "f"), F.lit(False))
            return s.ff_defined & (F.lit(True) if node.kind == "defined" else other | (s.ff != 0)), s
        if node.kind == "defined":
            return F.coalesce(F.map_contains_key(tags, F.lit(node.value)), F.lit(False)), s
        return F.coalesce(S.tag(tags, node.value)["t"].isin(*(("i", "f") if node.kind == "isnum" else ("Z", "H", "A"))), F.lit(False)), s
    if node.kind == "deaminated":
        return deaminated(F.col("seq"), F.col("cigar"), S.tag_string(tags, "MD"), node.value), s
    if node.kind == "compare":
        a, b = (compile_value(x, s) for x in node.args)
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[node.value], s
    a, b = compile_value(node.args[0], s), _posix(compile_value(node.args[1], s), node.args[1])
    hit = F.regexp_like(a, b)
    return (hit if node.value == "~" else ~hit), s


def compile_value(node: Node, s: State) -> Column:
    tags = F.col("tags")
    if node.kind == "number":
        return F.lit(node.value)
    if node.kind == "text":
        return F.lit(node.value)
    if node.kind == "field":
        if node.value in PSEUDO:
            key, default = PSEUDO[node.value]
            x = S.tag(tags, key)
            return F.coalesce(F.when(x["t"] == "i", x["i"].cast("double")), F.when(x["t"] == "f", x["f"]), F.lit(float(default)))
        return F.coalesce(F.col(NUMBERS[node.value]).cast("double"), F.lit(-1.0))
    if node.kind == "tag-number":
        return s.ff.cast("double") if node.value == "FF" else S.tag_number(tags, node.value)
    if node.kind == "tag-string":
        return S.tag_string(tags, node.value)
    return F.coalesce(F.col(STRINGS[node.value]), F.lit(""))


def bind(df: DataFrame, used: set[str], refs: DataFrame | None, read_groups: DataFrame | None) -> DataFrame:
    """df with the columns that the names in use stand for; the tables of references and read groups are the header's, so small, and are sent to all tasks."""
    df = S.have(df, "flag", "rname_id", "pos", "mapq", "mrnm_id", "mpos", "isize", "seq", "cigar", "tags")
    if "length" not in df.columns:
        df = df.withColumn("length", F.col("seq_len") if "seq_len" in df.columns else F.length("seq"))
    for word, column, key in (("RNAME", "_rname", "rname_id"), ("MRNM", "_mrnm", "mrnm_id")):
        if used & ({word} | ({"RNEXT"} if word == "MRNM" else set())):
            if refs is None:
                raise ExpressionError(f"{word} as a string needs the reference names")
            df = df.join(F.broadcast(refs.select(F.col("rname_id").alias(f"{column}_id"), F.col("sq_name").alias(column))), F.col(key) == F.col(f"{column}_id"), "left").drop(f"{column}_id")
    if used & {"library", "sample"}:
        if read_groups is None:
            raise ExpressionError("library and sample need the read groups")
        whole = read_groups.where("rg_id is not null and lb is not null and sm is not null")
        df = df.join(F.broadcast(whole.select(F.col("rg_id").alias("_rg"), F.col("lb").alias("_lb"), F.col("sm").alias("_sample"))), S.tag_string(F.col("tags"), "RG") == F.col("_rg"), "left")
        own = S.tag_string(F.col("tags"), "LB")
        df = df.withColumn("_library", F.when(own != "", own).otherwise(F.coalesce("_lb", F.lit("")))).drop("_rg", "_lb")
    return df


def filter_records(df: DataFrame, expression: str | None = None, refs: DataFrame | None = None, read_groups: DataFrame | None = None, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Records for which the expression holds, as its modifiers left them; then at most ``limit``, the first by ``order`` if that is given."""
    columns = df.columns
    if expression is not None:
        node = parse(expression)
        df = bind(df, names(node), refs, read_groups)
        s = start()
        value, after = compile_boolean(node, s)
        df = df.where(value)
        if after is not s:
            tags = F.when(after.ff != s.ff, S.put_tags(F.col("tags"), {"FF": S.tag_int(after.ff)})).otherwise(F.col("tags"))
            changed = {}
            if after.flag is not s.flag:
                changed["flag"] = after.flag
            if after.ff is not s.ff:
                changed["tags"] = tags
                columns = columns if "tags" in columns else [*columns, "tags"]
            df = df.withColumns(changed)
    if limit is not None:
        df = (df.orderBy(*order) if order else df).limit(limit)
    return df.select(*columns)


def show_double(x: Column) -> Column:
    """A number as its shortest decimal with a point: 30.0."""
    return x.cast("string")


def print_values(df: DataFrame, expression: str, refs: DataFrame | None = None, read_groups: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One line per record: a string as it is, a number as a decimal."""
    node = parse_value(expression)
    df = bind(df, names(node), refs, read_groups)
    v = compile_value(node, start())
    text = v if node.kind in ("text", "string", "tag-string") else show_double(v)
    return df.select(*keep, text.alias("line"))


def sum_values(df: DataFrame, expression: str) -> DataFrame:
    """The sum of a number over all records, 0 if there are none."""
    node = parse_number(expression)
    df = bind(df, set(), None, None)
    return df.agg(F.coalesce(F.sum(compile_value(node, start())), F.lit(0.0)).alias("total"))
