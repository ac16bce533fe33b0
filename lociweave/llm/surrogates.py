"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

1. Texts are scanned for e-mail addresses, telephone, card, account, passport and social security numbers, IP addresses,
   birth dates, secrets and names of persons (after a title, or with a known given name). An entity is its type and normal form
   (case, separators, country code and number format removed), so that all its mentions, in whatever format, get one
   surrogate: coreference holds. Names go by their parts: a family name has one surrogate wherever it stands,
   alone after a title or after a given name; a given name's gender is that of its list or, for one that is in none, what
   most titles in the corpus say.
2. A surrogate is a keyed permutation (a Feistel network over HMAC-SHA256 that walks cycles) of the values of one format: digits
   for digits, letters for letters of the same script, addresses of the same kind of network, valid dates and check digits for
   valid ones. A permutation keeps different entities apart whatever their number, so nothing can run out. Names are
   drawn from lists by gender and script.
3. The distinct entities are checked: two name parts that drew one name (the later draws a compound of one more name;
   those grow faster than the corpus, so this ends), and surrogates that are other real entities, for which TRIES other
   permutations are tried, never taking a value that the first permutation gives to any entity; where all fail, as in a format with
   most of its values in the corpus, the first one stands: distinct, if not unheard of. Only entities that need more than
   their text says are joined back: a table of up to BROADCAST_ROWS of them is sent to all tasks, a larger one joins
   the documents' entities.

Defined results: null stays null with no entities; a text without entities is returned as it is; repeated rows get
equal results; overlapping finds go to the earlier, then to the longer; an empty table gives an empty one;
``pseudonymize`` keeps all other columns, whatever their names. Names in no list and without a title aren't found.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import hmac
import ipaddress
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_arrow, materialize, ship_code
from .names import FAMILY, GIVEN, TITLES

BROADCAST_ROWS = 100_000
TRIES = 3

_title = "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=len, reverse=True))
_UPPER = r"[^\W\d_a-zà-öø-ÿα-ωάέήίόύώа-яё]"
_CAP = rf"(?:(?:[dDlL]['’]|O['’]|Mc|Mac)?{_UPPER}[^\W\d_]+(?:[-’']{_UPPER}[^\W\d_]+)*)"
_WORD = rf"(?:{_CAP}|{_UPPER}\.)"
_PARTICLE = r"(?:(?:de la|de los|del|de|da|dos|di|du|van der|van den|van|von der|von|zu|bin|al|ter|ten|la|le) )"
_FIND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{5,}|(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![\w-])"
    r"|(?i:(?<![a-z])(?:token|secret|api[_-]?key|apikey|access[_-]?key|password|passwd|pwd)[ \t]*[=:][ \t]*(?:[\"'](?P<quoted>[^\"'\s]{6,})(?=[\"'])|(?P<bare>(?=[^\s]*\d)[A-Za-z0-9_+/=.-]*[A-Za-z0-9_+/=-]{6})(?![A-Za-z0-9]))))"
    r"|(?i:(?<![a-z])passport(?: (?:no|number|nr))?\.?[ \t]*[:#]?[ \t]*(?P<passport>(?=[a-z]*\d)[a-z0-9]{6,9})(?![\w-]))"
    r"|(?i:(?<![a-z])(?:born(?: on)?|date of birth|birth ?date|dob)[ \t]*:?[ \t]*(?P<birth>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?![\w]|[./-]\d))"
    r"|(?i:(?<![a-z])(?:tel|telephone|phone|mobile|cell|fax|call)(?: (?:no|number))?\.?[ \t]*:?[ \t]*(?P<called>\d{10}|\d{3} \d{3} \d{4})(?![\w-]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:]|\.\d))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\w-])|(?<![\w.-])3[47]\d{2}(?P<sep2>[ -])\d{6}(?P=sep2)\d{5}(?![\w-])|(?<![\w.-])\d{13,19}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:(?:\+|00)\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}|(?:\+|00[ .-]?)\d{1,3}[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4})(?![\w-]|\.\d))"
)
#: The words of a name in a row; the first of them has been recognised.
_RUN = re.compile(rf"{_WORD}(?: {_PARTICLE}?{_WORD}){{0,3}}(?!\w)")
_TITLED = re.compile(rf"(?P<title>(?i:{_title})\.?)[ \t]+(?={_UPPER})")
#: Without one of these a line has no entity but names; the long pattern is for lines with them only.
_ANCHOR = re.compile(r"[0-9@=:]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞΑ-ΫΆ-ΏЀ-Я]\w*")
_PARTS = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?")
_GENDER = {n.lower(): g for (g, _), ns in GIVEN.items() for n in ns}
_TITLE_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_STARTS = set(_GENDER) | set(_TITLE_GENDER)
_PARTICLES = set("de la los del da dos di du van der den von zu bin al ter ten le".split())
#: Capitalised words that begin a sentence or a heading and never go on a name.
_STOP = set("the a an in on at and but or he she it we they i you this that from for with to of by as is was are were will has had el los las y der die das und le les et un une il est er sie es wir ist war my your his her our their when if so not no yes".split())
#: Calling codes, for the national form of a telephone number.
_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_KINDS = ("email", "quoted", "bare", "secret", "passport", "birth", "called", "iban", "ip6", "ip", "ssn", "card", "phone")


def _script(s: str) -> str:
    return "cyrillic" if re.search(r"[Ѐ-ӿ]", s) else "greek" if re.search(r"[Ͱ-Ͽἀ-῿]", s) else "latin"


def _national(s: str) -> str:
    """Digits of a telephone number without country code and trunk zero."""
    digits = re.sub(r"\D", "", s)
    abroad = s.lstrip("(").startswith("+") or digits.startswith("00")
    digits = digits.removeprefix("00") if abroad else digits
    if abroad:
        digits = digits[next((k for k in (1, 2) if digits[:k] in _CODES), 3) :]
    return digits.lstrip("0") or "0"


def _date(s: str) -> datetime.date | None:
    a, b, c = map(int, re.split(r"\D", s))
    if a <= 31:  # the day first, unless only the other way is a date
        a, b, c = (c, b, a) if b <= 12 else (c, a, b)
    try:
        return datetime.date(a, b, c) if 1900 <= a < 2100 else None
    except ValueError:
        return None


def _numbers(text: str):
    at = 0
    while m := _ANCHOR.search(text, at):
        begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start())
        at = end = len(text) if end < 0 else end
        for m in _FIND.finditer(text, begin, end):
            kind = next(k for k in _KINDS if m[k])
            a, b = m.span(kind)
            s = m[kind]
            kind = {"quoted": "secret", "bare": "secret", "called": "phone"}.get(kind, kind)
            if kind == "email":
                norm = s.lower()
            elif kind == "secret":
                norm = s.lower() if re.fullmatch(r"[0-9A-Fa-f]+", s) else s
            elif kind == "phone":
                norm = _national(s)
            elif kind in ("card", "ssn"):
                norm = re.sub(r"\D", "", s)
            elif kind == "passport":
                norm = s.upper()
            elif kind == "birth":
                day = _date(s)
                if day is None:
                    continue
                norm = day.isoformat()
            elif kind == "ip6":
                try:
                    norm = ipaddress.IPv6Address(s).exploded
                except ValueError:
                    continue
            elif kind == "iban":
                norm = s.replace(" ", "")
                if not 15 <= len(norm) <= 34:
                    continue
            else:
                norm = s
            yield a, b, kind, norm


def _persons(text: str):
    """(start, end, "person:" and the title's gender, the name in lower case)."""
    at = 0
    for c in _CAPITAL.finditer(text):
        begin = c.start()
        if begin < at or c[0].lower() not in _STARTS or begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
            continue
        gender, t = "", _TITLED.match(text, begin)
        start = begin
        if t:
            gender, start = _TITLE_GENDER[t["title"].rstrip(".").lower()], t.end()
        elif c[0].lower() not in _GENDER:
            continue
        m = _RUN.match(text, start)
        if not m:
            continue
        words = [(w.start(), w.end(), w[0]) for w in _PARTS.finditer(text, start, m.end())]
        last = 0
        for k, (_, _, w) in enumerate(words):
            if k and w.rstrip(".").lower() in _STOP:
                break
            if w not in _PARTICLES and (k == 0 or len(w.rstrip(".")) > 1):
                last = k
        first = words[0][2]
        # A given name alone is no name of a person; nor is a shouted word before others.
        if not t and (last == 0 or first.isupper() and len(first) > 1 and not words[1][2].isupper()):
            continue
        if t and last == 0 and (len(first.rstrip(".")) < 2 or first.lower() in _STOP):
            continue
        end = words[last][1]
        if text[end - 1] == "." and len(words[last][2]) > 2:  # the full stop of a sentence
            end -= 1
        yield start, end, f"person:{gender}", text[start:end].lower()
        at = end


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of each entity, in order, none overlapping."""
    out = []
    for x in sorted([*_numbers(text), *_persons(text)], key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def name_parts(name: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, norm) of the given and family names and initials of a name; particles stand."""
    words = [(m.start(), m.end(), m[0]) for m in _PARTS.finditer(name)]
    words = [w for w in words if w[2] not in _PARTICLES]
    out = []
    for k, (a, b, w) in enumerate(words):
        if w.endswith(".") and len(w) > 2:
            b, w = b - 1, w[:-1]
        low = w.lower()
        if len(w.rstrip(".")) == 1:
            kind = "initial"
        elif len(words) > 1 and k < len(words) - 1 and (k == 0 or low in _GENDER):
            kind = "given"
        else:
            kind = "family"
        out.append((a, b, f"{kind}:{_script(w)}", low.rstrip(".")))
    return out


def _prf(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\0".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(key: bytes, tweak: str, x: int, n: int, allowed=None) -> int:
    """A keyed permutation of range(n), one for each tweak; of those allowed, if a test is given that x passes."""
    if n <= 1:
        return x
    half = (max(n - 1, 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    blocks = -(-half // 256)
    while True:
        left, right = x >> half, x & mask
        for k in range(8):
            f = 0
            for j in range(blocks):
                f = f << 256 | _prf(key, tweak, f"{k}.{j}", f"{right:x}")
            left, right = right, left ^ f & mask
        x = left << half | right
        if x < n and (allowed is None or allowed(x)):
            return x


_ALPHABETS = [(0x30, 10), (0x61, 26), (0x41, 26), (0x3B1, 17), (0x391, 17), (0x430, 32), (0x410, 32), (0xDF, 24), (0xC0, 23), (0x4E00, 20902), (0xAC00, 11172), (0x3041, 86), (0x30A1, 90), (0x5D0, 27), (0x627, 20)]


def _shape(key: bytes, tweak: str, s: str, hexadecimal: bool = False) -> str:
    """Another string of the same alphabets at each position; those of no alphabet stand. One permutation of all strings of that shape."""
    digits, shape = [], []
    for c in s:
        o = ord(c)
        if hexadecimal and c in "0123456789abcdef":
            digits.append((int(c, 16), 16))
            shape.append("h")
            continue
        for base, n in _ALPHABETS:
            if base <= o < base + n:
                digits.append((o - base, n))
                shape.append(chr(base))
                break
        else:
            shape.append(f"={c}")
    x, total = 0, 1
    for d, n in digits:
        x, total = x * n + d, total * n
    y = permute(key, f"{tweak}\0{len(s)}\0{''.join(shape)}", x, total)
    new = []
    for _, n in reversed(digits):
        y, d = divmod(y, n)
        new.append(d)
    it, out = reversed(new), []
    for k in shape:
        out.append(k[1:] if k[0] == "=" and len(k) > 1 else f"{next(it):x}" if k == "h" and hexadecimal else chr(ord(k) + next(it)))
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def _iban_check(s: str) -> str:
    number = int("".join(str(int(c, 36)) for c in s[4:] + s[:2] + "00"))
    return s[:2] + f"{98 - number % 97:02d}" + s[4:]


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 1_000_000, x // 10_000 % 100, x % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _public(x: int) -> bool:
    return 1 <= x >> 24 <= 223 and x >> 24 not in (10, 127) and x >> 16 != 0xC0A8


@functools.lru_cache(1 << 16)
def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, gender: str = "") -> str:
    """The normal form of the replacement; for an attempt, all entities of a kind but name parts get different ones."""
    tweak = f"{kind}\0{attempt}"
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        return f"{_shape(key, f'{tweak}\0{domain}', local)}@{_shape(key, f'host\0{top}', host)}.{top}"
    if kind == "secret":
        head = re.match(r"AKIA|gh[opsu]_|sk-|xox[abp]-|eyJ", norm)
        h = head[0] if head else ""
        return h + _shape(key, tweak + h, norm[len(h) :], re.fullmatch(r"[0-9a-f]+", norm) is not None)
    if kind == "ip":
        x = int(ipaddress.IPv4Address(norm))
        bits = 24 if x >> 24 in (10, 127) else 16 if x >> 16 == 0xC0A8 else 0
        if bits:
            x = (x >> bits << bits) + permute(key, f"{tweak}\0{x >> bits}", x & (1 << bits) - 1, 1 << bits)
        else:
            ok = _public(x)
            x = permute(key, f"{tweak}\0{ok}", x, 1 << 32, lambda v: _public(v) == ok)
        return str(ipaddress.IPv4Address(x))
    if kind == "ip6":
        x = int(ipaddress.IPv6Address(norm))
        return ipaddress.IPv6Address((x >> 112 << 112) + permute(key, f"{tweak}\0{x >> 112}", x & (1 << 112) - 1, 1 << 112)).exploded
    if kind == "birth":
        first, days = datetime.date(1900, 1, 1), 73_049
        return (first + datetime.timedelta(permute(key, tweak, (datetime.date.fromisoformat(norm) - first).days, days))).isoformat()
    if kind == "ssn":
        ok = _ssn_valid(int(norm))
        return f"{permute(key, f'{tweak}\0{ok}', int(norm), 10**9, lambda v: _ssn_valid(v) == ok):09d}"
    if kind == "card":
        if _luhn(norm) == 0:  # a right check digit stays right
            s = norm[0] + _shape(key, f"{tweak}\0{norm[0]}", norm[1:-1])
            return next(x for x in (s + str(d) for d in range(10)) if _luhn(x) == 0)
        size = 10 ** (len(norm) - 1)
        y = permute(key, f"{tweak}\0{norm[0]}\0{len(norm)}", int(norm[1:]), size, lambda v: _luhn(norm[0] + f"{v:0{len(norm) - 1}d}") != 0)
        return norm[0] + f"{y:0{len(norm) - 1}d}"
    if kind in ("phone", "passport"):
        return norm[0] + _shape(key, f"{tweak}\0{norm[0]}", norm[1:])
    if kind == "iban":
        right = _iban_check(norm) == norm
        s = norm[:4] + _shape(key, f"{tweak}\0{norm[:2] if right else norm[:4]}", norm[4:])
        return _iban_check(s) if right else s
    part, script = kind.split(":")
    if part == "initial":
        base, n = {"latin": (0x61, 26), "greek": (0x3B1, 17), "cyrillic": (0x430, 32)}[script]
        x = ord(norm) - base
        return chr(base + permute(key, tweak, x, n)) if len(norm) == 1 and 0 <= x < n else norm
    r = _prf(key, tweak, norm)
    if part == "given":
        gender = gender or "fm"[r & 1]
    pool = GIVEN[(gender, script)] if part == "given" else FAMILY[script]
    drawn = []
    for _ in range(attempt + 1):  # a compound of one more name for each attempt
        r, k = divmod(r, len(pool))
        drawn.append(pool[k])
    if script == "cyrillic" and part == "family" and re.search("(ов|ев|ёв|ин)а$", norm):
        drawn[-1] += "а"
    return "-".join(drawn).lower()


def _capitals(new: str, mention: str) -> str:
    if mention.isupper() and len(mention.rstrip(".")) > 1:
        return new.upper()
    return re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:], new)


def dress(new: str, mention: str, kind: str) -> str:
    """The replacement in the mention's format: separators, case, country code, layout of dates."""
    if kind == "phone":
        digits = sum(c.isdigit() for c in mention)
        skip, it, out = digits - len(new), iter(new), []
        for c in mention:
            if c.isdigit() and skip > 0:
                skip -= 1
                out.append(c)
            else:
                out.append(next(it, "") if c.isdigit() else c)
        return "".join(out)
    if kind in ("card", "ssn", "iban"):
        it = iter(new)
        return "".join(next(it, "") if c.isalnum() else c for c in mention)
    if kind == "passport":
        return "".join(n.lower() if m.islower() else n for n, m in zip(new, mention))
    if kind == "birth":
        y, m, d = new.split("-")
        parts, gaps = re.split(r"\D", mention), re.findall(r"\D", mention)
        order = (y, m, d) if len(parts[0]) == 4 else (d, m, y) if int(parts[1]) <= 12 else (m, d, y)
        order = [p if len(was) == len(p) else p.lstrip("0") for p, was in zip(order, parts)]
        return f"{order[0]}{gaps[0]}{order[1]}{gaps[1]}{order[2]}"
    if kind == "ip6":
        a = ipaddress.IPv6Address(new)
        s = a.compressed if "::" in mention else ":".join(f"{int(g, 16):x}" for g in a.exploded.split(":"))
        return s.upper() if mention.isupper() else s
    if kind in ("email", "secret") and any(c.isalpha() for c in mention):
        if mention.isupper():
            return new.upper()
        if kind == "email" and mention != mention.lower() and len(new) == len(mention):
            return "".join(n.upper() if m.isupper() else n for n, m in zip(new, mention))
    return new


def parts_of(text: str):
    """(kind, norm, gender that a title gives) of all that needs a surrogate of its own."""
    for a, b, kind, norm in find(text):
        if kind.startswith("person"):
            for k, (_, _, part, low) in enumerate(name_parts(text[a:b])):
                yield part, low, kind[7:] if k == 0 and part.startswith("given") else ""
        else:
            yield kind, norm, ""


def entities(docs: DataFrame) -> DataFrame:
    """kind, norm, m, f: what each batch of texts holds, and how many titles speak of men and women."""

    def run(batches):
        for b in batches:
            got: dict[tuple[str, str], list[int]] = {}
            for t in b.column(0).to_pylist():
                for kind, norm, g in parts_of(t) if t else ():
                    n = got.setdefault((kind, norm), [0, 0])
                    if g:
                        n[g == "f"] += 1
            rows = sorted(got)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.string()), *(pa.array([got[r][c] for r in rows], pa.int64()) for c in (0, 1))], ["kind", "norm", "m", "f"])

    return map_arrow(docs.select("text"), run, "kind string, norm string, m long, f long")


def _propose(d: DataFrame, key: bytes) -> DataFrame:
    """Adds new: the surrogate; d: kind, norm, gender, attempt."""
    ship_code(d.sparkSession)

    @F.pandas_udf("string")
    def new(kind: pd.Series, norm: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, n, int(a), g) for k, n, a, g in zip(kind, norm, attempt, gender)], dtype=object)

    return d.withColumn("new", new("kind", "norm", "attempt", "gender"))


_COLUMNS = ["kind", "norm", "gender", "attempt", "new"]


def dictionary(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, gender, attempt, new of every distinct entity and name part: within a kind all different."""
    listed = F.create_map(*[F.lit(x) for n in _GENDER.items() for x in n])[F.col("norm")]
    voted = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("")
    names = entities(docs).groupBy("kind", "norm").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    names = names.select("kind", "norm", F.when(F.col("kind").startswith("given:"), F.coalesce(listed, voted)).otherwise("").alias("gender"), F.lit(0).alias("attempt"))
    first = materialize(_propose(materialize(names), key).select(*_COLUMNS))
    drawn = F.col("kind").rlike("^(given|family):")
    # Permuted values that are real ones, for which others are tried.
    d, real = first, first.select("kind", F.col("norm").alias("new"))
    again = materialize(first.where(~drawn & ~F.col("kind").startswith("initial")).join(real, ["kind", "new"], "left_semi").select(*_COLUMNS))
    settled = None
    for attempt in range(1, TRIES + 1):
        if not again.limit(1).count():
            break
        tried = _propose(again.select("kind", "norm", "gender", F.lit(attempt).alias("attempt")), key)
        tried = materialize(tried)
        taken = real.union(first.select("kind", "new"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "new"))
        # One permutation for all that try again: they differ from each other.
        good = materialize(tried.join(taken, ["kind", "new"], "left_anti").select(*_COLUMNS))
        settled = good if settled is None else materialize(settled.unionByName(good))
        again = materialize(again.join(good, ["kind", "norm"], "left_anti").select(*_COLUMNS))
    if settled is not None:
        d = materialize(first.join(settled, ["kind", "norm"], "left_anti").select(*_COLUMNS).unionByName(settled))
    # Drawn names: the lower attempt keeps a name, so that what is settled stays.
    while True:
        one = d.where(drawn).groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("keeps")).where("n > 1")
        lost = d.join(one.select("kind", "new", F.col("keeps.norm").alias("keeper")), ["kind", "new"]).where(F.col("norm") != F.col("keeper"))
        lost = materialize(lost.select(*_COLUMNS))
        if not lost.limit(1).count():
            return d
        retry = _propose(lost.select("kind", "norm", "gender", (F.col("attempt") + 1).alias("attempt")), key)
        d = materialize(d.join(lost, ["kind", "norm"], "left_anti").select(*_COLUMNS).unionByName(retry))


def replace(text: str, key: bytes, more: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list]:
    """The text with surrogates, and what was found; more: attempt and gender of those that need them."""
    found, out, at = find(text), [], 0

    def new(kind: str, norm: str) -> str:
        attempt, gender = more.get((kind, norm), (0, ""))
        return surrogate(key, kind, norm, attempt, _GENDER.get(norm, gender) if kind.startswith("given") else "")

    for a, b, kind, norm in found:
        out.append(text[at:a])
        mention = text[a:b]
        if kind.startswith("person"):
            end = 0
            for p, q, part, low in name_parts(mention):
                dot = "." if mention[p:q].endswith(".") else ""
                out += [mention[end:p], _capitals(new(part, low), mention[p:q]), dot]
                end = q
            out.append(mention[end:])
        else:
            out.append(dress(new(kind, norm), mention, kind))
        at = b
    return "".join(out) + text[at:] if found else text, found


def _rewrite(docs: DataFrame, key: bytes, broadcast_rows: int) -> DataFrame:
    """docs with surrogates in text and with __lw_mentions, __lw_distinct, __lw_kinds."""
    more = dictionary(docs, key).where((F.col("attempt") > 0) | (F.col("kind").startswith("given:") & (F.col("gender") != ""))).select("kind", "norm", "attempt", "gender")
    # The genders of listed names are known everywhere.
    more = materialize(more.where((F.col("attempt") > 0) | ~F.col("norm").isin(*_GENDER)))
    shared = {(r.kind, r.norm): (r.attempt, r.gender) for r in more.collect()} if more.count() <= broadcast_rows else None  # its size has been counted
    src = docs
    if shared is None:

        def own(batches):
            for b in batches:
                rows = [(h, k, v) for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for k, v in {(k, v) for k, v, _ in parts_of(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["h", "kind", "norm"])

        texts = docs.select(F.xxhash64("text").alias("h"), "text")
        has = map_arrow(texts, own, "h long, kind string, norm string").distinct().join(more, ["kind", "norm"])
        has = has.groupBy(F.col("h").alias("__lw_h")).agg(F.collect_list(F.struct("kind", "norm", "attempt", "gender")).alias("__lw_more"))
        src = docs.join(has, F.xxhash64("text") == F.col("__lw_h"), "left").drop("__lw_h")
    extra = [StructField("__lw_mentions", LongType()), StructField("__lw_distinct", LongType()), StructField("__lw_kinds", StringType())]
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts, counts, distinct, kinds = [], [], [], []
            own_more = b.column(len(docs_columns)).to_pylist() if shared is None else None
            for i, t in enumerate(b.column(at).to_pylist()):
                known = shared if shared is not None else {(x["kind"], x["norm"]): (x["attempt"], x["gender"]) for x in own_more[i] or []}
                new, found = replace(t, key, known) if t else (t, [])
                texts.append(new)
                counts.append(len(found))
                distinct.append(len({(k.split(":")[0], n) for _, _, k, n in found}))
                kinds.append(",".join(sorted({k.split(":")[0] for _, _, k, _ in found})))
            columns = [b.column(c) for c in range(len(docs_columns))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(distinct, pa.int64()), pa.array(kinds, pa.string())], [*docs_columns, "__lw_mentions", "__lw_distinct", "__lw_kinds"])

    docs_columns = docs.columns
    return map_arrow(src, run, StructType([*docs.schema.fields, *extra]))


def pseudonymize(docs: DataFrame, key: bytes, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with surrogates in the texts, all other columns kept. The key is the deployment's secret: one key, one mapping."""
    return _rewrite(docs, key, broadcast_rows).select(*docs.columns)


def report(docs: DataFrame, key: bytes, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_entities (mentions), n_distinct, kinds (sorted, comma-joined), text (with surrogates) of every row."""
    d = _rewrite(docs.select("doc_id", "text"), key, broadcast_rows)
    return d.select("doc_id", F.col("__lw_mentions").alias("n_entities"), F.col("__lw_distinct").alias("n_distinct"), F.col("__lw_kinds").alias("kinds"), "text")
