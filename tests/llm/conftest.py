import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, h string, kept string, _d int, text_hash string, target string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def word(r):
    return "".join(r.choice(["ka", "lo", "mi", "nu", "re", "sí", "to", "Vä"]) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source): ordinary, copied, nearly copied, sharing a passage, repeated, null, empty, blank, very long."""
    r = random.Random(seed)
    passage = prose(r, 40)
    out = []
    for k in range(n):
        text = prose(r, r.choice([3, 25, 60, 120, 200]))
        if k % 5 == 1:
            text = out[-1][1]
        elif k % 5 == 2 and out[-2][1]:
            w = out[-2][1].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = word(r)
            text = " ".join(w)
        elif k % 5 == 3:
            text = prose(r, 30) + " " + passage + " " + prose(r, 30)
        out.append((k * 3, text, r.choice(["en", "de", None]), "hot" if k % 3 else r.choice(["a", "b", None])))
    out += [(1000, None, "en", "a"), (1001, "", "en", "b"), (1002, " \t\n ", None, None), (1003, "one", "en", "a"), (1004, "ONE", "en", "a"), (1005, "two  words", "en", "hot"), (1006, "two words", "de", "hot")]
    out += [(1007, prose(r, 30_000), "en", "hot"), (1008, "x " * 3000, "en", "a"), (1009, "no" * 20_000, "en", None), (1010, passage, "en", "a"), (1010, passage, "en", "a"), (1011, "É é ÀB c  d 𝔘\U0001f600 İ", "fr", "b")]
    out += [(None, "a text without an id but with words enough to be a document of some kind, surely", "en", "a")]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def table(spark):
    """Documents with more columns, some named like those of the operators."""

    def build(rows):
        return spark.createDataFrame([(*r, 0, 1, "h", "k", 2, "t", "g") for r in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def docs(table, rows):
    return table(rows)


def copies(df):
    """Rows as sorted tuples; doubles to ten digits."""
    return sorted((tuple(f"{v:.10g}" if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)
