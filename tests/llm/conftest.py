from __future__ import annotations

import random

import pytest

#: doc_id, text: nulls, empty and white texts, repeated rows and texts, ties, one long text, odd characters.
WORDS = "the of and river stone ändern château über light green seven walk paper house mountain, cloud. Über! niño".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + str(rng.randrange(60)) + rng.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n))


def rows() -> list[tuple]:
    base = prose(1, 300)
    edited = base.split(" ")
    edited[50] = "changed"
    edited[120:122] = ["some", "other", "words"]
    shared = prose(2, 90)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "a"),
        (5, base),
        (5, base),
        (6, base),
        (7, " ".join(edited)),
        (None, prose(3, 120)),
        (8, prose(4, 80) + shared + prose(5, 40)),
        (9, prose(6, 30) + shared + prose(7, 200)),
        (10, prose(8, 4000)),
        (11, "x" * 5000),
        (12, "Te Te Te " * 60),
        (13, "one two\none two\none two\nthree | four # five % six & seven * eight nine ten eleven"),
        (14, " non breaking\x1c \U0001f600 <|endoftext|> </s> [INST] <|end|>"),
        (15, prose(9, 12)),
        (2**53 + 1, prose(10, 60)),
        (-4, prose(11, 60)),
    ]


SCHEMA = "doc_id bigint, text string"
EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, m1 string, h int, places string, bucket string, kept int, cuts int, found string, target string, key string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def extra(spark):
    """The same rows with further columns whose names clash with ones used inside."""
    own = [(i, t, "en", None, len(t or ""), 1, "x", 2, "y", "z", 3, 4, "f", "t", "k") for i, t in rows()]
    return spark.createDataFrame(own, EXTRA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
