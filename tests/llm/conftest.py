import random

import pytest

CLASHING = ["_id", "_key", "_order", "_row", "_gone", "_copies", "_bucket", "_range", "size", "n", "held_out", "score", "toxic", "label", "bucket", "row"]

WORDS = "the of and to river stone morning quiet ladder window garden yellow market under silver distant reason simple carry story".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


def rows():
    """Nulls in every column, empty and very long texts, repeated rows and ids, non-Latin texts."""
    base = prose(1, 80)
    out = [
        (0, base, "en", "web", 1),
        (1, base, "en", "web", 1),
        (1, base, "en", "web", 1),
        (2, None, None, None, None),
        (3, "", "en", "book", 0),
        (None, prose(2, 60), "en", None, 5),
        (None, None, None, None, None),
        (4, " \t\n ", "de", "book", 4),
        (5, "x", "en", "web", 1),
        (6, "Ünïcode ß straße Ωμέγα 東京 \U0001f600 " + prose(3, 30), "de", "book", 9),
        (7, prose(4, 20_000), "en", "web", 9),
        (8, prose(5, 120) + " " + base, "fr", "web", 9),
        (9, prose(6, 50), "en", "a", 9),
        (9, prose(7, 50), "en", "a", 9),
        (-5, prose(8, 40), "es", "", 9),
        (1 << 40, base.replace("the", "a", 1), "en", "web", 9),
    ]
    return out


@pytest.fixture(scope="session")
def tricky_rows():
    return rows()


@pytest.fixture(scope="session")
def tricky(spark):
    """The rows with extra columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows()], schema)


@pytest.fixture(scope="session")
def empty(tricky):
    return tricky.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    data = [(0, 1, 0), (1, 0, 1), (1, 1, 0), (None, 1, 1), (5, None, None), (7, None, 1), (9, 1, None), (9, 1, 0)]
    return spark.createDataFrame([(*r, "x", "x") for r in data], "doc_id long, quality int, toxic int, text string, weight string")
