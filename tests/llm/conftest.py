from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """Words of an invented language, with sentences and lines."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(r.choice(["ta", "ri", "mo", "ke", "su", "ben", "dol"]) for _ in range(r.randint(1, 4)))
        out.append(word + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else " "))
    return "".join(out).strip()


#: Texts that every operator must bear.
ODD_TEXTS = [None, "", " ", "\n\n", "\t\x0b\x0c\r", "one", "42 -- 17", "ümläut ÄÖ €", "\U00010348 \U0001f600", "a\x01b\x02c\x03d\x04e", "x" * 5000, "the " * 3000, "1" * 4000, "1 " * 3000, "a@" + "b." * 3000 + "c", "\u00a0\u2003\u3000"]


def documents(spark, rows):
    """(doc_id, text) as a documents table; languages and sources by turns, some null."""
    filled = [(i, t, None if n % 9 == 8 else ("en", "fr")[n % 2], None if n % 10 == 9 else f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(filled, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, repeated rows, a null id, and columns whose names an operator might use itself."""
    rows = [*enumerate(ODD_TEXTS), (100, prose(1, 120)), (100, prose(1, 120)), (101, prose(1, 120)), (None, prose(2, 80)), (102, prose(3, 4000))]
    df = documents(spark, rows)
    for name in ("score", "symbol", "stretch", "fp", "node", "component", "trusted", "label", "row", "n", "at", "ids", "quota", "period", "slots", "kind", "pii", "held_out", "count", "low", "high"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
