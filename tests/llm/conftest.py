from __future__ import annotations

import random

import pytest

#: Awkward rows that every operator must take: nulls, empty and blank texts, repeated rows, a very long text.
WORDS = "the and of that was with for from this have over under again lamp river stone cloud green winter table".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdefgh") * r.randrange(3)) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        (1, "Some plain text about a lamp.", "en", "a", 1),
        (2, None, "en", "a", 0),
        (3, "", None, "b", 0),
        (4, " \n\t ", "en", None, 3),
        (5, "Some plain text about a lamp.", "en", "a", 1),
        (5, "Some plain text about a lamp.", "en", "a", 1),
        (6, "日本語のテキスト 🙂 combining é", None, None, None),
        (7, "12345 !!! ###", "de", "c", 1),
        (8, prose(8, 30_000), "en", "c", 1),
        (9, prose(9, 120), "en", "c", 1),
        (None, "a row without an id", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # Columns with clashing names must not disturb an operator.
    extra = "0 AS part, 'x' AS digest, 'y' AS norm, 1 AS n, 2 AS seq, 'z' AS key, 3 AS h, 4 AS u, 5 AS v, 6 AS rep, 'q' AS ids, 7 AS keep_id, 8 AS family, 9 AS anchor, 10 AS size"
    return df.selectExpr("*", *extra.split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def small_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small_docs):
    return {r.doc_id: r.text or "" for r in small_docs.select("doc_id", "text").collect()}
