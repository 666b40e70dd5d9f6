"""Documents with every awkward case, beside the synthetic table's own rows."""

from __future__ import annotations

import pytest

WORDS = "river stone amber cloud silver maple harbor winter candle meadow copper violet thunder orchard lantern pebble".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    long = prose(5, 60_000)
    rows = [
        (1000001, None, "en", "a"), (1000002, "", None, "a"), (1000003, " \t\n ", "en", None), (1000004, "one two", "en", "b"),
        (1000005, "one two", "en", "b"), (1000006, "ONE TWO", "de", "c"), (1000006, "ONE TWO", "de", "c"), (1000007, long, "en", "a"),
        (1000008, long + " tail", "en", None), (1000009, "é中\U0001f600 café 12345 ١٢", "fr", "b"), (1000010, "!!! ... 123", None, None),
        (1000011, prose(9, 300), None, "a"), (1000012, prose(9, 300) + " x", None, "d"), (1000013, prose(9, 300) + " x y", None, "d"),
        (None, "text without an id", "en", "b"), (1000014, "á é   \x00 \x1c word", "en", "b"), (1000015, "line\nline\n\nline", "en", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """documents plus columns whose names the operators use themselves."""
    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string")
    for name in ("rid", "size", "n", "kept", "bits", "start", "bucket", "piece", "base", "added", "token", "gone", "times", "copy", "pattern", "row", "spans"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.selectExpr("*", "length(text) AS n_chars")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def local(docs):
    return docs.orderBy("doc_id").collect()
