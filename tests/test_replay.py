"""Deduplication of rows whose ids and contents conflict, against a plain replay."""

from __future__ import annotations

import random

import pytest

from tidelog import schema as S
from tidelog.operators import quality


def raw(spark, rows: list[tuple]):
    """Rows (id, created_at, content)."""
    return spark.createDataFrame([(i, "s", 100, "p", S.HEART_RATE, 1.0, at, f'{{"hr": {c}}}') for i, at, c in rows], S.RAW_DDL)


def plain(rows: list[tuple], df) -> list:
    keys = {r["payload"]: r["content"] for r in df.withColumn("content", quality.content_key()).collect()}
    ids, contents, kept = set(), set(), []
    for i, at, c in sorted(rows, key=lambda r: (r[1], r[0] or "", keys[f'{{"hr": {r[2]}}}'])):
        if (i is None or i not in ids) and c not in contents:
            ids.add(i)
            contents.add(c)
            kept.append((i or "", at, c))
    return sorted(kept)


def got(df) -> list:
    return sorted((r["id"] or "", r["created_at"], int(r["payload"][7:-1])) for r in df.collect())


def jobs(spark, group: str) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def chain(length: int) -> list[tuple]:
    """Each row shares its id with the row before, its content with the row after."""
    return [(f"i{(k + 1) // 2:04}", k, 1000 + k // 2) for k in range(length)]


def test_a_chain_of_200_takes_few_jobs(spark):
    counts = []
    for length in (50, 200):
        spark.sparkContext.setJobGroup(f"chain{length}", "")
        df = raw(spark, chain(length))
        assert got(quality.dedupe(df)) == plain(chain(length), df)
        counts.append(jobs(spark, f"chain{length}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 40  # two more passes, not 75 more rounds


@pytest.mark.parametrize("largest", [quality.LARGEST, 12])
def test_random_conflicts(spark, largest, monkeypatch):
    """Hot ids and contents, repeated rows, null ids, and components above the bound."""
    monkeypatch.setattr(quality._replay, "__defaults__", (largest,))
    rng = random.Random(2)
    rows = [(rng.choice((None, "hot", *[f"i{k}" for k in range(20)])), rng.randrange(30), rng.choice((7, 7, *range(10, 40)))) for _ in range(150)]
    rows += [("z", 5, 99)] * 3 + chain(30)
    df = raw(spark, rows)
    assert got(quality.dedupe(df)) == plain(rows, df)
