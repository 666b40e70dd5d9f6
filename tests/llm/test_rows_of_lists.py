"""Joins with hot keys, and lists of rare elements, against plain versions; how many rows they make."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from tidelog.llm import jaccard_join
from tidelog.llm.shared import hot_join


def test_each_row_goes_through_one_join(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 300 + [2] * 200 + list(range(3, 40)) + [None, 77])], "k long, v int")
    keyed = rows.groupBy("k").count().filter("k <> 77").selectExpr("k", "k * 10 AS x", "count AS weight")
    for how, kept in (("inner", lambda k: k is not None and k != 77), ("left", lambda k: True)):
        out = hot_join(rows, keyed, "k", "weight", how)
        want = Counter((r["k"], r["v"], r["k"] * 10 if r["k"] is not None and r["k"] != 77 else None) for r in rows.collect() if kept(r["k"]))
        assert Counter(tuple(r) for r in out.collect()) == want
        assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rare_lists_match_plain(spark, monkeypatch):
    rng = np.random.default_rng(5)
    own = {i: rng.choice(2**62, int(rng.integers(5, 300)), replace=False) if i % 3 else np.unique(rng.integers(0, 900, 250)) for i in range(90)}
    sets = {i: np.unique(s.astype(np.uint64)) for i, s in own.items()}
    chosen = [i for i in sets if i % 10]
    df = Counter(int(x) for i in chosen for x in sets[i])
    want = set()
    for i in chosen:
        n = len(sets[i])
        ranked = sorted((int(x) for x in sets[i]), key=lambda x: (df[x], x))[: n - math.ceil(3 * n / 4) + 1]
        want |= {(x, i, n, at >= n - math.ceil(6 * n / 7) + 1) for at, x in enumerate(ranked) if df[x] > 1}
    made = []
    stored = jaccard_join.materialize

    def counted(table, name="t"):
        out = stored(table, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    rows = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in sets.items()], "rid long, n long, elements binary").repartition(3)
    got = [tuple(r) for r in jaccard_join.rare_lists(rows, spark.createDataFrame([(i,) for i in chosen], "rid long")).select("token", "rid", "n", "outer").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(made) <= max(len(want), 200), "elements of whole sets became rows"
