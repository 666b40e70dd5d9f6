"""What is known of a subject meets its rows day by day, never in one task for all of them."""

from __future__ import annotations

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F
from tidelog import schema as S
from tidelog.plans import panes, windows as W
from tidelog.plans.features import Catalog

DAYS = 12


@contextmanager
def shuffled(spark):
    """No table is small enough to be sent whole to every task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def obs(spark):
    """One subject, some rows every day."""
    columns = {"bundle_id": "string", "bpm": "double", "rmssd_ms": "double", "uid": "string", "start_s": "bigint", "end_s": "bigint"}
    rows = []
    for day in range(DAYS):
        for i, (kind, *payload) in enumerate(((S.CONTEXT, "app.1"), (S.CONTEXT, "app.2"), (S.HEART_RATE, None, 70.0), (S.HRV, None, None, 40.0), (S.CALENDAR, None, None, None, "u", 600, 1200))):
            at = day * W.DAY + 7 * i
            payload += [None] * (len(columns) - len(payload))
            payload[4:] = [x if x is None else x + day * W.DAY for x in payload[4:]]
            rows.append((f"{day:02}{i}", "a", at, "p", kind, 0.5, *payload))
    names = "id string, subject_id string, ts bigint, provider_id string, data_type string, confidence double, "
    df = spark.createDataFrame(rows, names + ", ".join(f"{k} {v}" for k, v in columns.items()))
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in S.PAYLOAD.items() if name not in df.columns])


@pytest.mark.parametrize("name", ["context_switch_rate", "meeting_density", "recovery_score", "fatigue_index"])
def test_a_subject_spreads_over_tasks(spark, obs, name):
    """Joined by subject alone, all of its windows would come from one task."""
    with shuffled(spark):
        tasks = Catalog(obs, 60, most=None)[name].select(F.spark_partition_id().alias("task"), "w_end").groupBy("task").count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < sum(r["count"] for r in tasks)


@pytest.mark.parametrize("step", [60, 7000])
@pytest.mark.parametrize("most", [None, 3])
def test_days_of_a_grid(spark, step, most):
    """Days hold the bounds of their own ends, also for grids with no aligned end."""
    spans = [("a", 5, 5), ("b", 86_399, 86_401), ("c", -90_000, 200_000), ("d", 60, 3 * W.DAY), ("e", 61, 118)]
    bounds = W.bounds(spark.createDataFrame(spans, "subject_id string, min_ts bigint, max_ts bigint"), step, most)
    got = sorted((r["subject_id"], r["w_end"]) for r in W.ends(bounds, step).collect())
    want = []
    for s, low, high in spans:
        ends = list(range(-(-low // step) * step, high + 1, step))[-(most or 10**9) :]
        want += [(s, e) for e in ends] + ([(s, high)] if high % step and (most is None or len(ends) < most) else [])
    assert got == sorted(want)
    for r in W.days(bounds, step).collect():
        assert r["first_end"] >= r["chunk"] * W.DAY and r["last_end"] < (r["chunk"] + 1) * W.DAY
        assert r["tip"] is None or r["tip"] // W.DAY == r["chunk"]


def test_inside(spark):
    """Bounds count, intervals may span blocks, overlap or be empty."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(-50, 400)) for _ in range(200)] + [("a", 100), ("a", 150), ("c", 7)]
    items = [("a", 100, 150, 1), ("a", 120, 301, 2), ("b", -20, 30, 3), ("b", 200, 190, 4)]
    got = panes.inside(spark.createDataFrame(rows, "subject_id string, ts bigint"), spark.createDataFrame(items, "subject_id string, low bigint, high bigint, n int"), 50)
    want = sorted((s, ts, n) for s, ts in rows for x, low, high, n in items if x == s and low <= ts <= high)
    assert got.columns == ["subject_id", "ts", "n"] and sorted(map(tuple, got.collect())) == want
