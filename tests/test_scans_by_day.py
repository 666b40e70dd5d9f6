"""Scans that are cut into days equal a scan of the whole history."""

from __future__ import annotations

import random
from itertools import groupby

from pyspark.sql import functions as F

from tidelog.plans import panes, series
from tidelog.plans.windows import DAY
from tidelog.sources import polls


def test_changes_across_days(spark):
    """Days without rows between, null keys and subjects, repeated rows and ties of a second."""
    rng = random.Random(3)
    rows = [(s, rng.choice((0, 1, 2, 5)) * DAY + rng.randrange(0, DAY, 6000), f"{i:03}", rng.choice(("x", "y", None))) for i, s in enumerate(rng.choice(("a", "b", None)) for _ in range(200))]
    rows += [("a", DAY - 1, "u", "x"), ("a", DAY, "v", "x"), ("a", DAY, "v", "x"), ("a", 9 * DAY, "w", "x"), ("a", None, "n", "y")]
    df = spark.createDataFrame(rows, "subject_id string, ts bigint, id string, bundle_id string").withColumn("extra", F.lit(1))
    got = sorted((r["subject_id"] or "", r["id"]) for r in polls.changes(df, ["bundle_id"], ["subject_id"], ["ts", "id"]).collect())
    want = []
    for subject in ("a", "b", None):
        before = ()
        for _, _, i, b in sorted((r for r in rows if r[0] == subject), key=lambda r: (r[1] if r[1] is not None else -1, r[2])):
            if before != (b,):
                want.append((subject or "", i))
            before = (b,)
    assert got == sorted(want)
    assert polls.changes(df.limit(0), ["bundle_id"], ["subject_id"], ["ts", "id"]).columns == df.columns


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_ordered_by_day_only(spark):
    """Only one row a day, or a few runs, are ordered by subject alone."""
    df = spark.createDataFrame([("a", 1, "i", "b")], "subject_id string, ts bigint, id string, bundle_id string")
    windows = [line for line in plan_of(polls.changes(df, ["bundle_id"], ["subject_id"], ["ts", "id"])).splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert sum("ts#" in line.split("[")[2] for line in windows) <= 1


def test_merged_runs_across_days(spark):
    """Runs that last for days, gaps of exactly the reach and one more, and bounds of days."""
    rng = random.Random(5)
    rows = []
    for s in ("a", "b"):
        at = DAY - 500
        for _ in range(400):
            rows.append((s, at))
            at += rng.choice((60, 60, 60, 60, 60, 60, 60, 61, 300, 20_000 if s == "a" else 60))
    rows += [("c", 60 * i) for i in range(3 * DAY // 60 + 1)] + [("d", DAY - 60), ("d", DAY), ("e", DAY - 61), ("e", DAY)]
    df = spark.createDataFrame(rows, "subject_id string, w_end bigint")
    got = panes.merged_runs(df, ["subject_id"], "w_end", lambda before, at: at - before == 60, 60, {"n": (F.count("*"), F.sum("n"))})
    want = []
    for s, group in groupby(sorted(rows), key=lambda r: r[0]):
        run: list[int] = []
        for _, at in group:
            if run and at - run[-1] != 60:
                want.append((s, run[0], run[-1], len(run)))
                run = []
            run.append(at)
        want.append((s, run[0], run[-1], len(run)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert ("c", 0, 3 * DAY, 3 * DAY // 60 + 1) in want


def test_report_runs_over_midnight(spark):
    """A run keeps its first and last value over midnight; 1020 s join, 1021 don't."""
    ends = [(DAY - 900, 1.0), (DAY + 120, 9.0), (DAY + 1140, None), (DAY + 2161, 4.0)]
    df = spark.createDataFrame([("s", "f", at, v) for at, v in ends], "subject_id string, feature_id string, w_end bigint, value double")
    got = [tuple(r) for r in series.runs(df).select("run_start", "run_end", "first", "last", "low", "high", "samples", "trend").orderBy("run_start").collect()]
    assert got == [(DAY - 1800, DAY + 1140, 1.0, None, 1.0, 9.0, 3, "n/a"), (DAY + 1261, DAY + 2161, 4.0, 4.0, 4.0, 4.0, 1, "flat")]
