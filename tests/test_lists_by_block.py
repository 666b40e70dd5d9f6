"""Ids of long windows are listed by blocks of ends; no scan carries them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.plans import panes
from tidelog.plans.features import Catalog
from tidelog.sources.events import typed_observations


def windows_of(df) -> list[str]:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


@pytest.mark.parametrize("name", ["circadian_offset", "energy_score", "sleep_debt"])
def test_no_scan_carries_the_ids_of_a_day(spark, sf_dir, name):
    """A running list of a day's ids grows with the square of the rows."""
    rows = Catalog(typed_observations(spark, sf_dir), 60, most=None)[name]
    carried = [line for line in windows_of(rows) if "collect_list" in line and "RowFrame" in line]
    assert not carried


@pytest.mark.parametrize("distinct", [False, True])
def test_listed(spark, distinct):
    """Bounds of blocks, items that end before they start, equal ids, ends without items."""
    rng = random.Random(7)
    items = []
    for i in range(300):
        low = rng.choice((rng.randrange(1000), rng.randrange(10) * 100, rng.randrange(10) * 100 - 1))
        items.append((rng.choice("ab"), f"{rng.randrange(200):03}", low, low + rng.choice((-5, 0, 1, 99, 100, 350)), i % 3 == 0))
    ends = [(s, e) for s in "abc" for e in range(0, 1300, 20)]
    df = spark.createDataFrame(items, "subject_id string, id string, low bigint, high bigint, odd boolean")
    out = panes.listed(spark.createDataFrame(ends, "subject_id string, w_end bigint"), df, 100, {"i_all": F.lit(True), "i_odd": F.col("odd")}, distinct)
    got = {(r[0], r[1]): (r[2] or [], r[3] or []) for r in out.collect()}
    assert len(got) == len(ends)
    for s, e in ends:
        own = [(i, odd) for x, i, low, high, odd in items if x == s and low <= e <= high]
        pick = (lambda ids: sorted(set(ids))) if distinct else sorted
        assert got[s, e] == (pick(i for i, _ in own), pick(i for i, odd in own if odd)), (s, e)


def test_meetings_are_gathered_by_blocks(spark, sf_dir):
    """A meeting repeated for each of its ends would be sorted once for every end."""
    rows = Catalog(typed_observations(spark, sf_dir), 60, most=None)["meeting_density"]
    assert not windows_of(rows)


def test_meeting_density_by_blocks(spark):
    """Overlaps, meetings that touch or end before they start, bounds of blocks, null confidence."""
    rng = random.Random(9)
    meetings = []
    for i in range(60):
        start = rng.choice((rng.randrange(20_000), rng.randrange(6) * 3600))
        meetings.append(("a", f"{i:03}", start, start + rng.choice((-700, 0, 60, 900, 3600, 9000)), rng.choice((None, 0.5, 0.75))))
    cat = Catalog(spark.range(0), 60, most=None)
    cat.meetings = spark.createDataFrame(meetings, "subject_id string, id string, start_s bigint, end_s bigint, confidence double")
    got = {r["w_end"]: (round(r["value"], 9), r["confidence"] and round(r["confidence"], 9), r["evidence"]) for r in cat["meeting_density"].collect()}
    first, last = min(m[2] for m in meetings), max(m[3] for m in meetings)
    want = {}
    for end in sorted({*range(-(-first // 60) * 60, last + 1, 60), last}):
        own = [m for m in meetings if m[2] <= end <= m[3] + 900]
        if own:
            seconds = {t for m in own for t in range(max(m[2], end - 900), min(m[3], end))}
            known = [m[4] for m in own if m[4] is not None]
            want[end] = (round(len(seconds) / 900, 9), round(sum(known) / len(known), 9) if known else None, sorted(m[1] for m in own))
    assert got == want


def test_only_rows_within_reach_are_summed(spark):
    """A capped grid sums no rows before its first window; its values stay."""
    rows = [(f"{i:06}", s, i * 30 + (s == "b"), "p", "context_window", 0.5, f"app.{i * 7 % 11 % 3}") for i in range(400) for s in "ab"]
    obs = spark.createDataFrame(rows, "id string, subject_id string, ts bigint, provider_id string, data_type string, confidence double, bundle_id string")
    obs = obs.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in S.PAYLOAD.items() if name not in obs.columns])
    capped, whole = Catalog(obs, 60, most=10), Catalog(obs, 60, most=None)
    assert {r["id"] for r in capped._in_reach().collect()} == {r[0] for r in rows if r[2] >= 11970 - 30 - 9 * 60 - 900}
    got = {(r["subject_id"], r["w_end"]): r for r in capped["context_switch_rate"].collect()}
    want = {(r["subject_id"], r["w_end"]): r for r in whole["context_switch_rate"].collect()}
    assert len(got) == 20 and all(want[k] == r for k, r in got.items())
