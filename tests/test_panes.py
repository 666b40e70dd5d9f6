"""Sliding windows by panes and running sums against a look at every row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.plans import panes, windows as W
from tidelog.plans.features import Catalog, with_changes


def made_rows(seed: int, n: int = 160) -> list[dict]:
    r = random.Random(seed)
    start = 1_700_000_000 // 86400 * 86400 - 2000  # the rows cross a midnight
    rows = []
    for i in range(n):
        kind = r.choice([S.CONTEXT, S.BROWSER, S.KEYSTROKES, S.SLEEP])
        ts = start + r.randrange(7200) if i % 3 else start // 60 * 60 + 60 * r.randrange(120)  # a third on the grid
        row = {"id": f"{i:04d}", "subject_id": f"s{i % 2}", "ts": ts, "data_type": kind, "confidence": r.randrange(1, 9) / 8, "bundle_id": None, "category": None, "rate_per_min": None, "key_count": None, "stage": None, "start_s": None, "end_s": None}
        if kind == S.CONTEXT:
            row["bundle_id"] = r.choice(["a", "b", "c", None])
        elif kind == S.BROWSER:
            row["category"] = r.choice(["work", "shopping", None])
        elif kind == S.KEYSTROKES:
            row |= {"rate_per_min": float(r.randrange(60)), "key_count": r.randrange(5)}
        else:
            row |= {"start_s": ts, "end_s": ts + r.choice([30, 600, 5000, 90000]), "stage": r.choice(["asleep", None, "awake"])}
        rows.append(row)
    return rows


def frame(spark, rows: list[dict]):
    kinds = S.RAW | S.PAYLOAD
    own = {"id": "string", "subject_id": "string", "ts": "bigint", "data_type": "string", "confidence": "double"}
    names = list(rows[0])
    df = spark.createDataFrame([tuple(x[n] for n in names) for x in rows], ", ".join(f"{n} {own.get(n) or kinds[n]}" for n in names))
    missing = [c for c in S.PAYLOAD if c not in names]
    return df.withColumns({c: F.lit(None).cast(S.PAYLOAD[c]) for c in missing}) if missing else df


def grid(rows: list[dict], step: int, most: int | None) -> list[int]:
    low, high = min(x["ts"] for x in rows), max(x["ts"] for x in rows)
    ends = [e for e in range(-(-low // step) * step, high // step * step + 1, step)]
    ends = ends[-most:] if most else ends
    if high % step and (most is None or len(ends) < most):
        ends.append(high)
    return ends


def plain_window(rows: list[dict], end: int) -> tuple:
    inside = sorted((x for x in rows if end - 900 <= x["ts"] <= end), key=lambda x: (x["ts"], x["id"]))
    labels = [x["bundle_id"] for x in inside if x["data_type"] == S.CONTEXT and x["bundle_id"]]
    churn = [x["category"] for x in inside if x["data_type"] == S.BROWSER and x["category"]]
    rates = [x["rate_per_min"] for x in inside if x["rate_per_min"] is not None]
    moves = lambda xs: sum(a != b for a, b in zip(xs, xs[1:], strict=False))
    ids = sorted(x["id"] for x in inside if x["data_type"] == S.CONTEXT)
    rate = round(sum(rates) / len(rates), 9) if rates else None
    return len(ids), ids, moves(labels), moves(churn), len(set(labels)), rate, any(x >= 30 for x in rates)


@pytest.mark.parametrize("step,most", [(60, None), (60, 20), (7, None), (300, None), (3600, None), (1000, None)])
def test_sliding_windows(spark, step, most):
    rows = made_rows(step)
    windows = Catalog(frame(spark, rows), step, most=most).windows
    got = {}
    for r in windows.select("subject_id", "w_end", "n_ctx", "i_ctx", "switches", "churn", "bundles", "rate", "typing").collect():
        key = r["subject_id"], r["w_end"]
        assert key not in got
        got[key] = (r["n_ctx"], sorted(r["i_ctx"]), r["switches"], r["churn"], r["bundles"], None if r["rate"] is None else round(r["rate"], 9), r["typing"])
    want = {}
    for s in ("s0", "s1"):
        own = [x for x in rows if x["subject_id"] == s]
        want |= {(s, e): plain_window(own, e) for e in grid(own, step, most) if any(e - 900 <= x["ts"] <= e for x in own)}
    assert got == want


@pytest.mark.parametrize("step", [60, 1000])
def test_rest_of_the_last_day(spark, step):
    rows = made_rows(step + 1)
    cat = Catalog(frame(spark, rows), step, most=None)
    got = {(r["subject_id"], r["w_end"]): (r["rest"], r["low"], r["high"], r["n_rest"], round(r["c_rest"], 9), sorted(r["i_rest"])) for r in cat.rest(("asleep",)).collect()}
    want = {}
    for s in ("s0", "s1"):
        own = [x for x in rows if x["subject_id"] == s]
        naps = [x for x in own if x["data_type"] == S.SLEEP and x["stage"] in (None, "asleep")]
        for e in grid(own, step, None):
            there = [(max(x["start_s"], e - 86400), min(x["end_s"], e), x) for x in naps if x["start_s"] < e and x["end_s"] > e - 86400]
            if there:
                want[s, e] = sum(b - a for a, b, _ in there), min(a for a, _, _ in there), max(b for _, b, _ in there), len(there), round(sum(x["confidence"] for _, _, x in there), 9), sorted(x["id"] for _, _, x in there)
    assert got == want


def test_grid_of_a_short_history(spark):
    """No aligned end between the rows: the last second is the only end."""
    rows = [dict(made_rows(1)[0], id=str(i), subject_id="s0", ts=61 + i, data_type=S.CONTEXT, bundle_id="a") for i in range(3)]
    cat = Catalog(frame(spark, rows), 60, most=None)
    assert [(r["w_end"], r["n_ctx"]) for r in cat.windows.collect()] == [(63, 3)]
    assert [r["w_end"] for r in cat.ends.collect()] == [63]
    assert cat.windows.limit(0).collect() == []
    assert Catalog(frame(spark, rows).limit(0), 60).windows.collect() == []


def test_changes_and_carries(spark):
    rows = made_rows(3)
    changed = {r["id"]: r["changed"] for r in with_changes(frame(spark, rows)).collect()}
    assert len(changed) == len(rows)
    assert all(changed[x["id"]] is None for x in rows if not (x["bundle_id"] or x["category"]))
    points = spark.createDataFrame([("s", d, d * 10 + k, d + k) for d in (1, 2, 5) for k in range(4)], "subject_id string, chunk bigint, at bigint, one bigint")
    total, want = 0, {}
    for d in (1, 2, 5):
        for k in range(4):
            total += d + k
            want[d * 10 + k] = total
    assert {r["at"]: r["so_far"] for r in panes.carried(points, "one", ["at"], "so_far").collect()} == want
    assert W.MOST_ENDS == 1440
