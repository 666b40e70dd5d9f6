"""A stored series, refreshed step by step, equals a run over the whole log."""

from __future__ import annotations

import random

from tidelog import schema as S
from tidelog.operators.scans import visible
from tidelog.plans import stored_series
from tidelog.plans.features import Catalog
from tidelog.plans.windows import DAY

NAMES = ("focus_score", "stress_index", "activity_balance", "recovery_score")


def typed(spark, rows: list[dict]):
    base = {"provider_id": "p", "confidence": 0.75, "src_kind": "apple_watch"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in S.COLUMNS) for r in rows], S.TYPED_DDL)


def some(rng: random.Random, name: str, subject: str, day: int, count: int, created: int) -> list[dict]:
    out = []
    for i in range(count):
        kind = rng.choice((S.HRV, S.KEYSTROKES, S.CONTEXT, S.STEPS, S.HEART_RATE, S.LIFE_EVENT))
        values = {S.HRV: {"rmssd_ms": rng.uniform(10, 80)}, S.KEYSTROKES: {"rate_per_min": rng.uniform(0, 90)}, S.CONTEXT: {"bundle_id": rng.choice("abc")}, S.STEPS: {"steps": rng.randrange(900)}, S.HEART_RATE: {"bpm": rng.uniform(50, 99)}, S.LIFE_EVENT: {"life_kind": "workout"}}
        out.append({"id": f"{name}{i}", "subject_id": subject, "ts": 100 * DAY + day * DAY + rng.randrange(0, DAY, 1800) + rng.randrange(900), "created_at": created, "data_type": kind} | values[kind])
    return out


def rows_of(df) -> list:
    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((r["feature_id"], r["subject_id"], r["w_end"], plain(r["value"]), plain(r["confidence"]), tuple(r["evidence"])) for r in df.collect())


def test_late_rows_markers_and_new_days(spark, tmp_path):
    rng = random.Random(11)
    path = str(tmp_path / "series")
    assert stored_series.series(spark, path).count() == 0
    log = some(rng, "a", "s0", 0, 12, 1) + some(rng, "b", "s0", 2, 12, 1) + some(rng, "c", "s1", 1, 12, 1)
    walk = next(r["id"] for r in log if r["subject_id"] == "s0" and r["data_type"] == S.LIFE_EVENT)
    last = max((r for r in log if r["subject_id"] == "s1"), key=lambda r: r["ts"])
    midnight = {"id": "m", "subject_id": "s0", "ts": 103 * DAY - 5, "created_at": 2, "data_type": S.HRV, "rmssd_ms": 20.0}
    marker = {"subject_id": "s0", "ts": 0, "created_at": 3}
    steps = [
        (log, 2 + 1 + 2),
        ([midnight, *some(rng, "d", "s0", 0, 3, 2)], None),
        ([{"id": "r", "target_id": walk, "data_type": S.RETRACTION} | marker, {"id": "x", "target_id": last["id"], "data_type": S.DELETION, "provider_id": "p"} | marker | {"subject_id": "s1"}], None),
        (some(rng, "e", "s2", 1, 4, 4) + [{"id": "n", "subject_id": None, "ts": 5, "created_at": 9, "data_type": S.HRV, "rmssd_ms": 9.0}], None),
    ]
    whole: list[dict] = []
    for rows, least in steps:
        whole += rows
        frame = typed(spark, whole)
        done = stored_series.refresh(frame, path, NAMES)
        assert done >= (least or 1)
        want = Catalog(visible(frame).filter("subject_id is not null"), most=None).all(*NAMES)
        assert rows_of(stored_series.series(spark, path)) == rows_of(want)
    assert stored_series.refresh(typed(spark, whole), path, NAMES) == 0


def test_only_what_is_touched_is_computed(spark, tmp_path):
    """One late row of one day: that day alone for local features; a refresh that
    left no marks isn't read, and its number is used again."""
    path = str(tmp_path / "series")
    log = [{"id": f"{s}{d}", "subject_id": s, "ts": (100 + d) * DAY + 300, "created_at": 1, "data_type": S.HRV, "rmssd_ms": 20.0 + d} for s in ("s0", "s1") for d in range(4)]
    assert stored_series.refresh(typed(spark, log), path, ("stress_index",)) == 8
    late = {"id": "late", "subject_id": "s0", "ts": 101 * DAY + 7000, "created_at": 2, "data_type": S.HRV, "rmssd_ms": 50.0}
    before = rows_of(stored_series.series(spark, path))
    assert stored_series.refresh(typed(spark, [*log, late]), path, ("stress_index",)) == 1
    after = rows_of(stored_series.series(spark, path))
    assert {r[2] // DAY for r in set(before) ^ set(after)} == {101}
    (tmp_path / "series" / "marks" / "version=2").rename(tmp_path / "lost")
    assert rows_of(stored_series.series(spark, path)) == before
    assert stored_series.refresh(typed(spark, [*log, late]), path, ("stress_index",)) == 1
    assert rows_of(stored_series.series(spark, path)) == after
