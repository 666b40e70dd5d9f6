"""Keyed streaming state: two batches equal one batch over all rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import quality
from tidelog.plans.windows import DAY
from tidelog.streaming import state

pytest.importorskip("google.protobuf")  # Spark's own need for keyed state in Python
DDL = ", ".join(f"{k} {v}" for k, v in S.COLUMNS.items())


def typed(spark, rows: list[dict]):
    base = {"subject_id": "s0", "provider_id": "p", "confidence": 1.0, "created_at": 1, "src_kind": "apple_watch"}
    return spark.createDataFrame([tuple((base | r).get(c) for c in S.COLUMNS) for r in rows], DDL)


def beat(i: str, day: int, bpm: float, **more) -> dict:
    return {"id": i, "ts": 19000 * DAY + day * DAY + 100, "data_type": S.RESTING_HR, "bpm": bpm} | more


def run(spark, make, batches: list, tmp_path):
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        make(stream).awaitTermination(240)


def test_vitals_with_a_correction_and_a_deletion(spark, tmp_path):
    first = [beat(f"a{d}", d, 60.0 + d) for d in range(8)] + [beat(f"b{d}", d, 50.0 + d, subject_id="s1") for d in range(7)] + [beat("z", 40, 70.0, subject_id="s2")]
    mark = {"ts": 19000 * DAY + 9 * DAY, "data_type": S.DELETION, "created_at": 2}
    second = [beat("a2", 2, 90.0, created_at=2), beat("a9", 9, 75.0, created_at=2), {"id": "d1", "target_id": "a3"} | mark, {"id": "d2", "target_id": "a4", "provider_id": "other"} | mark]
    out = str(tmp_path / "out")
    run(spark, lambda stream: state.vitals_query(stream, out, str(tmp_path / "ck"), lateness=100 * DAY), [typed(spark, first), typed(spark, second)], tmp_path)
    got = state.current_vitals(spark, out, "resting_heart_rate")
    rows = [r for r in first if r["id"] not in ("a2", "a3")] + second[:2]
    want = state.all_vitals(typed(spark, rows))["resting_heart_rate"]
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.count() == 8 + 7 + 1
    assert spark.read.parquet(f"{out}/resting_heart_rate").filter("subject_id = 's1'").select("epoch").distinct().count() == 1  # untouched later


def test_vitals_forget_after_28_days(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [typed(spark, [beat("a", 0, 60.0), beat("b", 10, 61.0)]), typed(spark, [beat("c", 38, 62.0), beat("b", 10, 63.0, created_at=9)])]
    run(spark, lambda stream: state.vitals_query(stream, out, str(tmp_path / "ck"), lateness=100 * DAY), batches, tmp_path)
    assert sorted(r["bpm"] for r in state.current_vitals(spark, out, "resting_heart_rate").collect()) == [62.0, 63.0]


def raw(spark, rows: list[tuple]):
    made = [(i, "s", ts, "p", "heart_rate", 1.0, at, payload) for i, ts, at, payload in rows]
    return spark.createDataFrame(made, "id string, subject_id string, ts bigint, provider_id string, data_type string, confidence double, created_at bigint, payload string")


def test_copies_across_batches(spark, tmp_path):
    """A copy with a new id in a later batch goes; so does another content under
    an id that passed; a content that only a dropped row had may still come."""
    one = [("a", 100, 1, '{"hr": 60}'), ("b", 160, 2, '{"hr": 61}'), ("c", 100, 3, '{ "hr":60 }')]
    two = [("d", 100, 4, '{"hr": 60}'), ("a", 100, 5, '{"hr": 99}'), ("e", 160, 6, '{"hr": 61.0}'), ("c", 220, 7, '{"hr": 62}'), ("f", 100, 8, '{"hr": 99}')]
    out = str(tmp_path / "out")

    def query(stream):
        return state.first_wins(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(out)

    run(spark, query, [raw(spark, one), raw(spark, two)], tmp_path)
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.collect()) == ["a", "b", "c", "e", "f"]
    whole = quality.dedupe(raw(spark, one + two))
    assert sorted(map(str, got.select("id", "payload").collect())) == sorted(map(str, whole.select("id", "payload").collect()))


def test_numbers_keep_their_kind(spark):
    texts = ['{"x": 15}', '{"x": 15.0}', '{"x":15.00}', '{"y": "15.0", "x": 1}', '{"x": 1, "y": "15.0"}', '{"y": "15", "x": 1}', '{"q": "say \\"1.5\\" {"}', '{"q": "say 1.5"}', "15", "15.0", "no json 1.5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "payload string").select(F.coalesce(quality.fingerprint(), F.lit("none"))).collect()]
    assert got[0] != got[1] and got[1] == got[2]
    assert got[3] == got[4] and got[3] != got[5]
    assert json.loads(got[6]) == {"q": 'say "1.5" {'} and json.loads(got[7]) == {"q": "say 1.5"}
    assert got[8] != got[9] and got[10] == "none"
