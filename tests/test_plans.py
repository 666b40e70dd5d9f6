"""Small cases of the log's readers, the quality pipeline, runs and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidelog import schema as S
from tidelog.operators import life_events, quality, scans
from tidelog.plans import registry, report, series, wearables
from tidelog.plans.features import Catalog, high_stress
from tidelog.sources import ics, ingest, phone
from tidelog.streaming import live


def raw(spark, rows):
    """rows: (id, ts, data_type, payload) and maybe created_at."""
    full = [(r[0], "all", r[1], "p", r[2], 1.0, r[4] if len(r) > 4 else r[1], json.dumps(r[3])) for r in rows]
    return spark.createDataFrame(full, S.RAW_DDL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dedupe_replays_chains(spark):
    """a-1, a-2, b-2, b-3, c-3, ...: each row conflicts with the last.  20 and
    20.0 are two contents, as an integer and a float are."""
    rows, content = [], 0
    for k in range(20):
        rows += [(f"id{k:02d}", content, "hrv", {"rmssd": 20}, 2 * k), (f"id{k:02d}", content + 1, "hrv", {"rmssd": 20}, 2 * k + 1)]
        content += 1
    rows += [("z", 999, "hrv", {"rmssd": 20}), ("z2", 999, "hrv", {"rmssd": 20.0}), ("z3", 999, "hrv", {"rmssd": 21})]
    seen, want = set(), set()
    for r in sorted(rows, key=lambda r: (r[4] if len(r) > 4 else r[1], r[0])):
        key = (r[1], json.dumps(r[3]))
        if r[0] not in seen and key not in seen:
            want.add((r[0], r[1]))
            seen |= {r[0], key}
    got = quality.dedupe(raw(spark, rows)).select("id", "ts").collect()
    assert len(got) == len(want) and {(r["id"], r["ts"]) for r in got} == want


def test_normalize_aliases(spark):
    rows = [("1", 1, "hrv", {"hrv_ms": 40}), ("2", 1, "hrv", {"rmssd": "0.05", "unit": "s"}), ("3", 1, "hrv", {"rmssd": True}), ("4", 1, "heart_rate", {"hr": 1.5, "unit": "Hz"}), ("5", 1, "context_window", {"bundleId": " x "}), ("6", 1, "oxygen_saturation", {"spo2": 0.97}), ("7", 1, "unheard_of", {}), ("8", 1, "browser_category", {"category": "cooking"})]
    got = {r["id"]: r for r in quality.normalize(raw(spark, rows)).collect()}
    assert got["1"]["rmssd_ms"] == 40 and got["2"]["rmssd_ms"] == 50
    assert got["4"]["bpm"] == 90 and got["5"]["bundle_id"] == "x" and got["6"]["spo2_percent"] == pytest.approx(97)
    assert [k for k, r in sorted(got.items()) if not r["valid"]] == ["3", "8"]


@pytest.mark.parametrize("last, runs", [(1260, 1), (1200, 0)])
def test_high_stress_is_strict(spark, last, runs):
    rows = [(f"{t}", t, "hrv", {"rmssd": 15}) for t in range(900, last + 1, 60)]
    typed = quality.normalize(raw(spark, rows)).filter("valid").drop("valid")
    assert high_stress(Catalog(typed, 60)).count() == runs


def test_append_is_repeatable(spark, tmp_path):
    rows = raw(spark, [("a", 1, "hrv", {"rmssd": 20}), ("b", 90000, "hrv", {"rmssd": 20})])
    path = str(tmp_path / "log")
    scans.append(rows, path)
    scans.append(rows, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(scans.InvalidRange):
        scans.between(rows, 2, 1)
    assert [r["id"] for r in scans.between(rows, 1, 1).collect()] == ["a"]


def test_calendar_texts(spark):
    text = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:one\r\n two\r\nDTSTART:20240101T100000Z\r\nDURATION:PT1H30M\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:day\r\nDTSTART;VALUE=DATE:20240102\r\nTRANSP:TRANSPARENT\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20240101T100000Z\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    got = {r["uid"]: r for r in ics.events(spark.createDataFrame([(text,), (None,)], "ics string")).collect()}
    assert set(got) == {"onetwo", "day"}
    assert got["onetwo"]["end_s"] - got["onetwo"]["start_s"] == 5400 and got["onetwo"]["busy"]
    assert got["day"]["all_day"] and not got["day"]["busy"] and got["day"]["end_s"] - got["day"]["start_s"] == 86400


def test_live_query(spark, tmp_path):
    rows = raw(spark, [(f"{t}", t, "hrv", {"rmssd": 15}) for t in range(900, 1300, 60)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.live_query(live.fresh(stream).drop("event_time"), str(tmp_path / "table"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter(F.col("feature_id") == "stress_index").count() == 1
    counts = live.window_counts(spark.read.parquet(str(tmp_path / "in")), 60).collect()
    assert {r["w_end"] % 60 for r in counts} == {0}
    assert max(r["rows"] for r in counts) == 7


def test_report_is_whole(spark, tmp_path):
    """No section is cut, and lines stand by section, subject and time."""
    runs = spark.range(12_000).selectExpr("concat('s', id % 2) AS subject_id", "id AS at", "concat('- run ', id) AS line")
    report.write(spark, "daily_v1", {"features": runs, "insights": runs.limit(0)}, f"{tmp_path}/report")
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/report").filter("value like '- run%'").collect()]
    assert len(got) == 12_000
    files = sorted((tmp_path / "report").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert [int(x[6:]) for x in text.split("\n") if x.startswith("- run")] == [*range(0, 12_000, 2), *range(1, 12_000, 2)]
    assert text.startswith("# Report daily_v1\n\n## Features\n\n- run 0\n") and text.count("No entries.") == 3
    one = report.render(spark, "features_v1", {"features": runs}, "s1")
    assert one.split("\n")[:5] == ["# Report features_v1", "", "## Features", "", "- run 1"] and one.count("- run") == 6_000


def test_check_judges_each_row(spark):
    """A bad payload is refused, and only that row, whatever shares its id."""
    rows = [("a", "all", 1, "p", "heart_rate", 1.0, 1, json.dumps({"hr": 60}), "x"), ("a", "all", 1, "p", "heart_rate", 1.0, 2, json.dumps({"hr": "bad"}), "y"), ("b", "all", 1, "p", "heart_rate", 2.0, 2, json.dumps({"hr": 61}), "z"), ("c", "all", 1, "p", "step_count", 1.0, 2, json.dumps({"count": 5, "pad": "p" * (2 << 20)}), "w")]
    df = spark.createDataFrame(rows, S.RAW_DDL + ", batch_id string")
    got = {r["batch_id"]: r["problem"] for r in ingest.check(df).collect()}
    assert got == {"x": None, "y": "missing finite bpm", "z": "confidence", "w": None}
    why = {r["batch_id"]: r["reason"] for r in ingest.reviewed(df).collect()}
    assert why == {"x": None, "y": "missing finite bpm", "z": "confidence", "w": "over 2097152 bytes"}
    assert [r["batch_id"] for r in ingest.accepted(df).collect()] == ["x"]


def test_payloads_are_judged_strictly(spark):
    """What was sent counts, not what could be made of it."""
    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    cases = [
        ("heart_rate", {"bpm": "72"}, "missing finite bpm"), ("heart_rate", {"bpm": 300}, None), ("heart_rate", {"bpm": None, "hr": 60.5}, None), ("heart_rate", [60], "payload is no object"),
        ("heart_rate", {"bpm": 60, "src": {"kind": "iphone"}}, None), ("heart_rate", {"bpm": 60, "src": {"kind": "phone"}}, "src.kind"), ("heart_rate", {"bpm": 60, "src": "iphone"}, "src is no object"), ("heart_rate", {"bpm": 60, "src": {}}, "src.kind"),
        ("heart_rate", {"bpm": 60, "src": {"kind": "iphone", "device_name": "x"}}, "src.device_name is not stored"), ("workout", {}, "activity_type"), ("workout", {"activity_type": "run", "start": 1, "end": 2}, None), ("workout", {"activity_type": " ", "start": 1, "end": 2}, "activity_type"),
        ("stand_hour", {}, "missing start"), ("stand_hour", {"start": 1.0, "end": 2}, "missing start"), ("stand_hour", {"start": 3, "end": 2}, "end before start"), ("basal_energy", {"x": 1}, "missing finite kcal"), ("hrv", {"sdnn_ms": 20, "rmssd_ms": 30, "method": "sdnn"}, "method"),
        ("hrv", {"rmssd": 30, "method": "rmssd"}, None), ("hrv", {"sdnn": 20, "rmssd": 30}, None), ("hrv", {"rmssd": 30, "method": 1}, "method"), ("hrv", {"rmssd": 30, "method": None}, "method"), ("oxygen_saturation", {"spo2_percent": 20}, None), ("oxygen_saturation", {"spo2_percent": 101}, "spo2_percent"),
        ("oxygen_saturation", {"spo2": 97}, "spo2_percent"), ("life_event", {"kind": "coffee", "logged_at": -5}, "logged_at"), ("life_event", {"kind": "coffee", "logged_at": 5.0}, "logged_at"), ("life_event", {"kind": "coffee", "edited_from": uuid, "note": "n", "duration_secs": 0.5}, None),
        ("life_event", {"kind": "coffee", "edited_from": "x"}, "edited_from"), ("life_event", {"kind": "Coffee"}, "kind"), ("step_count", {"count": 5.0}, None), ("step_count", {"count": 5.5}, "count"), ("step_count", {"count": 5, "window_secs": 0}, "window_secs"),
        ("sleep_interval", {"start": 1.0, "end": 5, "stage": "asleep"}, None), ("sleep_interval", {"start": 1, "end": 5, "stage": "deep"}, "stage"), ("source_deletion", {"target_id": uuid}, None), ("source_deletion", {"target_id": "no"}, "target_id"), ("active_energy", {"kcal": -1}, "kcal"),
    ]
    rows = [(f"{k}", "all", 1, "p", t, 1.0, 1, json.dumps(p), f"b{k}") for k, (t, p, _) in enumerate(cases)]
    rows += [("bad", "all", 1, "p", "heart_rate", 1.0, 1, "{", "bad"), ("nil", "all", 1, "p", "heart_rate", 1.0, 1, None, "nil"), ("own", "all", 1, "p", "keystrokes", 1.0, 1, "{}", "own")]
    df = spark.createDataFrame(rows, S.RAW_DDL + ", batch_id string")
    got = {r["id"]: r["problem"] for r in ingest.check(df).collect()}
    want = {f"{k}": w for k, (_, _, w) in enumerate(cases)} | {"bad": "payload is no JSON", "nil": "payload is no JSON", "own": "type not allowed"}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {}
    out = ingest.refused(df).collect()
    assert {r["id"] for r in out} == {k for k, w in want.items() if w} and all(r["batch_reason"] == r["problem"] for r in out)
    assert {r["id"] for r in ingest.accepted(df).collect()} == {k for k, w in want.items() if not w}
    mark = df.filter("data_type = 'source_deletion'").limit(1)
    assert [r["problem"] for r in ingest.check(mark, "q").collect()] == ["provider of a deletion"]


def test_registry_orders_and_refuses(spark):
    nodes = registry.Registry()
    nodes.register(registry.Node("c", lambda cat: cat["focus_score"], ("b",)))
    nodes.register(registry.Node("b", lambda cat: cat["context_switch_rate"], ("a",)))
    with pytest.raises(registry.UnknownDependency):
        nodes.ordered()
    nodes.register(registry.Node("a", lambda cat: cat["stress_index"]))
    assert nodes.ordered() == ["a", "b", "c"] and nodes.ordered(["b"]) == ["a", "b"]
    with pytest.raises(registry.DuplicateNode):
        nodes.register(registry.Node("a", lambda cat: cat["stress_index"]))
    nodes.register(registry.Node("x", lambda cat: cat["stress_index"], ("y",)))
    nodes.register(registry.Node("y", lambda cat: cat["stress_index"], ("x",)))
    with pytest.raises(registry.DependencyCycle):
        nodes.ordered(["x"])
    order = registry.full_catalog().ordered()
    assert len(order) == 27 and order.index("fatigue_index") < order.index("sustained_load")
    rows = raw(spark, [(f"{t}", t, "hrv", {"rmssd": 15}) for t in range(900, 1300, 60)])
    typed = quality.normalize(rows).filter("valid").drop("valid")
    got = registry.full_catalog().run(Catalog(typed, 60), ["stress_index", "night_spo2"])
    assert {r["feature_id"] for r in got.collect()} == {"stress_index"}


def test_life_events_keep_to_their_limits(spark):
    """Bounds of time by request, copies that name their event, one restore."""
    now = 1_000_000
    asked = spark.createDataFrame([("old", "s", now - 86401), ("edge", "s", now - 86400), ("soon", "s", now + 60), ("late", "s", now + 61), ("now", "s", None)], "id string, subject_id string, ts long")
    log = life_events.log(asked, "walk", now)
    assert sorted((r["id"], r["logged_at"]) for r in log.collect()) == [("edge", now), ("now", now), ("soon", now)]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    gone = log.unionByName(life_events.retract(log, ids("edge", "now"), now + 5))
    back = life_events.restore(gone, ids("edge", "soon"), now + 10)
    assert [(r["edited_from"], r["ts"], r["logged_at"]) for r in back.collect()] == [("edge", now - 86400, now)]
    both = gone.unionByName(back)
    assert life_events.restore(both, ids("edge"), now + 99).isEmpty()
    moves = spark.createDataFrame([("soon", now - 90000), ("soon", now + 9999)], "id string, new_ts long")
    assert life_events.retime(both, moves, now).isEmpty()
    moved = both.unionByName(life_events.retime(both, spark.createDataFrame([("soon", now - 7)], "id string, new_ts long"), now + 20))
    assert sorted((r["ts"], r["edited_from"]) for r in scans.visible(moved).collect()) == [(now - 86400, "edge"), (now - 7, "soon")]
    assert life_events.restore(moved, ids("soon"), now + 30).isEmpty()


def test_life_events_are_appended(spark):
    asked = spark.createDataFrame([("e1", "s", 100), ("e2", "s", None)], "id string, subject_id string, ts long")
    first = life_events.log(asked, "coffee", 500)
    assert sorted((r["id"], r["ts"]) for r in first.collect()) == [("e1", 100), ("e2", 500)]
    with pytest.raises(life_events.UnknownKind):
        life_events.log(asked, "juggling", 500)
    moved = first.unionByName(life_events.retime(first, spark.createDataFrame([("e1", 200), ("no", 1)], "id string, new_ts long"), 600))
    assert sorted(r["ts"] for r in scans.visible(moved).collect()) == [200, 500]
    gone = moved.unionByName(life_events.retract(moved, spark.createDataFrame([("e2",), ("e1",)], "id string"), 700))
    assert [r["ts"] for r in scans.visible(gone).collect()] == [200]
    back = gone.unionByName(life_events.restore(gone, spark.createDataFrame([("e2",)], "id string"), 800))
    assert sorted(r["ts"] for r in scans.visible(back).collect()) == [200, 500]


RECORD = "uuid string, subject_id string, identifier string, start long, end long, value double, category string, activity_type string, kcal double, meters double, bundle_id string, product_type string, hardware_version string, was_user_entered boolean, app_name string, device_model string, device_label string"


def test_phone_records_become_raw_rows(spark):
    heart, sleep = "HKQuantityTypeIdentifierHeartRate", "HKCategoryTypeIdentifierSleepAnalysis"
    watch = ("com.apple.health.1", "Watch6,1", None, False, "Health", "Watch", "wrist")
    rows = [
        ("A", "s", heart, 10, 20, 61.0, None, None, None, None, *watch),
        ("B", "s", sleep, 10, 5, None, "5", None, None, None, "com.huami.watch", "iPhone1", None, False, None, None, ""),
        ("C", "s", "HKQuantityTypeIdentifierOxygenSaturation", 10, 20, 0.97, None, None, None, None, "x.y", "iPhone1", None, False, None, None, None),
        ("D", "s", "HKWorkoutTypeIdentifier", 10, 20, None, None, None, 50.0, None, "x.y", None, None, None, None, None, None),
        ("E", "s", "no such type", 10, 20, 5.0, None, None, None, None, *watch[:3], True, *watch[4:]),
        ("F", "s", sleep, 10, 50, None, "nap", None, None, None, *watch),
    ]
    got = {r["id"]: r for r in phone.to_raw(spark.createDataFrame(rows, RECORD), "salt").collect()}
    said = {k: json.loads(r["payload"]) for k, r in got.items()}
    assert {k: (r["data_type"], r["ts"]) for k, r in got.items()} == {"a": ("heart_rate", 20), "b": ("sleep_interval", 10), "c": ("oxygen_saturation", 20), "d": ("workout", 20), "e": ("heart_rate", 20), "f": ("sleep_interval", 10)}
    assert {k: p["src"]["kind"] for k, p in said.items()} == {"a": "apple_watch", "b": "zepp_life", "c": "iphone", "d": "other_app", "e": "manual", "f": "apple_watch"}
    assert said["a"]["src"]["device_label_hash"] == hashlib.sha256(b"saltwrist").hexdigest() and "device_label_hash" not in said["b"]["src"]
    assert said["b"]["end"] == 10 and said["b"]["stage"] == "asleep_rem" and said["f"]["stage"] == "unknown"
    assert said["c"]["spo2_percent"] == 97 and said["d"]["kcal"] == 50 and said["d"]["activity_type"] == "other" and "bpm" not in said["c"]


def test_backfill_reads_every_sample_once(spark):
    now = 400 * 86400
    made = [("hrv", f"{i:03d}", now - 86400 * i // 2) for i in range(100)] + [("spo2", "x", now - 5), ("spo2", "y", now - 399 * 86400)]
    samples = spark.createDataFrame(made, "data_type string, id string, end long")
    cursors = phone.fresh_cursors(samples.select("data_type").distinct(), now)
    seen = []
    for _ in range(20):
        rows = phone.backfill_pages(samples, cursors, now, page=30).orderBy("data_type", "place").collect()
        seen += [(r["data_type"], r["id"]) for r in rows]
        page = spark.createDataFrame(rows, "data_type string, id string, end long, place int")
        done = phone.advance(cursors, page, now, page=30).collect()
        if all(r["phase"] == "done" for r in done):
            break
        cursors = spark.createDataFrame(done, "data_type string, phase string, cursor_end long")
    assert [i for t, i in seen if t == "hrv"] == [f"{i:03d}" for i in range(1, 100)]  # the end of a page is exclusive
    assert [i for t, i in seen if t == "spo2"] == ["x"]


def test_queue_and_bodies(spark):
    items = [("a", i, f"k{i % 7}", "x" * 10) for i in range(20)] + [("b", i, f"k{i}", "y" * (40 if i == 1 else 3)) for i in range(6)]
    df = spark.createDataFrame(items, "sender string, position long, dedupe_key string, body string")
    queue = phone.queued(df, 5)
    assert sorted((r["sender"], r["position"]) for r in queue.collect()) == [(s, i) for s in "ab" for i in range(5)]
    got = {(r["sender"], r["position"]): r["batch"] for r in phone.bodies(queue, 3, 26).collect()}
    assert [got["a", i] for i in range(5)] == [0, 0, 1, 1, 2]
    assert [got["b", i] for i in range(5)] == [0, 1, 2, 2, 2]


def test_priorities():
    assert quality.priority_of(["manual", "tv", "manual"])[:2] == ("manual", "apple_watch")
    assert quality.priority_from_toml('order = ["zepp_life", 3]')[0] == "zepp_life"
    assert quality.priority_from_toml("order = [") == quality.priority_from_toml("x = 1") == S.SOURCE_PRIORITY


def test_wearable_hints(spark):
    sleep = ("1", 100, "sleep_interval", {"stage": "asleep", "src": {"kind": "manual"}})
    staged = ("2", 100, "sleep_interval", {"stage": "asleep_rem", "src": {"kind": "manual"}})
    hrv = ("3", 100, "hrv", {"src": {"kind": "zepp_life", "bundle_id": "b"}})
    other = ("4", 100, "respiratory_rate", {"src": {"kind": "toaster"}})
    told = lambda *rows: [r["hint"] for r in wearables.hints(wearables.samples(raw(spark, rows)), 200).orderBy("position").collect()]
    absent = ["no_oxygen_saturation", "no_respiratory_rate", "no_wrist_temperature"]
    assert told(sleep, hrv, other) == [*absent, "no_sleep_stages"] and told(sleep, staged, hrv) == absent
    assert told(hrv) == [*absent, "no_sleep"] and told(other) == []
    rows = wearables.report(wearables.samples(raw(spark, [hrv, sleep])), 200, quality.priority_of(["manual"])).collect()
    assert [(r["kind"], r["app"], r["rank"], r["active"]) for r in rows] == [("manual", "unknown", 0, True), ("zepp_life", "b", 3, True)]


def test_texts_of_a_report(spark):
    ages = spark.createDataFrame([(t,) for t in (1044, 1000, 0, -3000, -90_000, -300_000)], "ts long").select(series.relative_time("ts", 1045))
    assert [r[0] for r in ages.collect()] == ["just now", "1 min ago", "17 min ago", "1 h ago", "yesterday", "4 days ago"]
    values = spark.createDataFrame([(2.0,), (2.25,), (None,)], "value double").select(series.value_text())
    assert [r[0] for r in values.collect()] == ["2", "2.3", None]
    run = spark.createDataFrame([("s", "f", 0, 900, 1.5, None, float("nan"), 2.0, 3, "n/a")], "subject_id string, feature_id string, run_start long, run_end long, first double, last double, low double, high double, samples long, trend string")
    assert report.feature_lines(run).first()["line"] == "- f [0..900]: first 1.5000, last n/a, low n/a, high 2.0000, 3 samples, n/a"
    same = spark.createDataFrame([("s", "f", 5, 1, 0.1), ("s", "f", 5, 0, 0.2), ("s", "f", 4, 2, 0.3)], "subject_id string, feature_id string, w_end long, position int, value double")
    assert [r["value"] for r in series.first_of_latest(same).collect()] == [0.2]
    events = spark.createDataFrame([("s", "b", 5, 9, "walk"), ("s", "a", 5, 6, "cof|fee")], "subject_id string, id string, ts long, created_at long, life_kind string")
    lines = [r["line"] for r in report.life_event_lines(events).collect()]
    assert lines[1:] == ["| cof\\|fee | 5 | 6 | observation:a |", "| walk | 5 | 9 | observation:b |"] and lines[0].startswith("| event")
    assert report.health_context('[health_context]\nconditions = [" migraine_prone", "x"]\nnote = " n "') == (["migraine_prone"], "n")
    assert report.health_context("[health_context]\nnote = ''") is None and report.health_context("[") is None
