"""The log as a data source: batches, pruning, restarts and starts at the tip."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import scans
from tidelog.plans.windows import DAY
from tidelog.sources import log_source
from tidelog.streaming import live


def typed(spark, rows: list[dict]):
    base = {"subject_id": "s0", "provider_id": "p", "confidence": 1.0, "data_type": S.HEART_RATE, "ts": DAY}
    return spark.createDataFrame([tuple((base | r).get(c) for c in S.COLUMNS) for r in rows], S.TYPED_DDL)


@pytest.fixture
def source(spark):
    log_source.register(spark)
    return spark


def test_batch_reads_what_was_appended(source, tmp_path):
    rows = [{"id": f"a{i}", "ts": i * DAY // 2, "created_at": i, "bpm": 60.0 + i, "data_type": (S.HEART_RATE, S.RESTING_HR)[i % 2]} for i in range(20)]
    rows += [{"id": "odd", "created_at": 99, "data_type": "a/b=c", "subject_id": None}]
    log = typed(source, rows)
    scans.append(log, str(tmp_path / "log"))
    read = source.read.format(log_source.NAME).option("path", str(tmp_path / "log")).load()
    assert sorted(map(str, read.collect())) == sorted(map(str, log.collect()))
    some = (F.col("data_type") == S.HEART_RATE) & (F.col("ts") >= 5 * DAY)
    assert sorted(r["id"] for r in read.filter(some).collect()) == sorted(r["id"] for r in log.filter(some).collect())
    assert read.filter("data_type in ('heart_rate', 'a/b=c') AND ts < 100000").count() == 3


def test_groups_out_of_bounds_are_not_read(source, tmp_path, monkeypatch):
    scans.append(typed(source, [{"id": f"a{i}", "ts": i * DAY, "created_at": i} for i in range(10)]), str(tmp_path / "log"))
    reader = log_source.BatchReader(log_source.Folder(f"file://{tmp_path}/log"), source.createDataFrame([], S.TYPED_DDL).schema)
    count = lambda: sum(len(p.groups) for p in reader.partitions())
    assert count() == 10
    assert len(list(reader.pushFilters([log_source.GreaterThanOrEqual(("ts",), 8 * DAY), log_source.EqualTo(("data_type",), S.HEART_RATE)]))) == 2
    assert count() == 2
    monkeypatch.setattr(log_source, "PIECE", 1)
    assert len(reader.partitions()) == 2


def test_no_folder_and_bad_options(source, tmp_path):
    read = source.read.format(log_source.NAME)
    assert read.option("path", str(tmp_path / "none")).load().count() == 0
    with pytest.raises(Exception, match="neither"):
        read.option("form", "other").load().count()


def run(spark, tmp_path, log: str, name: str, **options):
    stream = spark.readStream.format(log_source.NAME).options(path=log, **options).load()
    out = str(tmp_path / name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(once=True).start(out).awaitTermination(120)
    return sorted(r["id"] for r in spark.read.schema(stream.schema).parquet(out).collect())


def test_stream_resumes_after_a_restart(source, tmp_path):
    """Rows of the cursor's own second with a greater id are new; no row comes twice."""
    log = str(tmp_path / "log")
    scans.append(typed(source, [{"id": i, "created_at": at} for i, at in (("a", 1), ("b", 5), ("c", 5))]), log)
    assert run(source, tmp_path, log, "out") == ["a", "b", "c"]
    scans.append(typed(source, [{"id": i, "created_at": at} for i, at in (("d", 5), ("e", 9), ("a", 9))]), log)
    assert run(source, tmp_path, log, "out") == ["a", "b", "c", "d", "e"]
    assert run(source, tmp_path, log, "out") == ["a", "b", "c", "d", "e"]


def test_stream_from_the_tip_has_no_backlog(source, tmp_path):
    log = str(tmp_path / "log")
    scans.append(typed(source, [{"id": "a", "created_at": 1}, {"id": "b", "created_at": 5}]), log)
    assert run(source, tmp_path, log, "tip", start="tip") == []
    scans.append(typed(source, [{"id": "c", "created_at": 6}, {"id": "d", "created_at": 7, "data_type": S.STEPS}]), log)
    assert run(source, tmp_path, log, "tip", start="tip") == ["c", "d"]


def test_live_alerts_from_the_tip(source, tmp_path):
    """Levels of touched subjects go out batch by batch; what was there before isn't read."""
    folder, log, names = tmp_path, str(tmp_path / "log"), ("table", "out", "ck")

    def add(subject: str, at: int, rmssd: int, created: int) -> None:
        rows = [(f"{subject}{at + t}", subject, at + t, "p", S.HRV, 1.0, created, f'{{"rmssd": {rmssd}}}') for t in range(0, 420, 60)]
        scans.append(source.createDataFrame(rows, S.RAW_DDL), log)

    def levels() -> dict:
        stream = source.readStream.format(log_source.NAME).options(path=log, form="raw", start="tip").load()
        live.live_query(stream, *[str(folder / n) for n in names], alerts=str(folder / "alerts")).awaitTermination(120)
        return {r["subject_id"]: r["level"] for r in live.current_alerts(source, str(folder / "alerts")).collect()} if (folder / "alerts").exists() else {}

    add("old", 900, 15, 1)
    assert levels() == {}
    add("a", 900, 15, 2)
    assert levels() == {"a": "red"}
    add("a", 40_000, 60, 3)
    add("b", 900, 60, 3)
    assert levels() == {"a": "green", "b": "green"}
