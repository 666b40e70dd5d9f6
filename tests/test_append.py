"""Appends: which folders they look into, and what interrupted ones leave."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators import scans
from tidelog.plans.windows import DAY


def rows(spark, *given: tuple):
    made = [(i, "s", at, "p", kind, 1.0, None, "{}") for i, at, kind in given]
    return spark.createDataFrame(made, S.RAW_DDL)


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log")
    scans.append(rows(spark, *[(f"{k}{d}", d * DAY + 5, k) for d in range(6) for k in ("hrv", "steps")]), path, now=1)
    return path


def read_files(spark, new, path: str) -> list[str]:
    held = scans._held(new, spark.read.parquet(path), path)
    return sorted({f.split("/log/")[1].rsplit("/", 1)[0] for f in held.select(F.input_file_name().alias("f")).toPandas()["f"]})


def test_a_batch_reads_the_folders_of_its_ids(spark, log):
    """Ids that are new read nothing; an id that is held under another day or type is found there."""
    assert read_files(spark, rows(spark, ("new", 3 * DAY, "hrv")), log) == []
    again = rows(spark, ("hrv3", 3 * DAY + 5, "hrv"), ("new", 3 * DAY, "hrv"))
    assert read_files(spark, again, log) == ["data_type=hrv/day=3"]
    moved = rows(spark, ("steps4", DAY, "hrv"), ("hrv1", DAY + 5, "hrv"), ("later", DAY, "hrv"))
    assert read_files(spark, moved, log) == ["data_type=hrv/day=1", "data_type=steps/day=4"]
    assert [r["id"] for r in scans.append(moved, log).collect()] == ["later"]
    assert spark.read.parquet(log).count() == 13


def test_marks_without_rows_and_rows_without_marks(spark, log, tmp_path):
    """Marks of an interrupted append don't keep its rows out; a log of before gets marks."""
    new = rows(spark, ("lost", DAY, "hrv"), ("hrv0", 5, "hrv"))
    scans._marks_of(new.withColumn("day", F.lit(1))).write.mode("append").parquet(f"{log}/{scans.MARKS}")
    assert [r["id"] for r in scans.append(new, log).collect()] == ["lost"]
    bare = str(tmp_path / "bare" / "log")
    spark.read.parquet(log).write.partitionBy("data_type", "day").parquet(bare)
    assert [r["id"] for r in scans.append(rows(spark, ("lost", 0, "steps"), ("x", 0, "steps")), bare).collect()] == ["x"]
    assert spark.read.parquet(bare).count() == 14


def test_odd_rows(spark, log):
    """Empty batches, nulls in any column, types that paths escape, ids twice in a batch."""
    scans.append(rows(spark).limit(0), log)
    odd = rows(spark, (None, None, None), ("null day", None, "hrv"), ("null type", DAY, None), ("esc", DAY, "a/b=c %"), ("esc", DAY, "hrv"))
    scans.append(odd.filter("id is not null"), log, now=2)
    assert scans.append(odd.filter("id is not null"), log, now=3).count() == 0
    got = spark.read.parquet(log)
    assert got.count() == 15 and got.groupBy("id").count().filter("count > 1").isEmpty()
    assert scans.append(odd, log).count() == 1 == scans.append(odd, log).count()


def test_first_append_of_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    scans.append(rows(spark).limit(0), path)
    assert scans.append(rows(spark, ("a", 1, "hrv")), path).count() == 1
    assert scans.append(rows(spark, ("a", 1, "hrv")), path).count() == 0
