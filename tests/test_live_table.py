"""The raw table of the live query: folders by day, batches that are tried again, merged files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.plans.windows import DAY
from tidelog.streaming import live


class Batches:
    """Stands for a stream: hands the query's function out."""

    def __getattr__(self, name):
        return lambda *a, **k: self

    def foreachBatch(self, step):
        self.step = step
        return self

    @property
    def writeStream(self):
        return self


def batch(spark, *given):
    return spark.createDataFrame([(i, s, at, "p", S.HRV, 1.0, 1, '{"rmssd": 20}') for i, s, at in given], S.RAW_DDL)


def test_days_hold_every_batch_once(spark, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    stream = Batches()
    live.live_query(stream, table, out, "")
    first = batch(spark, *[(f"a{t}", "a", t) for t in range(900, 1320, 60)], ("late", "a", DAY + 1), ("none", "a", None))
    stream.step(first, 0)
    stream.step(batch(spark, ("b", "b", 950)), 1)
    stream.step(batch(spark).limit(0), 2)
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.is_dir()) == ["day=0", "day=1", "day=__HIVE_DEFAULT_PARTITION__"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["epoch=0", "epoch=1"]
    stream.step(first, 0)
    rows = spark.read.parquet(table)
    assert rows.count() == 10 and rows.select("id").distinct().count() == 10

    # a first try that wrote some rows only
    stream.step(batch(spark, ("c", "a", 1400)), 3)
    stream.step(batch(spark, ("c", "a", 1400), ("d", "a", 1500)), 3)
    rows = spark.read.parquet(table)
    assert sorted(r["id"] for r in rows.filter("epoch = 3").collect()) == ["c", "d"]

    def content():
        return sorted(map(str, spark.read.parquet(table).select("id", "subject_id", "ts", "data_type", "payload", "epoch", "day").collect()))

    before = content()
    files = lambda: len(list((tmp_path / "table" / "day=0").glob("*.parquet")))
    many = files()
    live.compact(spark, table, 0, 0)
    assert content() == before and files() < many
    level = spark.read.parquet(f"{out}/epoch=3").filter(F.col("feature_id") == "stress_index")
    assert level.count() == 1
