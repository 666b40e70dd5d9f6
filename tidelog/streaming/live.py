"""Streaming: append-only window counts, deduplication, and live snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.quality import drop_retracted, normalize, select_sources
from tidelog.operators.scans import there
from tidelog.operators.stored import stored
from tidelog.plans.features import Catalog, high_stress
from tidelog.plans.series import alert_level, latest
from tidelog.plans.windows import DAY

RETENTION = 1020


def fresh(stream: DataFrame, delay: int = RETENTION) -> DataFrame:
    """A stream of raw rows, each id once within the watermark (the state stays
    bounded, unlike a memory of all ids)."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{delay} seconds")
    return timed.dropDuplicatesWithinWatermark(["id"])


def window_counts(stream: DataFrame, slide: int = 60) -> DataFrame:
    """Rows by type in closed windows of 900 s every ``slide`` seconds.  A
    half-open window of 901 s holds the same whole seconds."""
    timed = stream if "event_time" in stream.columns else stream.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", f"{RETENTION} seconds")
    w = F.window("event_time", "901 seconds", f"{slide} seconds")
    out = timed.groupBy(w.alias("w"), "subject_id", "data_type").agg(F.count("*").alias("rows"), F.avg("confidence").alias("confidence"))
    return out.select("subject_id", "data_type", (F.unix_timestamp(F.col("w.end")) - 1).alias("w_end"), "rows", "confidence")


def retained(obs: DataFrame, seconds: int = RETENTION) -> DataFrame:
    """Each subject's rows of its last seconds."""
    last = obs.groupBy("subject_id").agg(F.max("ts").alias("last"))
    return obs.join(last, "subject_id").filter(F.col("ts") >= F.col("last") - seconds).drop("last")


def snapshot(obs: DataFrame, step: int = 60) -> tuple[DataFrame, DataFrame]:
    """Latest features and alert level of each subject's retained rows."""
    cat = Catalog(stored(retained(obs)), step, keep=True)
    return latest(cat.all()), alert_level(cat, high_stress(cat))


def live_query(stream: DataFrame, table: str, out: str, checkpoint: str, every: str | None = None, alerts: str | None = None) -> StreamingQuery:
    """Appends every micro-batch to the raw table and writes the snapshot of the
    subjects that it touched anew, in a folder of its epoch: a batch that is
    tried again adds the rows that its first try didn't write, and replaces its
    snapshot.  Retractions in a later batch take effect, as the snapshot reads
    the table through the marker filters.

    The table is partitioned by day alone, with the epoch as a column (so only
    files of the epoch itself are read for what a first try wrote); :func:`compact`
    merges a day's files.  A batch reads the days that its subjects'
    retained seconds can lie in.  With ``every`` (a processing time, such as
    ``10 seconds``) the query goes on; without, it ends with what is there.
    ``alerts`` takes the alert levels of touched subjects, epoch by epoch, for
    :func:`current_alerts`."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = stored(batch)
        span = rows.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
        days = F.col("day").isNull()
        if span["low"] is not None:
            days = days | F.col("day").between(span["low"] // DAY, span["high"] // DAY)
        old = there(spark, table)
        lacking = rows
        if old is not None:
            lacking = stored(rows.join(old.filter(days & (F.col("epoch") == epoch)).select("id"), "id", "left_anti"))
        lacking.withColumns({"day": F.floor(F.col("ts") / DAY), "epoch": F.lit(epoch).cast("bigint")}).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(table)
        if span["low"] is None:
            return
        touched = rows.select("subject_id").distinct()
        near = spark.read.parquet(table).filter(F.col("day") >= (span["low"] - RETENTION) // DAY).join(touched, "subject_id", "left_semi")
        first = Window.partitionBy("id").orderBy("created_at", "ts", "payload")
        near = near.withColumn("place", F.row_number().over(first)).filter("place = 1").select(*rows.columns)
        typed = stored(normalize(near).filter("valid").drop("valid").transform(drop_retracted).transform(select_sources))
        features, level = snapshot(typed)
        features.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        if alerts is not None:
            level.write.mode("overwrite").parquet(f"{alerts}/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def compact(spark: SparkSession, table: str, first: int, last: int) -> None:
    """Merges the files of the days ``first`` to ``last`` of a raw table, rows and
    epochs unchanged.  For days that no query writes at the time."""
    rows = stored(spark.read.parquet(table).filter(F.col("day").between(first, last)))
    rows.hint("rebalance", "day").sortWithinPartitions("epoch", "subject_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)


def current_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """(subject_id, level) as of each subject's last batch."""
    levels = spark.read.schema("subject_id string, level string, epoch bigint").parquet(alerts)
    return levels.groupBy("subject_id").agg(F.max_by("level", "epoch").alias("level"))
