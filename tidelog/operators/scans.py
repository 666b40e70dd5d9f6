"""Reads and appends of an observation table, as views over one append-only log."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.quality import drop_deleted, drop_retracted
from tidelog.operators.stored import stored


class InvalidRange(ValueError):
    """The end of a range lies before its start."""


def visible(obs: DataFrame) -> DataFrame:
    """Without deleted and retracted rows, and without the markers."""
    return obs.transform(drop_retracted).transform(drop_deleted)


def between(obs: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of the closed range as they are stored, in order of (ts, id)."""
    if end < start:
        raise InvalidRange(f"{end} < {start}")
    return obs.filter(F.col("ts").between(start, end)).orderBy("ts", "id")


def visible_between(obs: DataFrame, start: int, end: int) -> DataFrame:
    if end < start:
        raise InvalidRange(f"{end} < {start}")
    # markers count wherever they stand, so the range comes after them
    return visible(obs).filter(F.col("ts").between(start, end)).orderBy("ts", "id")


def of_type(obs: DataFrame, data_type: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Visible rows of one type; asking for markers shows that kind of marker."""
    if start is not None and end is not None and end < start:
        raise InvalidRange(f"{end} < {start}")
    if data_type == S.RETRACTION:
        rows = drop_deleted(obs)
    elif data_type == S.DELETION:
        rows = drop_retracted(obs)
    else:
        rows = visible(obs)
    rows = rows.filter(F.col("data_type") == data_type)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    return rows.orderBy("ts", "id")


def of_types(obs: DataFrame, data_types: list[str], start: int, end: int) -> DataFrame:
    """Rows of several types without deleted ones; retractions don't count."""
    rows = drop_deleted(obs) if data_types else obs.limit(0)
    return rows.filter(F.col("data_type").isin(*data_types) & F.col("ts").between(start, end)).orderBy("ts", "id") if data_types else rows


def by_id(obs: DataFrame, id_: str) -> DataFrame:
    return obs.filter(F.col("id") == id_)


def after_cursor(obs: DataFrame, created_at: int, id_: str, limit: int) -> DataFrame:
    """The next page after the cursor (created_at, id), exclusive."""
    later = (F.col("created_at") > created_at) | ((F.col("created_at") == created_at) & (F.col("id") > id_))
    return obs.filter(later).orderBy("created_at", "id").limit(limit)


def last_cursor(obs: DataFrame) -> DataFrame:
    return obs.agg(F.max(F.struct("created_at", "id")).alias("c")).select("c.created_at", "c.id")


def type_summary(obs: DataFrame, since: int) -> DataFrame:
    return obs.filter(F.col("ts") >= since).groupBy("data_type").agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))


def is_retracted(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` (id) that a retraction names."""
    marks = obs.filter(F.col("data_type") == S.RETRACTION).select(F.col("target_id").alias("id"))
    return ids.join(marks, "id", "left_semi")


#: Folder of marks inside a log; readers of the log pass over it.
MARKS = "_marks"


def there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _marks_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("data_type").cast("string").alias("data_type"), F.col("day").cast("bigint").alias("day"), F.xxhash64("id").alias("mark"))


def folders_with(ids: DataFrame, path: str) -> DataFrame:
    """(data_type, day) of the folders of the log at ``path`` that may hold rows of
    ``ids`` (id), by their marks: 64-bit hashes of ids, eight bytes a row.  No
    folder that holds one is left out."""
    marks = ids.sparkSession.read.parquet(f"{path}/{MARKS}")
    return marks.join(ids.select(F.xxhash64("id").alias("mark")), "mark", "left_semi").select("data_type", "day").distinct()


def _held(ids: DataFrame, old: DataFrame, path: str) -> DataFrame:
    """Ids of the log in the folders that may hold one of ``ids``; no other is read."""
    folders = folders_with(ids, path).collect()  # types x days at most
    types, days = {r["data_type"] for r in folders}, {r["day"] for r in folders}
    if not folders:
        return old.select("id").limit(0)

    def among(name: str, kind: str, values: set) -> Column:
        column = F.col(name).cast(kind)
        return column.isin(*(values - {None})) | (column.isNull() if None in values else F.lit(False))

    table = ids.sparkSession.createDataFrame(folders, "data_type string, day bigint")
    rows = old.filter(among("data_type", "string", types) & among("day", "bigint", days))
    same = rows["data_type"].cast("string").eqNullSafe(table["data_type"]) & rows["day"].cast("bigint").eqNullSafe(table["day"])
    return rows.join(F.broadcast(table), same, "left_semi").select("id")


def append(new: DataFrame, path: str, now: int | None = None) -> DataFrame:
    """Appends rows whose id the table at ``path`` does not hold, stamped with
    created_at; a repeated append of the same rows changes nothing.  The table
    is partitioned by type and day, so that scans prune; the rows of a type and
    day meet in few files, and a large day is split.  Returns what it wrote.

    An append reads the marks of all ids and the ids of just the folders where
    marks meet its own.  Marks are written before their rows: an append that was
    interrupted between the two leaves marks without rows, which cost a look
    into their folder, and is repeated.  A log without marks gets them first.
    Rows of equal ids count once; a null id is never held.  Appends to one log
    go one after the other."""
    spark = new.sparkSession
    stamp = F.lit(int(time.time()) if now is None else now).cast("bigint")
    fresh = new.dropDuplicates(["id"]).withColumn("created_at", F.coalesce("created_at", stamp)).withColumn("day", F.floor(F.col("ts") / 86400))
    fresh, old = stored(fresh), there(spark, path)
    if old is not None:
        if there(spark, f"{path}/{MARKS}") is None:
            _marks_of(old).write.mode("overwrite").parquet(f"{path}/{MARKS}")
        fresh = stored(fresh.join(_held(fresh, old, path), "id", "left_anti"))
    _marks_of(fresh).hint("rebalance").sortWithinPartitions("data_type", "day", "mark").write.mode("append").parquet(f"{path}/{MARKS}")
    fresh.hint("rebalance", "data_type", "day").write.mode("append").partitionBy("data_type", "day").parquet(path)
    return fresh
