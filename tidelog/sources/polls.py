"""Sources that poll: emit on change only, count by window, and read deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.windows import DAY


def changes(samples: DataFrame, keys: list[str], by: list[str], order: list[str], at: str = "ts") -> DataFrame:
    """Samples whose ``keys`` differ from those of the sample before, in the
    order of ``order``, which begins with the second ``at``.

    Days are scanned apart; each begins with the last sample of the day before
    it that has any, which takes one row a day to find.  Columns of ``samples``
    may have any names but those that begin with ``_day``.  A null ``by`` is a
    group, and null keys are values like others; null seconds are a day, the first."""
    if order[:1] != [at]:
        raise ValueError(f"order has to begin with {at!r}: {order}")
    rows = samples.withColumns({"_day": F.floor(F.col(at) / DAY), "_day_keys": F.struct(*keys), "_day_carried": F.lit(False)})
    place = F.struct(*order)
    last = rows.groupBy(*by, "_day").agg(F.max_by("_day_keys", place).alias("_day_keys"))
    following = F.lead(F.struct("_day")).over(Window.partitionBy(*by).orderBy("_day"))
    last = last.withColumn("_day_next", following).filter("_day_next is not null")
    carried = last.select(*by, F.col("_day_next._day").alias("_day"), "_day_keys", F.lit(True).alias("_day_carried"))
    within = Window.partitionBy(*by, "_day").orderBy(F.desc("_day_carried"), *order)
    rows = rows.unionByName(carried, allowMissingColumns=True).withColumn("_day_before", F.lag(F.struct("_day_keys")).over(within))
    new = F.col("_day_before").isNull() | ~F.col("_day_keys").eqNullSafe(F.col("_day_before._day_keys"))
    return rows.filter(new & ~F.col("_day_carried")).select(*samples.columns)


def counts_by_minute(samples: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """Tumbling counts; windows without a sample emit nothing."""
    start = (F.floor(F.col("ts") / seconds) * seconds).cast("bigint")
    return samples.groupBy(*by, start.alias("window_start")).agg(F.count("*").alias("count"))


def notifications_after(records: DataFrame, apps: DataFrame, watermark: float | None, limit: int = 64) -> DataFrame:
    """Delivered records with their application after the watermark, oldest
    first.  Without a watermark nothing is emitted: a first read only sets it
    (:func:`watermark_of`)."""
    joined = records.join(apps, "app_id")
    if watermark is None:
        return joined.limit(0)
    return joined.filter(F.col("delivered_date") > watermark).orderBy("delivered_date", "rec_id").limit(limit)


def watermark_of(records: DataFrame) -> DataFrame:
    return records.agg(F.max("delivered_date").alias("watermark"))


def git_activity(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, repositories) from two snapshots (repo, head, fetched_at, action):
    a new fetch is a sync, a new head the last action; the most telling kind
    stands for all: commit, sync, checkout, other."""
    old = before.select("repo", F.col("head").alias("old_head"), F.col("fetched_at").alias("old_fetch"))
    rows = after.join(old, "repo")
    action = F.lower("action")
    kind = F.when(F.col("head") != F.col("old_head"), F.when(action.startswith("commit"), "commit").when(action.startswith("checkout"), "checkout").when(action.startswith("pull") | action.startswith("fetch"), "sync").otherwise("other"))
    kind = F.coalesce(kind, F.when(F.col("fetched_at") > F.col("old_fetch"), "sync"))
    rank = F.when(F.col("kind") == "commit", 0).when(F.col("kind") == "sync", 1).when(F.col("kind") == "checkout", 2).otherwise(3)
    return rows.withColumn("kind", kind).filter("kind is not null").agg(F.min_by("kind", rank).alias("kind"), F.count_distinct("repo").alias("repositories")).filter("repositories > 0")
