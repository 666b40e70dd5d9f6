"""Daily vitals against personal baselines: one row for each UTC day.

A baseline is the median of the earlier days' values within the look-back (the
day itself aside), given at least five of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.scores import clamp
from tidelog.plans.windows import DAY

LEAST_DAYS = 5


def day_of(ts: Column | str) -> Column:
    return (F.floor(F.col(ts) / DAY) * DAY if isinstance(ts, str) else F.floor(ts / DAY) * DAY).cast("bigint")


def with_baseline(daily: DataFrame, value: str, days: int, *also: str) -> DataFrame:
    """Adds baseline, delta and baseline_days to one row a day."""
    w = Window.partitionBy("subject_id", *also).orderBy("day").rangeBetween(-days * DAY, -1)
    n = F.count(value).over(w)
    base = F.when(n >= LEAST_DAYS, F.percentile(value, F.lit(0.5)).over(w))
    daily = daily.withColumn("baseline", base).withColumn("baseline_days", F.when(n >= LEAST_DAYS, n))
    return daily.withColumn("delta", F.col(value) - F.col("baseline"))


def evidence_columns() -> list[Column]:
    """Confidence (mean confidence times mean source quality), the most common
    source and the evidence of a group of observations."""
    quality = F.when(F.col("src_kind") == "apple_watch", 1.0).when(F.col("src_kind") == "manual", 0.3).otherwise(0.6)
    return [
        (F.avg("confidence") * F.avg(quality)).alias("confidence"),
        F.mode(F.coalesce("src_kind", F.lit("missing")), deterministic=True).alias("source"),
        F.array_sort(F.collect_list("id")).alias("evidence"),
        F.max("ts").alias("last_ts"),
    ]


def resting_heart_rate(obs: DataFrame) -> DataFrame:
    rows = obs.filter((F.col("data_type") == S.RESTING_HR) & F.col("bpm").isNotNull()).withColumn("day", day_of("ts"))
    daily = rows.groupBy("subject_id", "day").agg(F.max_by("bpm", F.struct("ts", "id")).alias("bpm"), *evidence_columns())
    return with_baseline(daily, "bpm", 14).select("subject_id", "day", F.greatest("day", "last_ts").alias("w_end"), "bpm", "baseline", "delta", "baseline_days", "confidence", "source", "evidence")


def hrv_method() -> Column:
    """An explicit method counts where its field is there, else the only field."""
    r, s = F.col("rmssd_ms").isNotNull(), F.col("sdnn_ms").isNotNull()
    named = F.when((F.col("hrv_method") == "rmssd") & r, "rmssd").when((F.col("hrv_method") == "sdnn") & s, "sdnn")
    return F.coalesce(named, F.when(r & ~s, "rmssd").when(s & ~r, "sdnn"))


def hrv_vs_baseline(obs: DataFrame) -> DataFrame:
    """The method with the latest sample of the day among those with a baseline."""
    rows = obs.filter(F.col("data_type") == S.HRV).withColumn("method", hrv_method()).filter("method is not null").withColumn("day", day_of("ts"))
    ms = F.when(F.col("method") == "rmssd", F.col("rmssd_ms")).otherwise(F.col("sdnn_ms"))
    daily = rows.withColumn("ms", ms).groupBy("subject_id", "method", "day").agg(F.avg("ms").alias("ms"), *evidence_columns())
    based = with_baseline(daily, "ms", 28, "method").filter("baseline is not null")
    pick = Window.partitionBy("subject_id", "day").orderBy(F.desc("last_ts"), "method")
    best = based.withColumn("place", F.row_number().over(pick)).filter("place = 1")
    return best.select("subject_id", "day", F.greatest("day", "last_ts").alias("w_end"), "method", "ms", "baseline", "delta", "baseline_days", "confidence", "source", "evidence")


def _sleep(obs: DataFrame) -> DataFrame:
    rows = obs.filter((F.col("data_type") == S.SLEEP) & F.col("start_s").isNotNull() & (F.col("end_s") >= F.col("start_s")))
    return rows.withColumn("day", day_of("end_s"))


def sleep_stages(obs: DataFrame) -> DataFrame:
    """Union of the intervals of each stage, the stages' shares and how regular
    bedtimes are (hours, without a wrap at midnight)."""
    rows = _sleep(obs)
    stage = F.when(F.col("stage").isNull() | (F.col("stage") == "asleep"), "plain").when(F.col("stage").isin("asleep_core", "asleep_deep", "asleep_rem"), F.substring("stage", 8, 4))
    parts = rows.withColumn("part", stage).filter("part is not null")
    before = Window.partitionBy("subject_id", "day", "part").orderBy("start_s", "end_s", "id").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end_s").over(before), F.col("start_s"))
    parts = parts.withColumn("added", F.greatest(F.lit(0), F.col("end_s") - F.greatest("start_s", covered)))
    lengths = parts.groupBy("subject_id", "day").agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("added"))), F.lit(0)).alias(p) for p in ("plain", "core", "deep", "rem")])
    nights = rows.groupBy("subject_id", "day").agg(F.min("start_s").alias("bed"), F.max("end_s").alias("last_end"), *evidence_columns())
    hour = F.pmod(F.col("bed"), F.lit(DAY)) / 3600.0
    w = Window.partitionBy("subject_id").orderBy("day").rangeBetween(-14 * DAY, -1)
    nights = nights.withColumn("hour", hour)
    spread = F.when(F.count("hour").over(w) >= 3, clamp((1 - F.stddev_pop("hour").over(w) / 3) * 100))
    out = nights.withColumn("bedtime_regularity", spread).join(lengths, ["subject_id", "day"])
    staged = F.col("core") + F.col("deep") + F.col("rem")
    total = staged + F.col("plain")
    out = out.filter(total > 0)
    share = [F.when(staged > 0, F.col(p) / staged).alias(f"{p}_share") for p in ("deep", "rem", "core")]
    return out.select("subject_id", "day", F.greatest("day", "last_end").alias("w_end"), (total / 60.0).alias("total_min"), (staged > 0).alias("stages"), *share, "bedtime_regularity", "confidence", "source", "evidence")


def nightly(obs: DataFrame, data_type: str, field: str) -> DataFrame:
    """Samples within the night that ends on a day (of two such nights, both
    count them); a day without such samples takes what no night claimed."""
    samples = obs.filter((F.col("data_type") == data_type) & F.col(field).isNotNull())
    nights = _sleep(obs).groupBy("subject_id", "day").agg(F.min("start_s").alias("night_start"), F.max("end_s").alias("night_end"))
    # a night is met by the days it covers, so that the join is on equal keys
    days = nights.withColumn("on", F.explode(F.sequence(day_of("night_start"), day_of("night_end"), F.lit(DAY).cast("bigint"))))
    inside = samples.withColumn("on", day_of("ts")).join(days, ["subject_id", "on"]).filter(F.col("ts").between(F.col("night_start"), F.col("night_end")))
    inside = inside.select("subject_id", "day", "id", "ts", "confidence", "src_kind", field)
    left = samples.join(inside.select("subject_id", "id").distinct(), ["subject_id", "id"], "left_anti").withColumn("day", day_of("ts"))
    left = left.join(inside.select("subject_id", "day").distinct(), ["subject_id", "day"], "left_anti").select(inside.columns)
    daily = inside.unionByName(left).groupBy("subject_id", "day").agg(F.avg(field).alias("mean"), F.min(field).alias("low"), *evidence_columns())
    return with_baseline(daily, "mean", 14).select("subject_id", "day", F.greatest("day", "last_ts").alias("w_end"), "mean", "low", "baseline", "delta", "baseline_days", "confidence", "source", "evidence")


def night_spo2(obs: DataFrame) -> DataFrame:
    return nightly(obs, S.SPO2, "spo2_percent")


def respiratory_rate(obs: DataFrame) -> DataFrame:
    return nightly(obs, S.RESPIRATORY, "breaths_per_min")


def wrist_temperature(obs: DataFrame) -> DataFrame:
    return nightly(obs, S.WRIST_TEMPERATURE, "celsius").drop("low")
