"""The report on wearable sources: by kind, application and device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.quality import source_rank
from tidelog.plans.windows import DAY

WINDOW_DAYS, ZONE = 30, "Europe/Belgrade"
STAGED = ("asleep_core", "asleep_deep", "asleep_rem")


def samples(raw: DataFrame) -> DataFrame:
    """(data_type, ts, received_at, kind, app, device_model, stage) of raw rows
    whose payload names a known kind of source.  The application is its name,
    else its bundle, else ``unknown``."""
    said = F.from_json("payload", "src struct<kind string, app_name string, bundle_id string, device_model string>, stage string")
    rows = raw.withColumn("_said", said).filter(F.col("_said.src.kind").isin(*S.SOURCE_KINDS))
    src = F.col("_said.src")
    app = F.coalesce(src["app_name"], src["bundle_id"], F.lit("unknown"))
    return rows.select("data_type", "ts", F.col("created_at").alias("received_at"), src["kind"].alias("kind"), app.alias("app"), F.coalesce(src["device_model"], F.lit("")).alias("device_model"), F.col("_said.stage").alias("stage"))


def _window(rows: DataFrame, now: int) -> DataFrame:
    return rows.filter(F.col("ts").between(now - WINDOW_DAYS * DAY, now))


def report(rows: DataFrame, now: int, priority: tuple[str, ...] = S.SOURCE_PRIORITY) -> DataFrame:
    """A row for each source of the last 30 days, in order of rank, kind,
    application and device: last sample and reception, counts by type (24 hours,
    7 and 30 days), share of local days with samples, and whether the source leads
    some type.  Rows are summed by type and day before sources are compared."""
    ranked = _window(rows, now).withColumnRenamed("kind", "src_kind").withColumn("rank", source_rank(priority))
    key = ["src_kind", "app", "device_model"]
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), ZONE))
    since = lambda days: F.count_if(F.col("ts") >= now - days * DAY)
    daily = ranked.groupBy(*key, "data_type", "rank", day.alias("day")).agg(F.max("ts").alias("ts"), F.max("received_at").alias("received_at"), since(1).alias("last_24h"), since(7).alias("last_7d"), F.count("*").alias("last_30d"))
    counted = ("last_24h", "last_7d", "last_30d")
    by_type = daily.groupBy(*key, "data_type", "rank").agg(F.max("ts").alias("ts"), F.max("received_at").alias("received_at"), *[F.sum(c).alias(c) for c in counted], F.collect_set("day").alias("days"))
    lead = by_type.groupBy("data_type").agg(F.min("rank").alias("lead"))
    out = by_type.join(lead, "data_type").groupBy(*key, "rank").agg(
        F.max("ts").alias("last_ts"), F.max("received_at").alias("last_received"), F.array_sort(F.collect_list(F.struct("data_type", *counted))).alias("counts"),
        F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"), F.bool_or(F.col("rank") == F.col("lead")).alias("active"),
    )
    coverage = F.least(F.lit(1.0), F.col("days") / float(WINDOW_DAYS))
    out = out.select(F.col("src_kind").alias("kind"), "app", "device_model", "last_ts", "last_received", "counts", coverage.alias("coverage"), "rank", "active")
    return out.orderBy("rank", "kind", "app", "device_model")


def hints(rows: DataFrame, now: int) -> DataFrame:
    """(position, hint): what no source sends, in order; none without samples."""
    near = _window(rows, now)
    absent = [("no_hrv", S.HRV), ("no_oxygen_saturation", S.SPO2), ("no_respiratory_rate", S.RESPIRATORY), ("no_wrist_temperature", S.WRIST_TEMPERATURE)]
    has = lambda t: F.coalesce(F.bool_or(F.col("data_type") == t), F.lit(False))
    staged = F.coalesce(F.bool_or((F.col("data_type") == S.SLEEP) & F.col("stage").isin(*STAGED)), F.lit(False))
    found = [F.when(~has(t), name) for name, t in absent] + [F.when(~has(S.SLEEP), "no_sleep").when(~staged, "no_sleep_stages")]
    told = near.agg(F.count("*").alias("n"), F.array(*found).alias("hints")).filter("n > 0")
    return told.select(F.posexplode(F.array_compact("hints")).alias("position", "hint"))
