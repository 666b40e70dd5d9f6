"""Chart series, latest values, report runs and source summaries."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.quality import source_rank
from tidelog.plans.features import FEATURES, Catalog
from tidelog.plans.panes import merged_runs
from tidelog.plans.windows import DAY

#: Chart ranges as (span, step) in seconds.
RANGES = {"1h": (3600, 60), "8h": (28800, 300), "12h": (43200, 300), "1d": (86400, 900), "1w": (604800, 3600)}
COMPOSITES = ("focus_score", "fatigue_index", "recovery_score", "energy_score", "cognitive_load", "deep_work_score", "sustained_load")
#: Features where more is better; for the others less is.
HIGHER_IS_BETTER = ("focus_score", "recovery_score", "energy_score", "deep_work_score", "attention_stability", "activity_balance", "circadian_offset")


def feature_series(obs: DataFrame, range_: str, now: int, ids: list[str] | None = None) -> DataFrame:
    """Features of the rows of a chart range; only the asked ones and what they
    depend on are planned.  An unknown range gives an empty series."""
    span, step = RANGES.get(range_, (None, 60))
    names = [n for n in (ids or FEATURES) if n in FEATURES]
    rows = obs.filter(F.col("ts").between(now - span, now)) if span else obs.limit(0)
    return Catalog(rows, step).all(*names) if names else Catalog(rows, step).all().limit(0)


def latest(features: DataFrame) -> DataFrame:
    """The last window of each feature."""
    order = Window.partitionBy("subject_id", "feature_id").orderBy(F.desc("w_end"))
    return features.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def first_of_latest(features: DataFrame) -> DataFrame:
    """The last window of each feature; of rows at the same end, the one that
    ``position`` lists first."""
    order = Window.partitionBy("subject_id", "feature_id").orderBy(F.desc("w_end"), "position")
    return features.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def relative_time(ts: str, now: int) -> Column:
    """Age in words: under 45 s just now, then rounded minutes, hours and days."""
    up = lambda x: F.floor(x + 0.5).cast("bigint")
    age = F.greatest(F.lit(0), F.lit(now) - F.col(ts))
    minutes = up(age / 60)
    hours = up(minutes / 60)
    days = up(hours / 24)
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(f" {unit} ago"))
    return F.when(age < 45, "just now").when(minutes < 60, text(minutes, "min")).when(hours < 24, text(hours, "h")).when(days == 1, "yesterday").otherwise(text(days, "days"))


def value_text(value: str = "value") -> Column:
    """Whole numbers as they are, others with one decimal."""
    x = F.col(value)
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).when(x.isNotNull(), F.format_string("%.1f", x))


def reliability() -> Column:
    single = F.col("feature_id").isin(*COMPOSITES) & (F.size("factors") == 1)
    return F.when(F.col("confidence") < 0.5, "low").when(single, "single_input").otherwise("ok")


def tone() -> Column:
    better = F.col("feature_id").isin(*HIGHER_IS_BETTER)
    csr = F.col("feature_id") == "context_switch_rate"
    return F.when(F.col("value").isNull(), "neutral").when(csr, F.when(F.col("value") >= 2, "elevated").otherwise("ok")).when(better, F.when(F.col("value") < 55, "rough").otherwise("ok")).otherwise(F.when(F.col("value") > 55, "elevated").otherwise("ok"))


def stale(now: int) -> Column:
    return F.col("w_end") < now - 18 * 3600


def chart(features: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each window end, a column for each feature."""
    return features.groupBy("subject_id", "w_end").pivot("feature_id", ids).agg(F.last("value"))


def runs(features: DataFrame, gap: int = 120, window: int = 900) -> DataFrame:
    """Samples merged into runs while a window starts no later than ``gap`` after
    the run's end: first, last, low, high, count and trend (5 either way)."""
    out = merged_runs(
        features, ["subject_id", "feature_id"], "w_end", lambda before, at: at - window <= before + gap, window + gap,
        {
            "first": (F.min_by("value", "w_end"), F.min_by("first", "run_start")), "last": (F.max_by("value", "w_end"), F.max_by("last", "run_start")),
            "low": (F.min(F.round("value", 4)), F.min("low")), "high": (F.max(F.round("value", 4)), F.max("high")), "samples": (F.count("*"), F.sum("samples")),
        },
    ).withColumn("run_start", F.col("run_start") - window)
    move = F.col("last") - F.col("first")
    return out.withColumn("trend", F.when(move.isNull(), "n/a").when(move >= 5, "higher").when(move <= -5, "lower").otherwise("flat"))


def afternoon_baseline(obs: DataFrame, step: int = 60) -> DataFrame:
    """Mean focus of the afternoons (13 to 17 h) of up to seven days before each
    subject's last day.  Each afternoon is a subject of its own, so the grids
    span just its rows."""
    last = obs.groupBy("subject_id").agg((F.floor(F.max("ts") / DAY) * DAY).cast("bigint").alias("today"))
    day = (F.floor(F.col("ts") / DAY) * DAY).cast("bigint")
    rows = obs.join(last, "subject_id").withColumn("day", day)
    rows = rows.filter((F.col("day") < F.col("today")) & (F.col("day") >= F.col("today") - 7 * DAY) & (F.col("ts") - F.col("day")).between(13 * 3600, 17 * 3600))
    rows = rows.withColumn("subject_id", F.concat_ws("|", "subject_id", F.col("day").cast("string"))).select(obs.columns)
    focus = Catalog(rows, step)["focus_score"].filter("confidence >= 0.3")
    daily = focus.groupBy("subject_id").agg(F.avg("value").alias("focus"), F.avg("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return daily.select(F.substring_index("subject_id", "|", 1).alias("subject_id"), F.substring_index("subject_id", "|", -1).cast("bigint").alias("day"), "focus", "confidence", "evidence")


def source_report(obs: DataFrame, now: int, zone: str = "Europe/Belgrade") -> DataFrame:
    """Wearable rows of 30 days by source kind, application and device: last
    sample and reception, counts, coverage of local days, rank, and whether the
    kind leads some type."""
    rows = obs.filter(F.col("src_kind").isNotNull() & F.col("ts").between(now - 30 * DAY, now)).withColumn("rank", source_rank())
    lead = rows.groupBy("data_type").agg(F.min("rank").alias("lead"))
    rows = rows.join(lead, "data_type").withColumn("day", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), zone)))
    out = rows.groupBy("src_kind", "provider_id").agg(
        F.max("ts").alias("last_ts"), F.max("created_at").alias("last_received"), F.count_if(F.col("ts") >= now - DAY).alias("rows_24h"),
        F.count_if(F.col("ts") >= now - 7 * DAY).alias("rows_7d"), F.count("*").alias("rows_30d"), F.least(F.lit(1.0), F.count_distinct("day") / 30.0).alias("coverage"),
        F.min("rank").alias("rank"), F.bool_or(F.col("rank") == F.col("lead")).alias("active"),
    )
    return out


def source_channels(obs: DataFrame, since: int, types: list[str]) -> DataFrame:
    """Every known channel with its rows since a time, 0 where there are none."""
    known = obs.sparkSession.createDataFrame([(t,) for t in types], "data_type string")
    seen = obs.filter(F.col("ts") >= since).groupBy("data_type").agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))
    return known.join(seen, "data_type", "left").select("data_type", F.coalesce("rows", F.lit(0)).alias("rows"), "last_ts")


def channel_states(channels: DataFrame, collecting: Collection[str] = ()) -> DataFrame:
    """The frame of :func:`source_channels` with each channel's ``side`` (computer
    or watch), its ``place`` in a report and its ``state``: ``rows``, ``off`` (it has
    none and is switched off: not among ``collecting``) or ``none``."""
    known = [(t, side, i) for i, (t, side) in enumerate([(t, "computer") for t in S.COMPUTER_CHANNELS] + [(t, "watch") for t in S.WATCH_CHANNELS])]
    places = channels.sparkSession.createDataFrame(known, "data_type string, side string, place int")
    silent = [t for t in S.SWITCHED_CHANNELS if t not in collecting]
    state = F.when(F.col("rows") > 0, "rows").when(F.col("data_type").isin(silent), "off").otherwise("none")
    return channels.join(places, "data_type", "left").withColumn("state", state)


def life_events(obs: DataFrame, limit: int = 8, start: int | None = None, end: int | None = None) -> DataFrame:
    """The latest life events (1 to 32; within a range up to 500)."""
    rows = obs.filter(F.col("data_type") == S.LIFE_EVENT)
    most = max(1, min(32, limit))
    if start is not None and end is not None:
        rows, most = rows.filter(F.col("ts").between(start, end)), 500
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(most).select("subject_id", "id", "ts", "life_kind")


def alert_level(cat: Catalog, high_stress: DataFrame) -> DataFrame:
    """red with any high stress signal, yellow with a latest stress or fatigue
    over 60, else green; per subject."""
    subjects = cat.bounds.select("subject_id")
    red = high_stress.select("subject_id").distinct().withColumn("red", F.lit(True))
    recent = latest(cat.all("stress_index", "fatigue_index")).filter("value > 60").select("subject_id").distinct().withColumn("yellow", F.lit(True))
    out = subjects.join(red, "subject_id", "left").join(recent, "subject_id", "left")
    return out.select("subject_id", F.when(F.col("red"), "red").when(F.col("yellow"), "yellow").otherwise("green").alias("level"))
