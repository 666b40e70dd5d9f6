"""The registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import oracle_sql as O
from tidelog import schema as S
from tidelog.operators import life_events, quality, scans
from tidelog.operators.stored import shared_path, stored
from tidelog.plans import rules, series, stored_series, vitals, wearables
from tidelog.plans.features import FEATURES, Catalog, high_stress
from tidelog.sources import log_source, polls
from tidelog.sources.events import raw_observations, typed_observations
from tidelog.streaming import live

STEP = O.STEP
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Query names of the features.
FEATURE_QUERIES = {
    "csr_series": "context_switch_rate", "focus_series": "focus_score", "stress_series": "stress_index", "fatigue_series": "fatigue_index",
    "meeting_density": "meeting_density", "meeting_gaps": "meeting_recovery", "recovery_series": "recovery_score", "distraction_series": "distraction_score",
    "media_share": "media_share", "git_rate": "git_rate", "light_share": "light_share", "activity_balance": "activity_balance",
    "energy_series": "energy_score", "sleep_debt": "sleep_debt", "notification_pressure": "notification_pressure", "cognitive_load": "cognitive_load",
    "deep_work": "deep_work_score", "attention_stability": "attention_stability", "desk_away": "desk_away", "circadian_offset": "circadian_offset",
    "sustained_load": "sustained_load",
}


def digest(features: DataFrame, *also: str) -> DataFrame:
    factor = F.transform("factors", lambda f: F.concat(f["id"], F.lit("="), F.round(f["share"] * 10000).cast("bigint").cast("string")))
    return features.select("subject_id", *also, "w_end", F.round(F.col("value") + 1e-9, 6).alias("value"), F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), F.size("evidence").cast("bigint").alias("n_evidence"), F.md5(F.array_join("evidence", ",")).alias("evidence_md5"), F.array_join(factor, ",").alias("factors"))


def _feature_query(name: str) -> Query:
    """A feature; rows and windows that several parts of it read are written once."""
    if name in ("sustained_load", "cognitive_load"):
        return lambda spark, sf_dir: digest(Catalog(stored(typed_observations(spark, sf_dir)), STEP, keep=True, most=O.MOST, names=(name,))[name])
    return lambda spark, sf_dir: digest(Catalog(typed_observations(spark, sf_dir), STEP, most=O.MOST)[name])


def _asked(obs: DataFrame, names: Sequence[str]) -> Catalog:
    """Features for queries that don't return evidence."""
    return Catalog(obs, STEP, keep=True, most=O.MOST, names=names, evidence=False)


for _query, _name in FEATURE_QUERIES.items():
    assert _name in FEATURES
    QUERIES[_query] = _feature_query(_name)
    ORACLES[_query] = O.feature(_name)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a function of the typed observations under a name."""

    def put(build: Callable[[DataFrame], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(typed_observations(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return QUERIES[name]

    return put


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, places) for c in columns})


def _vital(df: DataFrame, *columns: str) -> DataFrame:
    out = df.withColumn("evidence_md5", F.md5(F.array_join("evidence", ","))).drop("evidence")
    return rounded(out, *columns, "confidence")


@query("grid_cap", O.feature("context_switch_rate", 60, 1440))
def _grid_cap(obs: DataFrame) -> DataFrame:
    return digest(Catalog(obs, 60)["context_switch_rate"])


@query("high_stress_runs", f"WITH {O.feature_ctes(most=O.MOST)}, {O.high_stress_ctes()} SELECT subject_id, start_ts, end_ts, samples FROM high")
def _high_stress(obs: DataFrame) -> DataFrame:
    return high_stress(Catalog(obs, STEP, most=O.MOST)).select("subject_id", "start_ts", "end_ts", "samples")


@query("alert_level", O.alert_level())
def _alert(obs: DataFrame) -> DataFrame:
    cat = Catalog(obs, 60)
    return series.alert_level(cat, high_stress(cat))


@query("resting_hr_daily", O.resting_hr_daily())
def _resting(obs: DataFrame) -> DataFrame:
    return _vital(vitals.resting_heart_rate(obs), "baseline", "delta")


@query("hrv_vs_baseline", O.hrv_vs_baseline())
def _hrv(obs: DataFrame) -> DataFrame:
    return _vital(vitals.hrv_vs_baseline(obs), "ms", "baseline", "delta")


@query("sleep_stages_daily", O.sleep_stages_daily())
def _stages(obs: DataFrame) -> DataFrame:
    return _vital(vitals.sleep_stages(obs), "total_min", "deep_share", "rem_share", "core_share", "bedtime_regularity")


@query("night_spo2", O.night_spo2())
def _spo2(obs: DataFrame) -> DataFrame:
    return _vital(vitals.night_spo2(obs), "mean", "baseline", "delta")


def _instead_of_oxygen(obs: DataFrame, data_type: str, column: str, sql: str) -> DataFrame:
    """The oxygen samples as another nightly measure, which the events lack."""
    own = F.col("data_type") == S.SPO2
    return obs.withColumns({column: F.when(own, F.expr(sql)), "data_type": F.when(own, data_type).otherwise(F.col("data_type"))})


@query("respiratory_nightly", O.respiratory_nightly())
def _respiratory(obs: DataFrame) -> DataFrame:
    rows = _instead_of_oxygen(obs, S.RESPIRATORY, "breaths_per_min", O.BREATHS)
    return _vital(vitals.respiratory_rate(rows), "mean", "low", "baseline", "delta")


@query("wrist_nightly", O.wrist_nightly())
def _wrist(obs: DataFrame) -> DataFrame:
    rows = _instead_of_oxygen(obs, S.WRIST_TEMPERATURE, "celsius", O.WRIST)
    return _vital(vitals.wrist_temperature(rows), "mean", "baseline", "delta")


@query("focus_afternoon_baseline", O.focus_afternoon_baseline())
def _afternoon(obs: DataFrame) -> DataFrame:
    return _vital(series.afternoon_baseline(obs, O.AFTERNOON_STEP), "focus")


@query("latest_features", O.latest_features())
def _latest(obs: DataFrame) -> DataFrame:
    rows = series.latest(_asked(stored(obs), O.LATEST).all(*O.LATEST)).withColumn("reliability", series.reliability())
    return rounded(rows, "value", "confidence").select("subject_id", "feature_id", "w_end", "value", "confidence", "reliability")


@query("chart_pivot", O.chart_pivot())
def _chart(obs: DataFrame) -> DataFrame:
    return rounded(series.chart(_asked(stored(obs), O.CHART).all(*O.CHART), list(O.CHART)), *O.CHART)


@query("report_runs", O.report_runs())
def _runs(obs: DataFrame) -> DataFrame:
    features = _asked(stored(obs), O.REPORTED).all(*O.REPORTED).withColumn("value", F.col("value") + 1e-9)
    return rounded(series.runs(features).withColumns({c: F.col(c) - 1e-9 for c in ("first", "last")}), "first", "last")


@query("life_event_effect", O.life_event_effect())
def _effect(obs: DataFrame) -> DataFrame:
    features = stored(_asked(stored(obs), ("focus_score", "cognitive_load")).all("focus_score", "cognitive_load"))
    facts = rules.Facts(features, features, obs, features, features)
    return rounded(rules.life_event_effect(facts).drop("event_ids"), "change", "confidence")


@query("insights", O.insights())
def _insights(obs: DataFrame) -> DataFrame:
    obs = stored(obs)
    names = ("focus_score", "stress_index", "context_switch_rate", "cognitive_load", "sustained_load")
    cat = _asked(obs, names)
    facts = rules.Facts(cat.all(*names), stored(high_stress(cat)), obs, stored(series.afternoon_baseline(obs, O.AFTERNOON_STEP)), stored(vitals.hrv_vs_baseline(obs)))
    found = stored(rules.insights(facts))
    hints = rules.recommendations(facts, found).select("subject_id", "rule_id", "title", F.col("suggestion").alias("text"))
    return found.select("subject_id", "rule_id", "title", "text").unionByName(hints)


@query("type_summary", O.plain("SELECT data_type, count(*) AS rows, max(ts) AS last_ts FROM obs WHERE ts >= 1705000000 GROUP BY 1"))
def _summary(obs: DataFrame) -> DataFrame:
    return scans.type_summary(obs, 1705000000)


@query("range_scan", O.plain("SELECT id, ts, data_type FROM obs WHERE ts BETWEEN 1704500000 AND 1705000000"))
def _range(obs: DataFrame) -> DataFrame:
    return scans.between(obs, 1704500000, 1705000000).select("id", "ts", "data_type")


@query("cursor_page", O.plain("SELECT id, created_at FROM obs WHERE created_at > 1704500000 OR (created_at = 1704500000 AND id > '000000000100') ORDER BY created_at, id LIMIT 256"))
def _page(obs: DataFrame) -> DataFrame:
    return scans.after_cursor(obs, 1704500000, "000000000100", 256).select("id", "created_at")


@query("last_cursor", O.plain("SELECT created_at, id FROM obs ORDER BY created_at DESC, id DESC LIMIT 1"))
def _cursor(obs: DataFrame) -> DataFrame:
    return scans.last_cursor(obs)


def with_markers(obs: DataFrame) -> DataFrame:
    """Observations with retractions of some life events and of other rows
    (which stay), and deletions, half of them by another provider (no effect)."""

    def mark(rows: DataFrame, kind: str, prefix: str) -> DataFrame:
        return rows.withColumns({"target_id": F.col("id"), "id": F.concat(F.lit(prefix), "id"), "data_type": F.lit(kind)})

    retract = mark(obs.filter(F.col("ts") % 3 == 0), S.RETRACTION, "r")
    delete = mark(obs.filter(F.col("ts") % 11 == 0), S.DELETION, "d").withColumn("provider_id", F.when(F.col("ts") % 2 == 0, F.col("provider_id")).otherwise("elsewhere"))
    return obs.unionByName(retract).unionByName(delete)


@query("visible_observations", O.visible_observations())
def _visible(obs: DataFrame) -> DataFrame:
    return scans.visible(with_markers(obs)).select("id", "subject_id", "ts", "provider_id", "data_type")


@query("visible_between", O.visible_between())
def _visible_between(obs: DataFrame) -> DataFrame:
    return scans.visible_between(with_markers(obs), 1704500000, 1705000000).select("id", "subject_id", "ts", "provider_id", "data_type")


@query("typed_scan", O.typed_scan())
def _typed_scan(obs: DataFrame) -> DataFrame:
    return scans.of_type(with_markers(obs), S.CONTEXT, 1704500000, 1705000000).select("id", "subject_id", "ts", "provider_id", "data_type")


@query("several_types", O.several_types())
def _several_types(obs: DataFrame) -> DataFrame:
    return scans.of_types(with_markers(obs), [S.LIFE_EVENT, S.HRV], 1704500000, 1705000000).select("id", "ts", "data_type")


@query("by_id", O.plain("SELECT id, ts, data_type FROM obs WHERE id = '000000000100'"))
def _by_id(obs: DataFrame) -> DataFrame:
    return scans.by_id(obs, "000000000100").select("id", "ts", "data_type")


@query("retracted_ids", O.plain("SELECT id FROM obs WHERE ts % 3 = 0"))
def _retracted_ids(obs: DataFrame) -> DataFrame:
    return scans.is_retracted(with_markers(obs), obs.select("id"))


@query("feature_week", O.feature_week())
def _feature_week(obs: DataFrame) -> DataFrame:
    return digest(series.feature_series(obs, "1w", O.WEEK_END, list(O.WEEK)), "feature_id")


@query("window_counts", O.window_counts())
def _window_counts(obs: DataFrame) -> DataFrame:
    return rounded(live.window_counts(obs, 300), "confidence")


@query("wearable_report", O.wearable_report())
def _wearable_report(obs: DataFrame) -> DataFrame:
    """The source report of raw rows whose payloads name application and device."""
    app = F.when(F.col("provider_id") == "p0", "Health"), F.when(F.col("provider_id").isin("p0", "p1"), "org.example.app")
    src = F.struct(F.col("src_kind").alias("kind"), app[0].alias("app_name"), app[1].alias("bundle_id"), F.when(F.col("ts") % 2 == 0, "two").alias("device_model"))
    raw = obs.withColumn("payload", F.to_json(F.struct(src.alias("src"), "stage")))
    counts = F.transform("counts", lambda c: F.concat(c["data_type"], F.lit(":"), F.concat_ws("/", *[c[n].cast("string") for n in ("last_24h", "last_7d", "last_30d")])))
    return rounded(wearables.report(wearables.samples(raw), O.WEARABLE_NOW).withColumn("counts", F.array_join(counts, ",")), "coverage")


@query("life_event_log", O.life_event_log())
def _life_event_log(obs: DataFrame) -> DataFrame:
    """A third of the events retracted, every other of these restored."""
    now = 1800000000
    marked = obs.unionByName(life_events.retract(obs, obs.filter("ts % 3 = 0").select("id"), now))
    both = marked.unionByName(life_events.restore(marked, obs.filter("ts % 6 = 0").select("id"), now))
    events = scans.visible(both).filter(F.col("data_type") == S.LIFE_EVENT)
    return events.groupBy("subject_id", "life_kind").agg(F.count("*").alias("events"), F.sum("ts").alias("ts_sum"))


@query("life_events", O.life_events())
def _life_events(obs: DataFrame) -> DataFrame:
    return series.life_events(obs)


@query("source_channels", O.source_channels())
def _channels(obs: DataFrame) -> DataFrame:
    return series.source_channels(obs, O.CHANNELS_SINCE, list(O.CHANNELS))


@query("source_selected", O.source_selected())
def _selected(obs: DataFrame) -> DataFrame:
    return quality.select_sources(obs).select("id", "subject_id", "data_type", "src_kind")


@query("source_report", O.source_report())
def _report(obs: DataFrame) -> DataFrame:
    now = obs.agg(F.max("ts")).first()[0]
    return rounded(series.source_report(obs, now), "coverage")


@query("dedupe_exact", O.dedupe_exact())
def _dedupe(obs: DataFrame) -> DataFrame:
    raw = raw_observations(obs)
    again = raw.filter(F.col("ts") % 5 == 0).withColumns({"id": F.concat(F.lit("x"), "id"), "created_at": F.col("created_at") + 7})
    same = raw.filter(F.col("ts") % 7 == 0).withColumn("created_at", F.col("created_at") + 9)
    return quality.dedupe(raw.unionByName(again).unionByName(same)).select("id", "data_type", "ts", "created_at")


@query("normalize_by_type", O.normalize_by_type())
def _normalize(obs: DataFrame) -> DataFrame:
    rows = quality.normalize(raw_observations(obs)).filter("valid")
    sums = [F.round(F.sum(c).cast("double"), 3).alias(c) for c in O.NORMALIZED]
    return rows.groupBy("data_type").agg(F.count("*").alias("rows"), F.count_distinct("bundle_id").alias("bundles"), F.count("stage").alias("stages"), *sums)


@query("context_changes", O.plain(f"SELECT id, bundle_id FROM (SELECT *, lag(bundle_id) OVER (PARTITION BY subject_id ORDER BY ts, id) AS p FROM obs WHERE data_type = '{S.CONTEXT}') WHERE p IS NULL OR p <> bundle_id"))
def _changes(obs: DataFrame) -> DataFrame:
    return polls.changes(obs.filter(F.col("data_type") == S.CONTEXT), ["bundle_id"], ["subject_id"], ["ts", "id"]).select("id", "bundle_id")


@query("minute_counts", O.plain(f"SELECT subject_id, (ts // 60) * 60 AS window_start, count(*) AS count FROM obs WHERE data_type = '{S.KEYSTROKES}' GROUP BY 1, 2"))
def _minutes(obs: DataFrame) -> DataFrame:
    return polls.counts_by_minute(obs.filter(F.col("data_type") == S.KEYSTROKES), ["subject_id"])


@query("log_source", O.plain(f"SELECT subject_id, data_type, count(*) AS rows, min(id) AS first_id, max(created_at) AS last_created FROM obs WHERE data_type IN ('{S.HEART_RATE}', '{S.STEPS}', '{S.CALENDAR}') GROUP BY 1, 2"))
def _log_source(obs: DataFrame) -> DataFrame:
    """The log, appended and read by the data source, whose scan leaves out other types."""
    spark = obs.sparkSession
    path = shared_path(spark)
    scans.append(obs, path)
    log_source.register(spark)
    read = spark.read.format(log_source.NAME).option("path", path).load()
    rows = read.filter(F.col("data_type").isin(S.HEART_RATE, S.STEPS, S.CALENDAR))
    return rows.groupBy("subject_id", "data_type").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("created_at").alias("last_created"))


@query("stored_series", O.feature("stress_index"))
def _stored_series(obs: DataFrame) -> DataFrame:
    """Stress of the whole log from a stored series: one refresh over what was
    there at a moment, one over all that came later."""
    path = shared_path(obs.sparkSession)
    log = stored(obs)
    stored_series.refresh(log.filter(F.col("created_at") < O.CHANNELS_SINCE), path, ("stress_index",), STEP)
    stored_series.refresh(log, path, ("stress_index",), STEP)
    return digest(stored_series.series(obs.sparkSession, path))
