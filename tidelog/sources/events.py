"""Observations from the ``events`` table: a deterministic projection.

The expressions are plain SQL over ``t`` (epoch second), ``k``, ``r``, ``q`` and
``u``, so that another SQL engine can run the same projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S

SUBJECTS = 5


def _pick(values: tuple[str, ...], index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {index} % {len(values)} {arms} END"


DATA_TYPE = (
    "CASE event_type"
    f" WHEN 'click' THEN CASE WHEN r = 3 THEN '{S.KEYSTROKES}' ELSE '{S.CONTEXT}' END"
    f" WHEN 'view' THEN CASE r WHEN 0 THEN '{S.BROWSER}' WHEN 1 THEN '{S.MEDIA}' WHEN 2 THEN '{S.LIGHT}' ELSE '{S.GIT}' END"
    f" WHEN 'error' THEN CASE WHEN r <= 1 THEN '{S.NOTIFICATION}' ELSE '{S.HRV}' END"
    f" WHEN 'purchase' THEN CASE r WHEN 0 THEN '{S.STEPS}' WHEN 1 THEN '{S.ENERGY}' WHEN 2 THEN '{S.SLEEP}' ELSE '{S.SPO2}' END"
    f" WHEN 'signup' THEN CASE r WHEN 0 THEN '{S.HEART_RATE}' WHEN 1 THEN '{S.CALENDAR}' WHEN 2 THEN '{S.LIFE_EVENT}' ELSE '{S.RESTING_HR}' END END"
)
_MS = "least(300.0, greatest(1.0, value))"
#: Column: (its data types, its expression).
FIELDS = {
    "bundle_id": ((S.CONTEXT,), "concat('app.', CAST(u % 7 AS string))"),
    "key_count": ((S.KEYSTROKES,), "1 + k"),
    "window_secs": ((S.KEYSTROKES,), "60"),
    "rate_per_min": ((S.KEYSTROKES,), "CAST(1 + k AS double)"),
    "category": ((S.BROWSER,), _pick(S.BROWSER_CATEGORIES, "q")),
    "media_kind": ((S.MEDIA,), _pick(S.MEDIA_KINDS, "q")),
    "is_playing": ((S.MEDIA,), "u % 2 = 0"),
    "light_kind": ((S.LIGHT,), _pick(S.LIGHT_KINDS, "q")),
    "activity_kind": ((S.GIT,), _pick(S.GIT_KINDS, "q")),
    "event_count": ((S.GIT,), "1 + u % 3"),
    "notif_count": ((S.NOTIFICATION,), "1 + q % 5"),
    "notif_category": ((S.NOTIFICATION,), _pick(S.NOTIFICATION_CATEGORIES, "q")),
    "rmssd_ms": ((S.HRV,), f"CASE WHEN r = 2 THEN {_MS} END"),
    "sdnn_ms": ((S.HRV,), f"CASE WHEN r = 3 THEN {_MS} END"),
    "hrv_method": ((S.HRV,), "CASE WHEN r = 2 THEN 'rmssd' ELSE 'sdnn' END"),
    "steps": ((S.STEPS,), "CAST(floor(value * 10) AS bigint)"),
    "kcal": ((S.ENERGY,), "value"),
    "start_s": ((S.SLEEP, S.CALENDAR), f"CASE WHEN data_type = '{S.SLEEP}' THEN t ELSE t + 600 END"),
    "end_s": ((S.SLEEP, S.CALENDAR), f"CASE WHEN data_type = '{S.SLEEP}' THEN t + 3600 * (1 + u % 8) ELSE t + 600 + 900 * (1 + q % 6) END"),
    "stage": ((S.SLEEP,), _pick(S.SLEEP_STAGES, "q")),
    "spo2_percent": ((S.SPO2,), "50 + k / 2.0"),
    "bpm": ((S.HEART_RATE, S.RESTING_HR), f"CAST(CASE WHEN data_type = '{S.HEART_RATE}' THEN 50 + k ELSE 45 + k % 40 END AS double)"),
    "uid": ((S.CALENDAR,), "id"),
    "busy": ((S.CALENDAR,), "k % 3 <> 0"),
    "all_day": ((S.CALENDAR,), "k % 10 = 9"),
    "life_kind": ((S.LIFE_EVENT,), _pick(S.LIFE_KINDS, "q")),
}


def projection() -> list[tuple[str, str]]:
    """(column, SQL) for every column of the observation frame, from a table
    with id, t, k, r, q, u, value, data_type."""
    out = [("id", "id"), ("subject_id", f"concat('s', CAST(u % {SUBJECTS} AS string))"), ("ts", "t"), ("provider_id", "concat('p', CAST(u % 3 AS string))"), ("data_type", "data_type")]
    out += [("confidence", "0.5e0 + (k % 6) / 10.0e0"), ("created_at", "t + k % 5"), ("src_kind", _pick(S.SOURCE_KINDS, "u"))]
    for name, kind in S.PAYLOAD.items():
        types, sql = FIELDS.get(name, ((), "NULL"))
        names = ", ".join(f"'{t}'" for t in types)
        out.append((name, f"CAST(CASE WHEN data_type IN ({names}) THEN {sql} END AS {kind})" if types else f"CAST(NULL AS {kind})"))
    return out


def keyed(events: DataFrame) -> DataFrame:
    """id, t, k, r, q, u, value and data_type of each event."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    # a one-row generator: the JSON is read once a row, not in every branch of a pushed filter
    rows = events.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), F.explode(F.array(k)).alias("k"), F.col("user_id").alias("u"), "event_type", "value")
    rows = rows.withColumn("r", F.expr("k % 4")).withColumn("q", F.expr("CAST(floor(k / 4) AS bigint)"))
    return rows.withColumn("data_type", F.expr(DATA_TYPE))


def typed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return keyed(events).select(*[F.expr(sql).alias(name) for name, sql in projection()])


#: JSON keys of typed columns by data type, several under their accepted aliases.
JSON_KEYS = {
    S.CONTEXT: {"bundleId": "bundle_id"},
    S.KEYSTROKES: {"count": "key_count", "window_seconds": "window_secs"},
    S.BROWSER: {"category": "category"},
    S.MEDIA: {"media_kind": "media_kind", "is_playing": "is_playing"},
    S.GIT: {"activity_kind": "activity_kind", "event_count": "event_count"},
    S.LIGHT: {"light_kind": "light_kind"},
    S.NOTIFICATION: {"count": "notif_count", "category": "notif_category"},
    S.HRV: {"rmssd": "rmssd_ms", "sdnn_ms": "sdnn_ms", "method": "hrv_method"},
    S.STEPS: {"steps": "steps"},
    S.ENERGY: {"calories": "kcal"},
    S.SLEEP: {"start": "start_s", "end": "end_s", "sleep_stage": "stage"},
    S.SPO2: {"spo2": "spo2_percent"},
    S.HEART_RATE: {"hr": "bpm"},
    S.RESTING_HR: {"bpm": "bpm"},
    S.CALENDAR: {"uid": "uid", "start": "start_s", "end": "end_s", "all_day": "all_day", "busy": "busy"},
    S.LIFE_EVENT: {"kind": "life_kind"},
}


def raw_observations(typed: DataFrame) -> DataFrame:
    """The stored form of typed rows: the payload as JSON text."""
    payload = F.lit("{}")
    for data_type, keys in JSON_KEYS.items():
        fields = [F.col(c).alias(k) for k, c in keys.items()] + [F.struct(F.col("src_kind").alias("kind")).alias("src")]
        payload = F.when(F.col("data_type") == data_type, F.to_json(F.struct(*fields))).otherwise(payload)
    # a one-row generator: the expression is evaluated once, not in every use
    return typed.select(*[F.explode(F.array(payload)).alias("payload") if c == "payload" else F.col(c) for c in S.RAW])
