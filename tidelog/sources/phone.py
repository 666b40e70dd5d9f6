"""Health records of a phone: mapped to raw rows, read back page by page, and
split into bodies that an ingest accepts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.plans.windows import DAY

#: The phone's identifiers and the data types they become.
TYPES = {
    "HKQuantityTypeIdentifierHeartRate": S.HEART_RATE,
    "HKQuantityTypeIdentifierRestingHeartRate": S.RESTING_HR,
    "HKQuantityTypeIdentifierWalkingHeartRateAverage": "walking_heart_rate_average",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN": S.HRV,
    "HKQuantityTypeIdentifierOxygenSaturation": S.SPO2,
    "HKQuantityTypeIdentifierRespiratoryRate": S.RESPIRATORY,
    "HKQuantityTypeIdentifierAppleSleepingWristTemperature": S.WRIST_TEMPERATURE,
    "HKQuantityTypeIdentifierVO2Max": "vo2_max",
    "HKQuantityTypeIdentifierStepCount": S.STEPS,
    "HKQuantityTypeIdentifierDistanceWalkingRunning": "distance_walking_running",
    "HKQuantityTypeIdentifierActiveEnergyBurned": S.ENERGY,
    "HKQuantityTypeIdentifierBasalEnergyBurned": "basal_energy",
    "HKQuantityTypeIdentifierAppleExerciseTime": "exercise_time",
    "HKQuantityTypeIdentifierAppleStandTime": "stand_time",
    "HKCategoryTypeIdentifierAppleStandHour": "stand_hour",
    "HKCategoryTypeIdentifierMindfulSession": "mindful_session",
    "HKCategoryTypeIdentifierSleepAnalysis": S.SLEEP,
    "HKWorkoutTypeIdentifier": "workout",
}
#: Sleep stages by number and by name; applications by bundle.
STAGES = {
    "0": "in_bed", "1": "asleep", "2": "awake", "3": "asleep_core", "4": "asleep_deep", "5": "asleep_rem",
    "inBed": "in_bed", "asleep": "asleep", "asleepUnspecified": "asleep", "awake": "awake", "asleepCore": "asleep_core", "asleepDeep": "asleep_deep", "asleepREM": "asleep_rem",
}
APPS = {"com.xiaomi.wearable": "xiaomi_mi_fitness", "com.huami.watch": "zepp_life", "com.xiaomi.hm.health": "zepp_life"}
#: JSON key of a record's value by data type.
VALUE_KEYS = {
    S.HEART_RATE: "bpm", S.RESTING_HR: "bpm", "walking_heart_rate_average": "bpm", S.HRV: "sdnn_ms", S.SPO2: "spo2_percent", S.RESPIRATORY: "breaths_per_min",
    S.WRIST_TEMPERATURE: "celsius", "vo2_max": "ml_kg_min", S.STEPS: "count", "distance_walking_running": "meters", S.ENERGY: "kcal", "basal_energy": "kcal",
    "exercise_time": "minutes", "stand_time": "minutes",
}
SPANS = (S.SLEEP, "stand_hour", "mindful_session", "workout")
#: Backfill pages, their phases, the bodies and the queue.
PAGE, RECENT, HISTORY_DAYS = 500, 30 * DAY, 365
BODY_ROWS, BODY_BYTES, QUEUE_ROWS = 500, 1 << 20, 8000


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def source_kind() -> Column:
    """Kind of a record's source: what a person typed in is manual, then known
    applications, then the product that recorded it."""
    bundle, model = F.coalesce("bundle_id", F.lit("")), [F.coalesce(c, F.lit("")) for c in ("product_type", "hardware_version")]
    made_by = lambda name: model[0].startswith(name) | model[1].startswith(name)
    health = (bundle == "com.apple.health") | bundle.startswith("com.apple.health.")
    known = _lookup(APPS, bundle)
    return F.when(F.col("was_user_entered"), "manual").when(known.isNotNull(), known).when(health & made_by("Watch"), "apple_watch").when(made_by("iPhone"), "iphone").otherwise("other_app")


def device_hash(label: Column, salt: str) -> Column:
    """Salted SHA-256 of a device's label; none for an empty label."""
    return F.when(label != "", F.sha2(F.concat(F.lit(salt), label), 256))


def to_raw(records: DataFrame, salt: str, provider: str = "phone") -> DataFrame:
    """Raw rows of phone records (uuid, subject_id, identifier, start, end, value,
    category, activity_type, kcal, meters, bundle_id, product_type,
    hardware_version, was_user_entered, app_name, device_model, device_label).
    Unknown identifiers count as heart rate.  A row's time is its start for sleep,
    stand hours and mindful sessions, its end otherwise."""
    kind = F.coalesce(_lookup(TYPES, F.col("identifier")), F.lit(S.HEART_RATE))
    rows = records.withColumn("data_type", kind)
    t, value = F.col("data_type"), F.coalesce("value", F.lit(0.0))
    value = F.when((t == S.SPO2) & (value <= 1), value * 100).otherwise(value)
    keys: dict[str, list[str]] = {}
    for data_type, key in VALUE_KEYS.items():
        keys.setdefault(key, []).append(data_type)
    workout = t == "workout"
    fields = {k: F.when(t.isin(*types), value) for k, types in keys.items()}
    fields["kcal"] = F.when(workout, F.col("kcal")).otherwise(fields["kcal"])
    fields |= {
        "method": F.when(t == S.HRV, "sdnn"),
        "start": F.when(t.isin(*SPANS), F.col("start")),
        "end": F.when(t.isin(*SPANS), F.greatest("start", "end")),
        "stage": F.when((t == S.SLEEP) & F.col("category").isNotNull(), F.coalesce(_lookup(STAGES, F.col("category")), F.lit("unknown"))),
        "activity_type": F.when(workout, F.coalesce("activity_type", F.lit("other"))),
        "distance_m": F.when(workout, F.col("meters")),
        "src": F.struct("bundle_id", "was_user_entered", source_kind().alias("kind"), "app_name", "device_model", "hardware_version", "product_type", device_hash(F.col("device_label"), salt).alias("device_label_hash")),
    }
    at = F.when(t.isin(S.SLEEP, "stand_hour", "mindful_session"), F.col("start")).otherwise(F.col("end"))
    payload = F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))
    columns = {"id": F.lower("uuid"), "subject_id": F.col("subject_id"), "ts": at, "provider_id": F.lit(provider), "data_type": t, "confidence": F.lit(1.0), "created_at": F.lit(None), "payload": payload}
    return rows.select(*[columns[c].cast(k).alias(c) for c, k in S.RAW.items()])


def fresh_cursors(types: DataFrame, now: int) -> DataFrame:
    """(data_type, phase, cursor_end) before the first page."""
    return types.select("data_type", F.lit("recent").alias("phase"), F.lit(now).cast("bigint").alias("cursor_end"))


def backfill_pages(samples: DataFrame, cursors: DataFrame, now: int, history_days: int = HISTORY_DAYS, page: int = PAGE) -> DataFrame:
    """The next page of each type that isn't done: its newest samples (data_type,
    id, end) before the cursor, newest first.  ``history_days`` of 0 has no start."""
    start = F.when(F.col("phase") == "recent", now - RECENT).when(F.lit(history_days > 0), now - history_days * DAY)
    open_ = cursors.filter("phase <> 'done'").withColumn("from", start)
    rows = samples.join(F.broadcast(open_), "data_type")  # a row for each known type
    rows = rows.filter((F.col("end") < F.col("cursor_end")) & (F.col("from").isNull() | (F.col("end") >= F.col("from"))))
    # a limited rank is cut in each task before rows are shuffled
    newest = Window.partitionBy("data_type").orderBy(F.desc("end"), F.desc("id"))
    return rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= page).select(*samples.columns, "place")


def advance(cursors: DataFrame, pages: DataFrame, now: int, page: int = PAGE) -> DataFrame:
    """Cursors after a page: a page that isn't full ends its phase (recent, then
    history, then done); a full one moves the cursor to its oldest end."""
    seen = pages.groupBy("data_type").agg(F.count("*").alias("rows"), F.min("end").alias("oldest"))
    full = F.coalesce("rows", F.lit(0)) >= page
    moved = F.when(F.col("oldest") < F.col("cursor_end"), F.col("oldest")).otherwise(F.col("oldest") - 1)
    recent, done = F.col("phase") == "recent", F.col("phase") == "done"
    phase = F.when(done | full, F.col("phase")).when(recent, "history").otherwise("done")
    end = F.when(done, F.col("cursor_end")).when(full, moved).when(recent, F.lit(now - RECENT)).otherwise(F.col("cursor_end"))
    return cursors.join(seen, "data_type", "left").select("data_type", phase.alias("phase"), end.alias("cursor_end"))


def queued(items: DataFrame, most: int = QUEUE_ROWS) -> DataFrame:
    """The queue of each sender (sender, position, dedupe_key, body): the first
    item of each key, and of these the first ``most``."""
    again = Window.partitionBy("sender", "dedupe_key").orderBy("position")
    once = items.withColumn("_n", F.row_number().over(again)).filter("_n = 1")
    head = Window.partitionBy("sender").orderBy("position")
    return once.withColumn("_n", F.row_number().over(head)).filter(F.col("_n") <= most).drop("_n")


def bodies(queue: DataFrame, rows: int = BODY_ROWS, size: int = BODY_BYTES) -> DataFrame:
    """(sender, position, batch) of queued items: in order, a body takes items
    while it holds fewer than ``rows`` and its JSON array stays within ``size``
    bytes.  A sender's queue is bounded, so one task goes through it."""

    def split(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("position")
        batch, held, used, out = 0, 0, 2, []
        for n in part["bytes"]:
            if held and (held >= rows or used + n + 1 > size):
                batch, held, used = batch + 1, 0, 2
            used += n + (held > 0)
            held += 1
            out.append(batch)
        return part.assign(batch=out)[["sender", "position", "batch"]]

    return queue.select("sender", "position", F.octet_length("body").alias("bytes")).groupBy("sender").applyInPandas(split, "sender string, position long, batch long")
