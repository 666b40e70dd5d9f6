"""The quality pipeline: accept, dedupe, normalize, select sources.

Raw rows are (id, subject_id, ts, provider_id, data_type, confidence,
created_at, payload JSON); normalized rows are the typed observation frame.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.stored import stored
from tidelog.plans.windows import DAY

#: Types whose rows are chosen by source, by length of bucket.
CUMULATIVE = (S.STEPS, S.ENERGY, "basal_energy", "distance_walking_running", "exercise_time", "stand_time")
DISCRETE = (S.HEART_RATE, S.RESTING_HR, "walking_heart_rate_average", S.HRV, S.SPO2, S.RESPIRATORY, S.WRIST_TEMPERATURE, "vo2_max")
#: Types that the phone may send.
COMPANION_TYPES = (*CUMULATIVE, *DISCRETE, S.SLEEP, "workout", "stand_hour", "mindful_session", S.DELETION, S.LIFE_EVENT)


#: A number without fraction and exponent is no float, whatever its value.
_FLOATS = r'("(?:[^"\\]|\\.)*")|(-?\d+)(\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+)'


def fingerprint(payload: str = "payload") -> Column:
    """Canonical JSON: keys sorted, white space dropped.  15 and 15.0 are
    different contents, 15.0 and 15.00 are the same one: floats are read as
    doubles and marked, integers stay as they are."""
    marked = F.regexp_replace(payload, _FLOATS, r'$1{"float":$2$3}')
    marked = F.regexp_replace(marked, r'("(?:[^"\\]|\\.)*")\{"float":\}', "$1")
    return F.to_json(F.try_parse_json(marked))


def content_key(payload: str = "payload") -> Column:
    """What a row says and of whom, without its id."""
    return F.sha2(F.concat_ws("\x1f", "subject_id", "provider_id", "data_type", F.col("ts").cast("string"), F.coalesce(fingerprint(payload), F.col(payload))), 256)


def dedupe(raw: DataFrame) -> DataFrame:
    """Drops a row if a kept earlier row has its id or its content, in order of
    (created_at, id, arrival).

    Where no id has two contents, the first of each content is exact and runs
    as one window.  Rows of contents and ids that conflict are replayed.
    """
    rows = raw.withColumn("content", content_key())
    order = ["created_at", "id", "content"]
    ids = stored(rows.groupBy("id").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select("id"))
    first = Window.partitionBy("content").orderBy(*order)

    def firsts(some: DataFrame) -> DataFrame:
        return some.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place", "content")

    if ids.isEmpty():
        return firsts(rows)
    mixed = stored(rows.join(ids, "id", "left_semi").select("content").distinct())
    return firsts(rows.join(mixed, "content", "left_anti")).unionByName(_replay(rows.join(mixed, "content", "left_semi"), raw.columns))


#: Rows of a component that one task replays; a row is its place, id and content.
LARGEST = 250_000


def _replay(rows: DataFrame, columns: list[str], largest: int = LARGEST) -> DataFrame:
    """First-wins among rows that share ids or contents.

    Two rounds settle what many rows share.  Rows that are left depend on chains
    of others: those of a connected component are replayed in order in one task.
    Components of more than ``largest`` rows go through further rounds, which
    split them, until they are small enough.  A null id is shared with no row."""
    place = F.struct("created_at", "id", "content", "arrival")
    left = rows.withColumn("arrival", F.monotonically_increasing_id())
    whole = stored(left)
    key = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("n"), F.col("arrival").cast("string")))
    left = whole.select("arrival", key.alias("key"), "content", place.alias("place"))
    kept = left.select("arrival").limit(0)
    rounds = 0
    while not left.isEmpty():
        if rounds >= 2:
            labelled = _components(left)
            small = labelled.groupBy("component").agg(F.count("*").alias("rows")).filter(F.col("rows") <= largest).select("component")
            labelled = stored(labelled.join(small.withColumn("small", F.lit(True)), "component", "left"))
            mine = labelled.filter("small").select("component", "arrival", "key", "content", "place.created_at", "place.id")
            kept = kept.unionByName(stored(mine.groupBy("component").applyInPandas(_in_order, "arrival bigint")))
            left = labelled.filter("small IS NULL").select(*left.columns)
        now, left = _round(left)
        kept = kept.unionByName(now.select("arrival"))
        rounds += 1
    return whole.join(kept, "arrival", "left_semi").select(*columns)


def _round(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that come first both for their id and for their content, and the
    rows that share neither with them."""
    by_id = left.groupBy("key").agg(F.min("place").alias("first_id"))
    by_content = left.groupBy("content").agg(F.min("place").alias("first_content"))
    now = left.join(by_id, "key").join(by_content, "content").filter("place = first_id AND place = first_content")
    now = stored(now.select(*left.columns))
    return now, stored(left.join(now.select("key"), "key", "left_anti").join(now.select("content"), "content", "left_anti"))


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` (arrival, key, content, ...) with ``component``, one arrival of
    those that are linked by keys and contents.  Every row points to a row of
    its component; pointers and the pointers of those they lead to take the
    least pointer among neighbours and skip a step, so that the number of passes
    grows with the logarithm of a chain, not with its length."""
    links = rows.select("arrival", "key", "content")
    now = stored(links.withColumn("up", F.col("arrival")))
    while True:
        steps = now.join(now.select(F.col("arrival").alias("up"), F.col("up").alias("over")), "up")
        by_key = steps.groupBy("key").agg(F.min("over").alias("near_key"))
        by_content = steps.groupBy("content").agg(F.min("over").alias("near_content"))
        steps = stored(steps.join(by_key, "key").join(by_content, "content").withColumn("near", F.least("near_key", "near_content")))
        hooks = steps.groupBy(F.col("up").alias("arrival")).agg(F.min("near").alias("hook"))
        after = steps.join(hooks, "arrival", "left").withColumn("least", F.least("up", "over", "near", "hook"))
        after = stored(after.select("arrival", "key", "content", F.col("least").alias("up"), (F.col("least") < F.col("up")).alias("moved")))
        now = after.drop("moved")
        if after.filter("moved").isEmpty():
            return rows.join(now.select("arrival", F.col("up").alias("component")), "arrival")


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["created_at", "id", "content", "arrival"], na_position="first")
    keys, contents, kept = set(), set(), []
    for arrival, key, content in zip(group["arrival"], group["key"], group["content"], strict=True):
        if key not in keys and content not in contents:
            keys.add(key)
            contents.add(content)
            kept.append(arrival)
    return pd.DataFrame({"arrival": pd.array(kept, "int64")})


#: JSON keys that payloads are read by, aliases included, as what they are read.
TEXT_KEYS = (
    "bundle_id", "bundleId", "category", "media_kind", "activity_kind", "light_kind", "interruption_level", "app_kind", "method", "unit",
    "stage", "sleep_stage", "uid", "kind", "target_id", "edited_from",
)
NUMBER_KEYS = (
    "count", "window_secs", "window_seconds", "event_count", "level", "rmssd_ms", "rmssd", "hrv_ms", "sdnn_ms", "sdnn", "pnn50", "steps", "kcal",
    "active_energy_kcal", "calories", "start", "end", "spo2_percent", "spo2", "oxygen_saturation", "breaths_per_min", "respiratory_rate", "celsius",
    "delta_celsius", "ml_kg_min", "vo2_max", "bpm", "heart_rate", "hr", "beats_per_minute", "resting_heart_rate", "walking_heart_rate_average", "logged_at",
)
FLAG_KEYS = ("is_playing", "all_day", "busy")
_SRC = "kind string, name string, device_name string, source_name string"


def _read(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Columns ``columns`` and one column ``_key`` for each JSON key.  One-row
    generators: the payload is parsed once and each value is cast once, however
    often later columns and filters use it."""
    keys = (*TEXT_KEYS, *NUMBER_KEYS, *FLAG_KEYS, "src")
    parsed = F.inline(F.array(F.from_json("payload", ", ".join(f"`{k}` string" for k in keys))))
    rows = raw.select(*columns, parsed.alias(*[f"_{k}" for k in keys]))
    values = [F.nullif(F.trim(F.col(f"_{k}")), F.lit("")).alias(f"_{k}") for k in TEXT_KEYS]
    numbers = {k: F.trim(F.col(f"_{k}")).try_cast("double") for k in NUMBER_KEYS}
    values += [F.when(F.abs(x) < float("inf"), x).alias(f"_{k}") for k, x in numbers.items()]
    values += [F.col(f"_{k}").try_cast("boolean").alias(f"_{k}") for k in FLAG_KEYS]
    values += [F.col("_src").isNotNull().alias("_has_src"), F.from_json("_src", _SRC).alias("_src")]
    return rows.select(*columns, F.inline(F.array(F.struct(*values))))


def _text(key: str) -> Column:
    return F.col(f"_{key}")


def _number(*keys: str) -> Column:
    """The first alias that parses as a finite number; numeric strings count,
    booleans do not."""
    return F.coalesce(*[F.col(f"_{k}") for k in keys])


def _whole(*keys: str) -> Column:
    x = _number(*keys)
    return F.when(x == F.floor(x), x.cast("bigint"))


def _flag(key: str) -> Column:
    return F.col(f"_{key}")


def _within(x: Column, low: float, high: float) -> Column:
    return F.when(x.between(low, high), x)


def _one_of(x: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(x.isin(*allowed), x)


def _heart(low: float, high: float, *paths: str) -> Column:
    bpm = _number(*paths)
    return _within(F.when(bpm > 0, F.when(F.lower(_text("unit")) == "hz", bpm * 60).otherwise(bpm)), low, high)


def normalize(raw: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows plus ``valid``: false where a payload is beyond repair; columns
    ``also`` of the raw rows are passed on."""
    t = F.col("data_type")
    fields: dict[str, tuple[tuple[str, ...], Column]] = {}

    def put(name: str, types: tuple[str, ...], value: Column) -> None:
        fields[name] = (types, value)

    scale = F.when(F.lower(_text("unit")) == "s", 1000.0).otherwise(1.0)
    method = F.lower(_text("method"))
    rmssd = _within(_number("rmssd_ms", "rmssd", "hrv_ms") * scale, 1, 300)
    sdnn = _within(_number("sdnn_ms", "sdnn") * scale, 1, 300)
    rmssd, sdnn = F.when(method.isNull() | (method == "rmssd"), rmssd), F.when(method.isNull() | (method == "sdnn"), sdnn)
    spo2 = _number("spo2_percent", "spo2", "oxygen_saturation")
    count, secs = _whole("count"), F.greatest(F.coalesce(_whole("window_secs", "window_seconds"), F.lit(60)), F.lit(1))
    put("bundle_id", (S.CONTEXT,), F.coalesce(_text("bundle_id"), _text("bundleId")))
    put("key_count", (S.KEYSTROKES,), F.when(count >= 0, count))
    put("window_secs", (S.KEYSTROKES, S.STEPS), secs)
    put("rate_per_min", (S.KEYSTROKES,), F.when(count >= 0, count * 60.0 / secs))
    put("category", (S.BROWSER,), _one_of(_text("category"), S.BROWSER_CATEGORIES))
    put("media_kind", (S.MEDIA,), _one_of(_text("media_kind"), S.MEDIA_KINDS))
    put("is_playing", (S.MEDIA,), _flag("is_playing"))
    put("activity_kind", (S.GIT,), _one_of(_text("activity_kind"), S.GIT_KINDS))
    put("event_count", (S.GIT,), _whole("event_count"))
    put("light_kind", (S.LIGHT,), _one_of(_text("light_kind"), S.LIGHT_KINDS))
    put("level", (S.LIGHT,), _number("level"))
    put("notif_count", (S.NOTIFICATION,), F.when(count >= 1, count))
    put("notif_category", (S.NOTIFICATION,), _text("category"))
    put("interruption_level", (S.NOTIFICATION,), _text("interruption_level"))
    put("app_kind", (S.NOTIFICATION,), _text("app_kind"))
    put("rmssd_ms", (S.HRV,), rmssd)
    put("sdnn_ms", (S.HRV,), sdnn)
    put("pnn50", (S.HRV,), _within(_number("pnn50"), 0, 100))
    put("hrv_method", (S.HRV,), F.coalesce(method, F.when(sdnn.isNull(), "rmssd").when(rmssd.isNull(), "sdnn")))
    steps = _whole("count", "steps")
    put("steps", (S.STEPS,), F.when(steps >= 0, steps))
    put("kcal", (S.ENERGY,), F.when(_number("kcal", "active_energy_kcal", "calories") >= 0, _number("kcal", "active_energy_kcal", "calories")))
    put("start_s", (S.SLEEP, S.CALENDAR), _whole("start"))
    put("end_s", (S.SLEEP, S.CALENDAR), _whole("end"))
    put("stage", (S.SLEEP,), F.coalesce(_text("stage"), _text("sleep_stage")))
    put("spo2_percent", (S.SPO2,), _within(F.when(spo2 <= 1, spo2 * 100).otherwise(spo2), 50, 100))
    put("breaths_per_min", (S.RESPIRATORY,), _within(_number("breaths_per_min", "respiratory_rate"), 4, 40))
    put("celsius", (S.WRIST_TEMPERATURE,), _within(_number("celsius", "delta_celsius"), -5, 5))
    put("ml_kg_min", ("vo2_max",), _within(_number("ml_kg_min", "vo2_max"), 10, 90))
    bpm = F.when(t == S.RESTING_HR, _heart(25, 150, "bpm", "resting_heart_rate")).when(t == "walking_heart_rate_average", _heart(25, 250, "bpm", "walking_heart_rate_average")).otherwise(_heart(25, 250, "bpm", "heart_rate", "hr", "beats_per_minute"))
    put("bpm", (S.HEART_RATE, S.RESTING_HR, "walking_heart_rate_average"), bpm)
    put("uid", (S.CALENDAR,), _text("uid"))
    put("all_day", (S.CALENDAR,), _flag("all_day"))
    put("busy", (S.CALENDAR,), _flag("busy"))
    put("life_kind", (S.LIFE_EVENT,), _one_of(_text("kind"), S.LIFE_KINDS))
    put("logged_at", (S.LIFE_EVENT,), _whole("logged_at"))
    put("edited_from", (S.LIFE_EVENT,), _text("edited_from"))
    put("target_id", (S.RETRACTION, S.DELETION), _text("target_id"))
    typed = [F.when(t.isin(*fields[n][0]), fields[n][1]).cast(k).alias(n) for n, k in S.PAYLOAD.items()]
    said = [F.when(F.trim(F.col("_src")[n]) != "", F.trim(F.col("_src")[n])) for n in ("kind", "name", "device_name", "source_name")]
    kind = said[0]
    bad_src = F.col("_has_src") & (kind.isNull() | ~kind.isin(*S.SOURCE_KINDS) | F.coalesce(*said[1:]).isNotNull())
    wearable = t.isin(*CUMULATIVE, *DISCRETE, S.SLEEP)
    carried = [*(n for n in S.ENVELOPE if n != "src_kind"), *also]
    row = F.struct(F.when(wearable, kind).alias("src_kind"), *typed, (wearable & F.coalesce(bad_src, F.lit(False))).alias("bad_src"))
    out = _read(raw, carried).select(*carried, F.inline(F.array(row)))
    return out.withColumn("valid", ~F.col("bad_src") & _needed()).drop("bad_src").select(*S.COLUMNS, *also, "valid")


def _needed() -> Column:
    """What a typed row must hold to be kept, by type; other types pass."""
    c, has = F.col, lambda n: F.col(n).isNotNull()
    rules = {
        S.CONTEXT: has("bundle_id"),
        S.KEYSTROKES: has("key_count"),
        S.BROWSER: has("category"),
        S.MEDIA: has("media_kind") & has("is_playing"),
        S.GIT: has("activity_kind") & (F.coalesce("event_count", F.lit(1)) >= 1),
        S.LIGHT: has("light_kind") & F.coalesce(c("level").between(0, 100), F.lit(True)),
        S.NOTIFICATION: has("notif_count") & F.coalesce(c("notif_category").isin(*S.NOTIFICATION_CATEGORIES), F.lit(True)) & F.coalesce(c("interruption_level").isin(*S.INTERRUPTION_LEVELS), F.lit(True)) & F.coalesce(c("app_kind").isin(*S.APP_KINDS), F.lit(True)),
        S.HRV: (has("rmssd_ms") | has("sdnn_ms")) & c("hrv_method").isin("rmssd", "sdnn"),
        S.STEPS: has("steps"),
        S.ENERGY: has("kcal"),
        S.SLEEP: has("start_s") & F.coalesce(c("end_s") >= c("start_s"), F.lit(False)) & F.coalesce(c("stage").isin(*S.SLEEP_STAGES), F.lit(True)),
        S.SPO2: has("spo2_percent"),
        S.RESPIRATORY: has("breaths_per_min"),
        S.WRIST_TEMPERATURE: has("celsius"),
        "vo2_max": has("ml_kg_min"),
        S.HEART_RATE: has("bpm"),
        S.RESTING_HR: has("bpm"),
        "walking_heart_rate_average": has("bpm"),
        S.CALENDAR: has("uid") & has("start_s") & F.coalesce(c("end_s") >= c("start_s"), F.lit(False)),
    }
    out = F.lit(True)
    for name, rule in rules.items():
        out = F.when(c("data_type") == name, F.coalesce(rule, F.lit(False))).otherwise(out)
    return out


def drop_deleted(obs: DataFrame) -> DataFrame:
    """Without deletion markers and what they name at the same provider."""
    marks = obs.filter(F.col("data_type") == S.DELETION).select(F.col("target_id").alias("id"), "provider_id").distinct()
    return obs.filter(F.col("data_type") != S.DELETION).join(marks, ["id", "provider_id"], "left_anti")


def drop_retracted(obs: DataFrame) -> DataFrame:
    """Without retraction markers and the life events that they name."""
    marks = obs.filter((F.col("data_type") == S.RETRACTION) & F.col("target_id").isNotNull()).select(F.col("target_id").alias("id"), F.lit(S.LIFE_EVENT).alias("data_type")).distinct()
    return obs.filter(F.col("data_type") != S.RETRACTION).join(marks, ["id", "data_type"], "left_anti")


def priority_of(names: Iterable[str]) -> tuple[str, ...]:
    """An order of source kinds: the given ones first, unknown and repeated names
    aside, then the default order's others."""
    known = [n for n in names if n in S.SOURCE_KINDS]
    return tuple(dict.fromkeys([*known, *S.SOURCE_PRIORITY]))


def priority_from_toml(text: str) -> tuple[str, ...]:
    """The order in ``order = [...]``; the default one if there is none."""
    try:
        order = tomllib.loads(text).get("order")
    except tomllib.TOMLDecodeError:
        return S.SOURCE_PRIORITY
    return priority_of(n for n in order if isinstance(n, str)) if isinstance(order, list) else S.SOURCE_PRIORITY


def source_rank(priority: tuple[str, ...] = S.SOURCE_PRIORITY) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(priority) for x in (k, i)])
    return F.coalesce(F.try_element_at(ranks, F.col("src_kind")), F.lit(len(priority)))


def source_bucket() -> Column:
    t = F.col("data_type")
    return F.when(t.isin(*CUMULATIVE), F.floor(F.col("ts") / DAY)).when(t.isin(*DISCRETE), F.floor(F.col("ts") / 900)).when(t == S.SLEEP, F.floor((F.coalesce("start_s", "ts") - 6 * 3600) / DAY))


def select_sources(obs: DataFrame, priority: tuple[str, ...] = S.SOURCE_PRIORITY) -> DataFrame:
    """In each bucket the rows of the best source kind; other types all stay."""
    rows = drop_deleted(obs).withColumn("rank", source_rank(priority)).withColumn("bucket", source_bucket())
    best = F.min("rank").over(Window.partitionBy("subject_id", "data_type", "bucket"))
    chosen = rows.filter("bucket is not null").withColumn("best", best).filter("rank = best").drop("best")
    return rows.filter("bucket is null").unionByName(chosen).drop("rank", "bucket")


def quality_pipeline(raw: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """accept, dedupe, normalize (valid rows) and select sources."""
    typed = raw.transform(dedupe).transform(normalize).filter("valid").drop("valid")
    return typed.transform(select_sources)
