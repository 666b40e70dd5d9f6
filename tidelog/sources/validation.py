"""Strict validation of payloads before they are ingested: a table of rules.

Unlike :func:`tidelog.operators.quality.normalize`, which repairs what it reads,
these rules judge what was sent: a number is a JSON number, never a text of
digits; a required field is there; a field of a closed set holds one of its
values.  Ranges that only make a value useless later are no reason to refuse it.
A type without rules passes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S

UUID = r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$|^[0-9a-f]{32}$"
_NUMBER = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$"
#: Rows that are read as payloads of ``payload``'s VARIANT form.
_PAYLOAD, _KIND = "_variant", "_kind_of_payload"


def _at(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(_PAYLOAD), f"$.{key}", kind)


def _kind(key: str) -> Column:
    """The JSON type of a field; null where the field is absent."""
    return F.schema_of_variant(_at(key, "variant"))


def has(key: str) -> Column:
    return _kind(key).isNotNull()


def text(key: str) -> Column:
    return F.when(_kind(key) == "STRING", _at(key, "string"))


def number(*keys: str) -> Column:
    """The first field that is a finite number."""
    return F.coalesce(*[F.when(_kind(k).rlike(_NUMBER) & (F.abs(_at(k, "double")) < float("inf")), _at(k, "double")) for k in keys])


def integer(key: str) -> Column:
    """A field written as an integer."""
    return F.when(_kind(key) == "BIGINT", _at(key, "bigint"))


def whole(key: str) -> Column:
    """An integer, or a float without a fraction."""
    x = number(key)
    return F.coalesce(integer(key), F.when(x == F.floor(x), x.cast("bigint")))


@dataclass(frozen=True)
class Rule:
    """``broken`` holds where a payload must be refused for ``reason``."""

    reason: str
    broken: Callable[[], Column]


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _needs(reason: str, condition: Callable[[], Column]) -> Rule:
    return Rule(reason, lambda: ~_is(condition()))


def _if_there(key: str, reason: str, condition: Callable[[], Column]) -> Rule:
    return Rule(reason, lambda: has(key) & ~_is(condition()))


def _finite(*keys: str) -> Rule:
    return _needs(f"missing finite {keys[0]}", lambda: number(*keys).isNotNull())


def _interval(read: Callable[[str], Column]) -> tuple[Rule, ...]:
    return (
        _needs("missing start", lambda: read("start").isNotNull()),
        _needs("missing end", lambda: read("end").isNotNull()),
        _needs("end before start", lambda: read("end") >= read("start")),
    )


#: Of whoever measured: named by kind only, never by a personal name.
_SOURCE = (
    _if_there("src", "src is no object", lambda: _kind("src").startswith("OBJECT")),
    *(Rule(f"src.{name} is not stored", lambda name=name: F.schema_of_variant(_at(f"src.{name}", "variant")).isNotNull()) for name in ("name", "device_name", "source_name")),
    _if_there("src", "src.kind", lambda: (F.schema_of_variant(_at("src.kind", "variant")) == "STRING") & _at("src.kind", "string").isin(*S.SOURCE_KINDS)),
)


def _method() -> Column:
    """A named method fits the one metric that is there."""
    sdnn, rmssd = number("sdnn_ms", "sdnn").isNotNull(), number("rmssd_ms", "rmssd", "hrv_ms", "hrv").isNotNull()
    named = text("method")
    return ((named == "sdnn") & sdnn & ~rmssd) | ((named == "rmssd") & rmssd & ~sdnn)


_TARGET = _needs("target_id", lambda: text("target_id").rlike(UUID))
_BPM = (_finite("bpm", "heart_rate", "hr", "beats_per_minute"), *_SOURCE)
#: What the payloads of each type must and may hold.
RULES: dict[str, tuple[Rule, ...]] = {
    S.HEART_RATE: _BPM,
    "walking_heart_rate_average": _BPM,
    S.RESTING_HR: (_finite("bpm", "resting_heart_rate"), *_SOURCE),
    S.HRV: (_finite("sdnn_ms", "sdnn", "rmssd_ms", "rmssd", "hrv_ms", "hrv"), _if_there("method", "method", _method), *_SOURCE),
    S.RESPIRATORY: (_finite("breaths_per_min", "respiratory_rate"), *_SOURCE),
    S.WRIST_TEMPERATURE: (_finite("celsius", "delta_celsius"), *_SOURCE),
    "vo2_max": (_finite("ml_kg_min", "vo2_max"), *_SOURCE),
    "distance_walking_running": (_finite("meters", "distance_m"), *_SOURCE),
    "basal_energy": (_finite("kcal", "basal_energy_kcal"), *_SOURCE),
    "exercise_time": (_finite("minutes"), *_SOURCE),
    "stand_time": (_finite("minutes"), *_SOURCE),
    "stand_hour": (*_interval(integer), *_SOURCE),
    "mindful_session": (*_interval(integer), *_SOURCE),
    "workout": (_needs("activity_type", lambda: F.trim(text("activity_type")) != ""), *_interval(integer), *_SOURCE),
    S.STEPS: (_needs("count", lambda: whole("count") >= 0), _if_there("window_secs", "window_secs", lambda: whole("window_secs") >= 1)),
    S.ENERGY: (_needs("kcal", lambda: number("kcal") >= 0),),
    S.SPO2: (_needs("spo2_percent", lambda: number("spo2_percent").between(0, 100)),),
    S.SLEEP: (*_interval(whole), _if_there("stage", "stage", lambda: text("stage").isin(*S.SLEEP_STAGES))),
    S.LIFE_EVENT: (
        _needs("kind", lambda: text("kind").isin(*S.LIFE_KINDS)),
        _if_there("note", "note", lambda: text("note").isNotNull()),
        _if_there("logged_at", "logged_at", lambda: integer("logged_at") >= 0),
        _if_there("edited_at", "edited_at", lambda: integer("edited_at") >= 0),
        _if_there("edited_from", "edited_from", lambda: text("edited_from").rlike(UUID)),
        _if_there("duration_secs", "duration_secs", lambda: number("duration_secs") >= 0),
    ),
    S.RETRACTION: (_TARGET,),
    S.DELETION: (_TARGET,),
}


def problem(data_type: Column, rules: dict[str, tuple[Rule, ...]] | None = None) -> Column:
    """The first rule that a payload breaks, or null; over rows of :func:`parsed`."""
    out = F.when(F.col(_PAYLOAD).isNull(), "payload is no JSON").when(~_is(F.col(_KIND).startswith("OBJECT")), "payload is no object")
    for name, own in (rules or RULES).items():
        for rule in own:
            out = out.when((data_type == name) & rule.broken(), rule.reason)
    return out


def parsed(raw: DataFrame) -> DataFrame:
    """Raw rows with their payload parsed once."""
    rows = raw.withColumn(_PAYLOAD, F.explode(F.array(F.try_parse_json("payload"))))
    return rows.withColumn(_KIND, F.schema_of_variant(_PAYLOAD))


def judged(raw: DataFrame, rules: dict[str, tuple[Rule, ...]] | None = None) -> DataFrame:
    """Raw rows with ``payload_problem``."""
    return parsed(raw).select(*raw.columns, problem(F.col("data_type"), rules).alias("payload_problem"))
