"""Life events by append only: log, retract, restore and retime.

Each function returns the rows to append; readers see their effect through the
marker filters.  Restoring and retiming append a copy that names the event it
is of (``edited_from``) and keeps when that was logged, as a marker stays.  An
event is restored once: where a copy is there, whatever made it, none is added,
also if the same request runs again at another time.

A request for a time out of bounds adds nothing; :func:`refusal` tells why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S


#: How far back, and how far ahead of the clock, an event may lie.
MOST_BACK, MOST_AHEAD = 86400, 60


def refusal(at: Column, now: int) -> Column:
    """Why an event may not be put at this time, or null."""
    return F.when(at > now + MOST_AHEAD, "in the future").when(at < now - MOST_BACK, "more than 24 hours back")


class UnknownKind(ValueError):
    """No life event has this kind."""


def _rows(rows: DataFrame, **values: Column) -> DataFrame:
    """Typed observations with the given columns, null elsewhere."""
    return rows.select(*[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in S.COLUMNS.items()])


def log(requests: DataFrame, kind: str, now: int, provider: str = "manual") -> DataFrame:
    """An event of ``kind`` for each of ``requests`` (id, subject_id, ts; a null
    ts is now)."""
    if kind not in S.LIFE_KINDS:
        raise UnknownKind(kind)
    at = F.coalesce(F.col("ts"), F.lit(now))
    return _rows(requests.filter(refusal(at, now).isNull()), id=F.col("id"), subject_id=F.col("subject_id"), ts=at, provider_id=F.lit(provider), data_type=F.lit(S.LIFE_EVENT), confidence=F.lit(1.0), created_at=F.lit(now), life_kind=F.lit(kind), logged_at=F.lit(now))


def retract(obs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Markers for those of ``ids`` (id) that are life events without a marker."""
    marked = obs.filter(F.col("data_type") == S.RETRACTION).select(F.col("target_id").alias("id"))
    events = obs.filter(F.col("data_type") == S.LIFE_EVENT).join(ids.select("id").distinct(), "id", "left_semi").join(marked, "id", "left_anti")
    mark = F.sha2(F.concat_ws("|", F.lit("retract"), "id"), 256)
    return _rows(events, id=mark, subject_id=F.col("subject_id"), ts=F.lit(now), provider_id=F.col("provider_id"), data_type=F.lit(S.RETRACTION), confidence=F.lit(1.0), created_at=F.lit(now), target_id=F.col("id"))


def _again(obs: DataFrame, events: DataFrame, ts: Column, now: int, why: str) -> DataFrame:
    """Copies of those of ``events`` that no copy is of yet."""
    copied = obs.filter((F.col("data_type") == S.LIFE_EVENT) & F.col("edited_from").isNotNull()).select(F.col("edited_from").alias("id"))
    events = events.join(copied, "id", "left_anti")
    new = F.sha2(F.concat_ws("|", F.lit(why), "id", ts.cast("string")), 256)
    logged = F.coalesce("logged_at", "ts")
    return _rows(events, id=new, subject_id=F.col("subject_id"), ts=ts, provider_id=F.col("provider_id"), data_type=F.lit(S.LIFE_EVENT), confidence=F.col("confidence"), created_at=F.lit(now), life_kind=F.col("life_kind"), logged_at=logged, edited_from=F.col("id"))


def restore(obs: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """A new event with kind and time of each retracted one of ``ids`` (id)."""
    marked = obs.filter(F.col("data_type") == S.RETRACTION).select(F.col("target_id").alias("id"))
    events = obs.filter(F.col("data_type") == S.LIFE_EVENT).join(ids.select("id").distinct(), "id", "left_semi").join(marked, "id", "left_semi")
    return _again(obs, events, F.col("ts"), now, "restore")


def retime(obs: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """For ``changes`` (id, new_ts): markers for the visible events and new events
    at the new times."""
    changes = changes.filter(refusal(F.col("new_ts"), now).isNull())
    marks = retract(obs, changes, now)
    visible = obs.filter(F.col("data_type") == S.LIFE_EVENT).join(marks.select(F.col("target_id").alias("id")), "id", "left_semi")
    moved = visible.join(changes.groupBy("id").agg(F.max("new_ts").alias("new_ts")), "id")
    return marks.unionByName(_again(obs, moved, F.col("new_ts"), now, "retime"))
