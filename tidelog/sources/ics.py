"""Calendar files: VEVENTs of iCalendar texts, with DataFrame functions.

Folded lines are joined; floating times count as UTC.  Without DTEND and
DURATION an all-day event lasts a day, any other an hour; an end before the
start is moved to it.  An event is busy unless it is TRANSPARENT.

:func:`register` offers the same as a table function in SQL::

    SELECT * FROM calendar_events(TABLE(texts) PARTITION BY calendar)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidelog import schema as S


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "ics")


def _line(event: Column, name: str) -> Column:
    """Parameters and value of a property, as name;params:value."""
    found = F.regexp_extract(event, rf"(?m)^{name}((?:;[^:\r\n]*)?:[^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def _value(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))


def _seconds(value: Column) -> Column:
    day = F.unix_timestamp(F.try_to_timestamp(F.regexp_extract(value, r"^(\d{8})", 1), F.lit("yyyyMMdd")))
    clock = F.regexp_extract(value, r"^\d{8}T(\d{6})", 1)

    def part(i: int) -> Column:
        return F.substring(clock, i, 2).try_cast("bigint")

    return day + F.when(clock != "", part(1) * 3600 + part(3) * 60 + part(5)).otherwise(0)


def _duration(value: Column) -> Column:
    def part(unit: str, scope: Column) -> Column:
        return F.coalesce(F.regexp_extract(scope, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0))

    date = F.regexp_extract(value, r"^P([^T]*)", 1)
    time = F.regexp_extract(value, r"T(.*)$", 1)
    total = part("W", date) * 604800 + part("D", date) * 86400 + part("H", time) * 3600 + part("M", time) * 60 + part("S", time)
    return F.when(value.rlike(r"^P"), total)


def events(texts: DataFrame, column: str = "ics") -> DataFrame:
    """(uid, start_s, end_s, all_day, busy) of every VEVENT with UID and DTSTART."""
    unfolded = F.regexp_replace(F.col(column), r"\r?\n[ \t]", "")
    blocks = F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))
    rows = texts.select(F.explode(blocks).alias("event"))
    start, end = _line(F.col("event"), "DTSTART"), _line(F.col("event"), "DTEND")
    rows = rows.select(
        _value(_line(F.col("event"), "UID")).alias("uid"), _seconds(_value(start)).alias("start_s"),
        (start.contains("VALUE=DATE") & ~start.contains("VALUE=DATE-TIME") | ~_value(start).contains("T")).alias("all_day"),
        _seconds(_value(end)).alias("given_end"), _duration(_value(_line(F.col("event"), "DURATION"))).alias("lasts"),
        (F.coalesce(F.upper(_value(_line(F.col("event"), "TRANSP"))), F.lit("OPAQUE")) != "TRANSPARENT").alias("busy"),
    )
    usual = F.when(F.col("all_day"), 86400).otherwise(3600)
    finish = F.coalesce("given_end", F.col("start_s") + F.col("lasts"), F.col("start_s") + usual)
    rows = rows.filter((F.coalesce("uid", F.lit("")) != "") & F.col("start_s").isNotNull())
    return rows.select("uid", "start_s", F.greatest("start_s", finish).alias("end_s"), "all_day", "busy")


def once(events: DataFrame, now: int) -> DataFrame:
    """Each (uid, start, end) once, from a day before to two days after ``now``."""
    near = events.filter((F.col("end_s") >= now - 86400) & (F.col("start_s") <= now + 2 * 86400))
    return near.dropDuplicates(["uid", "start_s", "end_s"])


def observations(events: DataFrame, provider: str, now: int, subject: str = "all") -> DataFrame:
    """Calendar observations of the typed frame."""
    made = {"id": F.sha2(F.concat_ws("|", "uid", F.col("start_s").cast("string"), F.col("end_s").cast("string")), 256), "subject_id": F.lit(subject), "ts": F.lit(now), "provider_id": F.lit(provider), "data_type": F.lit(S.CALENDAR), "confidence": F.lit(1.0), "created_at": F.lit(now)}
    made |= {c: F.col(c) for c in ("uid", "start_s", "end_s", "all_day", "busy")}
    return events.select(*[made.get(c, F.lit(None)).cast(k).alias(c) for c, k in S.COLUMNS.items()])


_BLOCK = re.compile(r"BEGIN:VEVENT\r?\n(.*?)END:VEVENT", re.DOTALL)
_DURATION = {"W": 604800, "D": 86400, "H": 3600, "M": 60, "S": 1}


def _property(event: str, name: str) -> tuple[str, str] | None:
    """Parameters and value of the first line of a property."""
    found = re.search(rf"(?:\A|(?<=\n)|(?<=\r)(?!\n)){name}((?:;[^:\r\n]*)?):([^\r\n]*)", event)
    return (found[1], found[2].strip(" ")) if found else None


def _second(value: str) -> int | None:
    found = re.match(r"(\d{8})(?:T(\d\d)(\d\d)(\d\d))?", value, re.ASCII)
    try:
        day = int(datetime.strptime(found[1], "%Y%m%d").replace(tzinfo=UTC).timestamp()) if found else None
    except ValueError:
        return None
    return None if day is None else day + (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4]) if found[2] else 0)


def _lasting(value: str) -> int | None:
    if not value.startswith("P"):
        return None
    date, _, clock = value.partition("T")

    def part(unit: str) -> int:
        found = re.search(rf"(\d+){unit}", date if unit in "WD" else clock, re.ASCII)
        return int(found[1]) if found and int(found[1]) < 2**63 else 0

    return sum(part(unit) * seconds for unit, seconds in _DURATION.items())


def _parsed(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    for block in _BLOCK.findall(re.sub(r"\r?\n[ \t]", "", text)):
        uid, start, end, lasts, shown = (_property(block, n) for n in ("UID", "DTSTART", "DTEND", "DURATION", "TRANSP"))
        at = _second(start[1]) if start else None
        if not uid or not uid[1] or at is None:
            continue
        given = start[0] + ":" + start[1]
        whole = "VALUE=DATE" in given and "VALUE=DATE-TIME" not in given or "T" not in start[1]
        finish = _second(end[1]) if end else None
        if finish is None:
            length = _lasting(lasts[1]) if lasts else None
            finish = at + (length if length is not None else 86400 if whole else 3600)
        yield uid[1], at, max(at, finish), whole, not (shown and shown[1].upper() == "TRANSPARENT")


_EVENT = T.StructType([T.StructField(*f) for f in (("uid", T.StringType()), ("start_s", T.LongType()), ("end_s", T.LongType()), ("all_day", T.BooleanType()), ("busy", T.BooleanType()))])


class CalendarEvents:
    """Rows of :func:`events` for each text of the table, after the columns of the
    table but the text.  Texts are taken one by one, so a partition may be of any
    size; null texts and texts without events give nothing."""

    @staticmethod
    def analyze(texts: AnalyzeArgument, column: AnalyzeArgument | None = None) -> AnalyzeResult:
        name = column.value if column is not None else "ics"
        if not texts.isTable or name not in texts.dataType.fieldNames():
            raise ValueError(f"calendar_events takes a table with a column {name!r}")
        clashes = sorted((set(texts.dataType.fieldNames()) - {name}) & set(_EVENT.names))
        if clashes:
            raise ValueError(f"columns of the table are named as those of events: {clashes}")
        return AnalyzeResult(T.StructType([f for f in texts.dataType if f.name != name] + _EVENT.fields))

    def eval(self, texts: Row, column: str = "ics") -> Iterator[tuple]:
        further = tuple(v for k, v in texts.asDict(recursive=False).items() if k != column)
        for event in _parsed(texts[column] or ""):
            yield further + event


def register(spark: SparkSession) -> None:
    """``calendar_events([column => 'ics',] texts => TABLE(...) [PARTITION BY ...])`` in SQL."""
    spark.udtf.register("calendar_events", F.udtf(CalendarEvents))
