"""The table function for calendar texts against the DataFrame form."""

from __future__ import annotations

import random

import pytest

from tidelog.sources import ics

LINES = [
    "UID:one", "UID:a b ", "UID:", "UID;X=1:two", "DTSTART:20240101T100000Z", "DTSTART;VALUE=DATE:20240102", "DTSTART;VALUE=DATE-TIME:20240102T010203", "DTSTART:20240230", "DTSTART:2024", "DTSTART;TZID=Europe/Rome:20240310T996199",
    "DTEND:20240101T110000Z", "DTEND;VALUE=DATE:20231231", "DTEND:x", "DURATION:PT1H30M", "DURATION:P1W2DT3S", "DURATION:1H", "DURATION:P", "DURATION:PT99999999999999999999S", "TRANSP:TRANSPARENT", "TRANSP: transparent", "TRANSP:OPAQUE", "XUID:no", "SUMMARY:DTSTART:20200101", " folded", "\tmore", "DTSTART:20240101T1000",
]


def texts(spark, n: int):
    rng = random.Random(5)
    made = []
    for i in range(n):
        end = rng.choice(("\r\n", "\n"))
        blocks = [end.join(["BEGIN:VEVENT", *rng.sample(LINES, rng.randrange(1, 9)), *rng.choice(([], ["UID:z", "DTSTART:20240505T050505Z"])), "END:VEVENT"]) for _ in range(rng.randrange(4))]
        made.append((f"c{i % 3}" if i % 7 else None, i, end.join(["BEGIN:VCALENDAR", *blocks, "END:VCALENDAR"])))
    return spark.createDataFrame([*made, ("c0", -1, None), ("c0", -2, ""), ("c0", -3, "BEGIN:VEVENT")], "calendar string, n int, ics string")


def plain(df):
    return sorted(map(repr, df.select("uid", "start_s", "end_s", "all_day", "busy").collect()))


def test_equals_the_dataframe_form(spark):
    ics.register(spark)
    rows = texts(spark, 400)
    rows.createOrReplaceTempView("calendar_texts")
    want = plain(ics.events(rows))
    assert len(want) > 200
    got = spark.sql("SELECT * FROM calendar_events(TABLE(calendar_texts) PARTITION BY calendar)")
    assert got.columns == ["calendar", "n", "uid", "start_s", "end_s", "all_day", "busy"]
    assert plain(got) == want == plain(spark.sql("SELECT * FROM calendar_events(TABLE(calendar_texts))"))
    one = got.filter("n = 9").drop("calendar", "n")
    assert plain(one) == plain(ics.events(rows.filter("n = 9")))


def test_other_columns(spark):
    """The text may have any name; columns named as those of events are refused."""
    ics.register(spark)
    texts(spark, 20).withColumnRenamed("ics", "body").createOrReplaceTempView("bodies")
    assert spark.sql("SELECT * FROM calendar_events(column => 'body', texts => TABLE(bodies) PARTITION BY calendar)").count() > 0
    with pytest.raises(Exception, match="takes a table with a column 'ics'"):
        spark.sql("SELECT * FROM calendar_events(TABLE(bodies))").count()
    spark.sql("SELECT body AS ics, n AS uid FROM bodies").createOrReplaceTempView("clashing")
    with pytest.raises(Exception, match="named as those of events"):
        spark.sql("SELECT * FROM calendar_events(TABLE(clashing))").count()
