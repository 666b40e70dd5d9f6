"""A stored series of features, brought up to date by what is new in the log.

A refresh takes the rows after the stored cursor (created_at, id): late ones,
corrections and markers as well as new ones.  They touch

* for :data:`LOCAL` features, which read a window of 900 s and nothing else,
  the days of the ends whose window holds them;
* for other features the whole history of their subjects, as baselines and
  sums of any length may change.

What is touched is computed anew from the visible rows around it, and written
under the refresh's number, together with the list of what it replaces: a
reader takes each part from its last refresh.  The marks (cursor and spans of
the subjects) are written last and make the refresh count, so a refresh that
failed leaves nothing behind that is read, and is repeated under its number.

One refresh may run at a time.  Rows must enter the log in order of their
cursor; a row that does so with one that has passed is seen when the next row
touches its day (or subject).  Rows without a subject have no features.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.operators.scans import visible
from tidelog.operators.stored import stored
from tidelog.plans import windows as W
from tidelog.plans.features import COLUMNS, FEATURES, Catalog
from tidelog.plans.panes import day_of
from tidelog.plans.windows import DAY, WINDOW

LOCAL = (
    "context_switch_rate", "focus_score", "stress_index", "distraction_score", "media_share", "git_rate", "light_share", "activity_balance", "notification_pressure",
)
MARKS = "version bigint, created_at bigint, id string, subject_id string, min_ts bigint, max_ts bigint"
PART = "subject_id string, local boolean, chunk bigint"


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    folder = os.path.join(path, name)
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, name: str, version: int) -> None:
    df.drop("version").write.mode("overwrite").parquet(os.path.join(path, name, f"version={version}"))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """Cursor and spans of the last refresh that ended."""
    marks = _read(spark, path, "marks", MARKS)
    last = marks.agg(F.max("version")).first()[0]
    return marks.filter(F.col("version") == last) if last is not None else marks.limit(0)


def _touched_days(rows: DataFrame) -> DataFrame:
    """(subject_id, chunk): the days of the ends whose window holds ``ts``."""
    days = F.explode(F.sequence(day_of(F.col("ts")), day_of(F.col("ts") + WINDOW)))
    return rows.filter("subject_id IS NOT NULL AND ts IS NOT NULL").select("subject_id", days.alias("chunk")).distinct()


def refresh(log: DataFrame, path: str, names: tuple[str, ...] = tuple(FEATURES), step: int = 60) -> int:
    """Brings the series at ``path`` up to date and returns the number of parts
    (days for local features, subjects for others) that were computed.  A path
    holds the features ``names`` at one step; other ones need a path of their own."""
    spark = log.sparkSession
    marks = _marks(spark, path)
    mark = marks.select("version", "created_at", "id").first()
    version = mark["version"] + 1 if mark else 1
    new = log.select("id", "subject_id", "ts", "created_at", "data_type", "target_id")
    if mark:
        new = new.filter((F.col("created_at") > mark["created_at"]) | (F.col("created_at") == mark["created_at"]) & (F.col("id") > mark["id"]))
    new = stored(new)
    cursor = new.agg(F.max(F.struct("created_at", "id")).alias("c")).select("c.*").first()
    if cursor["created_at"] is None:
        return 0
    marker = F.col("data_type").isin(S.RETRACTION, S.DELETION)
    named = new.filter(marker).select(F.col("target_id").alias("id")).distinct()
    places = new.filter(~marker).select("subject_id", "ts").unionByName(log.join(named, "id", "left_semi").select("subject_id", "ts"))
    shown = visible(log).filter("subject_id IS NOT NULL")
    spans = stored(W.spans(shown))
    # where a subject's last second moves, the end off the grid goes or comes with it
    old = marks.filter("subject_id IS NOT NULL").select("subject_id", F.col("max_ts").alias("ts"))
    now = spans.select("subject_id", F.col("max_ts").alias("ts"))
    moved = old.unionByName(now).groupBy("subject_id").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n"))
    moved = moved.filter("low <> high OR n = 1").select("subject_id", F.explode(F.array("low", "high")).alias("ts"))
    places = places.unionByName(moved)
    days = _touched_days(places).withColumn("local", F.lit(True))
    subjects = days.select("subject_id", F.lit(False).alias("local"), F.lit(0).cast("bigint").alias("chunk")).distinct()
    local, whole = [n for n in names if n in LOCAL], [n for n in names if n not in LOCAL]
    parts = stored((days.limit(0) if not local else days).unionByName(subjects.limit(0) if not whole else subjects))
    frames = []
    if local:
        frames.append(_local(shown, parts.filter("local"), spans, local, step))
    if whole:
        touched = stored(shown.join(parts.filter("NOT local").select("subject_id"), "subject_id", "left_semi"))
        made = Catalog(touched, step, keep=True, most=None).all(*whole)
        frames.append(made.withColumns({"local": F.lit(False), "chunk": F.lit(0).cast("bigint")}))
    for frame in frames[1:]:
        frames[0] = frames[0].unionByName(frame)
    _write(frames[0], path, "rows", version)
    _write(parts, path, "parts", version)
    known = spans.unionByName(spark.createDataFrame([(None, None, None)], "subject_id string, min_ts bigint, max_ts bigint"))
    _write(known.withColumns({"created_at": F.lit(cursor["created_at"]), "id": F.lit(cursor["id"])}), path, "marks", version)
    return parts.count()


def _local(shown: DataFrame, days: DataFrame, spans: DataFrame, names: list[str], step: int) -> DataFrame:
    """Local features at the ends of ``days``, from their rows and the rows of
    the 900 s before each day."""
    span = days.agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).first()
    if span["low"] is not None:
        shown = shown.filter(F.col("ts").between(span["low"] * DAY - WINDOW, (span["high"] + 1) * DAY - 1))
    reach = F.array_distinct(F.array(day_of(F.col("ts")), day_of(F.col("ts") + WINDOW)))
    reached = shown.select("subject_id", "id", F.explode(reach).alias("chunk")).join(days, ["subject_id", "chunk"], "left_semi")
    rows = stored(shown.join(reached.select("subject_id", "id").distinct(), ["subject_id", "id"], "left_semi"))
    made = Catalog(rows, step, keep=True, most=None, spans=spans).all(*names).withColumn("chunk", day_of(F.col("w_end")))
    return made.join(days.select("subject_id", "chunk"), ["subject_id", "chunk"], "left_semi").withColumn("local", F.lit(True))


def series(spark: SparkSession, path: str) -> DataFrame:
    """The features as of the last refresh that ended, each part from the last
    refresh that replaced it."""
    last = _marks(spark, path).agg(F.max("version")).first()[0]
    empty = Catalog(spark.createDataFrame([], S.TYPED_DDL)).all("stress_index")
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in empty.schema.fields]
    rows = _read(spark, path, "rows", ", ".join([*columns, "local boolean", "chunk bigint", "version bigint"]))
    parts = _read(spark, path, "parts", f"{PART}, version bigint").filter(F.col("version") <= F.lit(last))
    current = parts.groupBy("subject_id", "local", "chunk").agg(F.max("version").alias("version"))
    return rows.join(current, ["subject_id", "local", "chunk", "version"], "left_semi").select("feature_id", *COLUMNS)
