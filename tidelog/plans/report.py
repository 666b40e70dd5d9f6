"""Markdown reports from already aggregated rows."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKS = {"daily_v1": ("features", "insights", "life_events", "recommendations"), "features_v1": ("features",)}


class UnknownPack(ValueError):
    """No report pack has this id."""


def feature_lines(runs: DataFrame) -> DataFrame:
    """One line for each run of a feature."""
    number = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string("%.4f", F.col(c))).otherwise("n/a")
    text = F.format_string("- %s [%d..%d]: first %s, last %s, low %s, high %s, %d samples, %s", "feature_id", "run_start", "run_end", number("first"), number("last"), number("low"), number("high"), "samples", "trend")
    return runs.orderBy("subject_id", "feature_id", "run_start", "run_end").select("subject_id", F.col("run_start").alias("at"), text.alias("line"))


def life_event_lines(events: DataFrame) -> DataFrame:
    """Table lines of life events (subject_id, id, ts, created_at, life_kind), in
    order of (time, id) within a subject; without events there is no table."""
    kind = F.replace("life_kind", F.lit("|"), F.lit("\\|"))
    text = F.format_string("| %s | %d | %d | observation:%s |", kind, "ts", "created_at", "id")
    rows = events.select("subject_id", F.col("ts").alias("at"), text.alias("line"), F.lit(1).alias("part"), "id")
    head = events.select("subject_id").distinct().select("subject_id", F.lit(None).cast("bigint").alias("at"), F.lit("| event | happened (s) | logged (s) | id |\n| :--- | :--- | :--- | :--- |").alias("line"), F.lit(0).alias("part"), F.lit("").alias("id"))
    return head.unionByName(rows).orderBy("subject_id", "part", "at", "id").select("subject_id", "at", "line")


def channel_lines(states: DataFrame) -> DataFrame:
    """Lines of a section on channels (of :func:`tidelog.plans.series.channel_states`):
    how many of the watch's arrived, then each channel's rows and last second."""
    watch = states.filter("side = 'watch'").agg(F.count_if(F.col("rows") > 0).alias("came"), F.count("*").alias("all"))
    head = watch.select(F.lit(-1).alias("at"), F.format_string("- watch channels with rows: %d of %d", "came", "all").alias("line"))
    said = F.when(F.col("state") == "rows", F.format_string("%d rows, last at %d", "rows", "last_ts")).when(F.col("state") == "off", "collection is off").otherwise("no rows")
    return head.unionByName(states.select(F.col("place").alias("at"), F.concat_ws("", F.lit("- "), "side", F.lit(" "), "data_type", F.lit(": "), said).alias("line"))).orderBy("at")


#: Conditions that a person may declare.
CONDITIONS = ("sleep_sensitive", "migraine_prone", "caffeine_sensitive")


def health_context(text: str) -> tuple[list[str], str] | None:
    """(known conditions, note) of a TOML text's ``health_context``; none where it
    can't be read or says nothing."""
    try:
        said = tomllib.loads(text)["health_context"]
        named = [c.strip() for c in said.get("conditions", [])]
        note = said.get("note", "").strip()
    except (tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError):
        return None
    found = [c for c in dict.fromkeys(named) if c in CONDITIONS]
    return (found, note) if found or note else None


def report_lines(spark: SparkSession, pack: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(position, part, subject_id, at, line): every line of the pack's sections
    with its headings, to be ordered by these columns.  A section is a frame
    with ``line`` and, if it has them, ``subject_id`` and the time ``at``."""
    if pack not in PACKS:
        raise UnknownPack(pack)
    names = PACKS[pack]
    heads = [(0, 0, f"# Report {pack}"), *((i, 0, f"\n## {n.replace('_', ' ').capitalize()}\n") for i, n in enumerate(names, 1))]
    blank = F.lit(None).cast("string").alias("subject_id"), F.lit(None).cast("long").alias("at")
    fixed = lambda rows: spark.createDataFrame(rows, "position int, part int, line string").select("position", "part", *blank, "line")
    lines = fixed([])
    for i, name in enumerate(names, 1):
        if name in sections:
            given = sections[name]
            subject, at = (F.col(c) if c in given.columns else F.lit(None) for c in ("subject_id", "at"))
            lines = lines.unionByName(given.select(F.lit(i).alias("position"), F.lit(1).alias("part"), subject.cast("string").alias("subject_id"), at.cast("long").alias("at"), "line"))
    empty = fixed([(i, 1, "No entries.") for i in range(1, len(names) + 1)])
    empty = empty.join(lines.select("position").distinct(), "position", "left_anti")
    return fixed(heads).unionByName(lines).unionByName(empty)


def write(spark: SparkSession, pack: str, sections: dict[str, DataFrame], path: str) -> None:
    """Writes the whole report as a text table, its files in order."""
    report_lines(spark, pack, sections).orderBy("position", "part", "subject_id", "at", "line").select("line").write.text(path)


def render(spark: SparkSession, pack: str, sections: dict[str, DataFrame], subject_id: str) -> str:
    """The report of one subject, whose lines its grid bounds, as one text.
    Sections without subjects are left whole."""
    own = {n: s.filter(F.col("subject_id") == subject_id) if "subject_id" in s.columns else s for n, s in sections.items()}
    rows = report_lines(spark, pack, own).orderBy("position", "part", "at", "line").select("line").collect()
    return "\n".join(r["line"] for r in rows) + "\n"
