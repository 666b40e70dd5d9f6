"""Window grids: ends every ``step`` seconds, windows closed on both sides.

A subject's grid spans all of its rows, whatever their type; at most the latest
``most`` aligned ends count (all of them, if it is None), and an end at the very
last second is added where it is off the grid.  Observations are summed by panes
(:mod:`tidelog.plans.panes`); meetings and their gaps, which are few and short,
are exploded to the ends they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MOST_ENDS, DAY = 900, 1440, 86400


def spans(rows: DataFrame, low: str = "ts", high: str = "ts") -> DataFrame:
    return rows.groupBy("subject_id").agg(F.min(low).alias("min_ts"), F.max(high).alias("max_ts"))


def bounds(spans: DataFrame, step: int, most: int | None = MOST_ENDS) -> DataFrame:
    """(subject_id, first_end, last_end, tip, min_ts, max_ts)."""
    last = (F.floor(F.col("max_ts") / step) * step).cast("bigint")
    first = (F.ceil(F.col("min_ts") / step) * step).cast("bigint")
    tip = F.col("last_end") < F.col("max_ts")
    if most is not None:
        first = F.greatest(first, F.col("last_end") - (most - 1) * step)
        count = F.when(F.col("first_end") <= F.col("last_end"), (F.col("last_end") - F.col("first_end")) / step + 1).otherwise(0)
        tip = tip & (count < most)
    tip = F.when(tip, F.col("max_ts"))
    return spans.withColumn("last_end", last).withColumn("first_end", first).withColumn("tip", tip)


def _ends(low: Column, high: Column, step: int) -> Column:
    """The grid's ends within [low, high], as an array."""
    a = F.greatest((F.ceil(low / step) * step).cast("bigint"), F.col("first_end"))
    b = F.least((F.floor(high / step) * step).cast("bigint"), F.col("last_end"))
    aligned = F.when(a <= b, F.sequence(a, F.greatest(a, b), F.lit(step).cast("bigint"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    tip = F.when(F.col("tip").between(low, high), F.array("tip")).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.concat(aligned, tip)


def days(bounds: DataFrame, step: int) -> DataFrame:
    """(subject_id, min_ts, chunk, first_end, last_end, tip): the days of the grid,
    each with its own bounds.  What is joined by subject and day, not by subject
    alone, leaves no subject's whole history to one task."""
    end = F.greatest("last_end", "max_ts")
    grid = bounds.withColumn("chunk", F.explode(F.sequence(F.floor(F.least(F.col("first_end"), end) / DAY), F.floor(end / DAY))))
    low, high = F.col("chunk") * DAY, (F.col("chunk") + 1) * DAY - 1
    first = F.greatest("first_end", (F.ceil(low / step) * step).cast("bigint"))
    tip = F.when(F.col("tip").between(low, high), F.col("tip"))
    return grid.select("subject_id", "min_ts", "chunk", first.alias("first_end"), F.least(F.col("last_end"), high).alias("last_end"), tip.alias("tip"))


def ends(bounds: DataFrame, step: int) -> DataFrame:
    """(subject_id, min_ts, w_end): the whole grid, made day by day."""
    low = F.col("chunk") * DAY
    return days(bounds, step).select("subject_id", "min_ts", F.explode(_ends(low, low + DAY - 1, step)).alias("w_end"))


def at_ends(rows: DataFrame, bounds: DataFrame, low: Column, high: Column, step: int) -> DataFrame:
    """Each row once for every grid end within [low, high], day by day."""
    held = rows.withColumn("chunk", F.explode(F.sequence(F.floor(low / DAY), F.floor(high / DAY))))
    joined = held.join(days(bounds, step).drop("min_ts"), ["subject_id", "chunk"])
    return joined.withColumn("w_end", F.explode(_ends(low, high, step))).drop("chunk", "first_end", "last_end", "tip")

