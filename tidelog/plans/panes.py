"""Sliding windows without a copy of each row for each window.

* :func:`sliding`: rows are summed by step-sized panes; a range frame over the
  panes of (subject, day) gives the closed windows at aligned ends.  A second
  that lies on the grid is a pane of its own, as it belongs to windows on both
  of its sides.  Only windows that hold a row are made.
* :func:`running`: what enters and leaves a long window is two events; running
  sums over (subject, day) give its sums at every end.
* :func:`listed`: the ids within a long window, from one list for a block of ends;
  no list goes through a scan.

Both work day by day, with the rows of earlier days that reach into a day
repeated there, so one subject's history spreads over many tasks, and a task's
group has a day's ends and panes at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.plans.windows import DAY, WINDOW, days


def day_of(at: Column) -> Column:
    return F.floor(at / DAY).cast("bigint")


def by_day(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each row once for every day that [low, high] touches, as ``chunk``."""
    return rows.withColumn("chunk", F.explode(F.sequence(day_of(low), day_of(high))))


def inside(rows: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """``rows`` (subject_id, ts, ...) with the columns of the items (subject_id, low,
    high, ...) that hold them, low <= ts <= high; both meet by ``block`` of seconds,
    so that no subject's rows come together."""
    items = items.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor(F.col("high") / block))))
    held = rows.withColumn("block", F.floor(F.col("ts") / block)).join(items, ["subject_id", "block"])
    return held.filter(F.col("ts").between(F.col("low"), F.col("high"))).drop("block", "low", "high")


@dataclass(frozen=True)
class Sum:
    """A column of windows: ``value`` summed up; null if no row has one."""

    name: str
    value: Column

    def partial(self) -> list[Column]:
        return [F.sum(self.value).alias(f"p_{self.name}")]

    def merged(self, over) -> Column:
        return over(F.sum, f"p_{self.name}")


@dataclass(frozen=True)
class Count(Sum):
    """How many rows meet the condition ``value``."""

    def partial(self) -> list[Column]:
        return [F.count_if(self.value).alias(f"p_{self.name}")]

    def merged(self, over) -> Column:
        return F.coalesce(over(F.sum, f"p_{self.name}"), F.lit(0))


@dataclass(frozen=True)
class Mean(Sum):
    def partial(self) -> list[Column]:
        return [F.sum(self.value).alias(f"p_{self.name}"), F.count(self.value).alias(f"k_{self.name}")]

    def merged(self, over) -> Column:
        many = over(F.sum, f"k_{self.name}")
        return F.when(many > 0, over(F.sum, f"p_{self.name}") / many)


@dataclass(frozen=True)
class Most(Sum):
    def partial(self) -> list[Column]:
        return [F.max(self.value).alias(f"p_{self.name}")]

    def merged(self, over) -> Column:
        return over(F.max, f"p_{self.name}")


@dataclass(frozen=True)
class Listed(Sum):
    def partial(self) -> list[Column]:
        return [F.collect_list(self.value).alias(f"p_{self.name}")]

    def merged(self, over) -> Column:
        return F.flatten(over(F.collect_list, f"p_{self.name}"))


@dataclass(frozen=True)
class Different(Sum):
    """How many different values there are."""

    def partial(self) -> list[Column]:
        return [F.collect_set(self.value).alias(f"p_{self.name}")]

    def merged(self, over) -> Column:
        return F.size(F.array_distinct(F.flatten(over(F.collect_list, f"p_{self.name}"))))


@dataclass(frozen=True)
class Changes(Sum):
    """How many rows differ (``value``, null for rows that don't count) from the
    row before them within the window, in the order of ``order``: all that
    differ, less the window's first row, whose forerunner lies outside."""

    order: Column

    def partial(self) -> list[Column]:
        counts = self.value.isNotNull()
        return [F.count_if(self.value).alias(f"p_{self.name}"), F.min_by(self.value, F.when(counts, self.order)).alias(f"f_{self.name}")]

    def merged(self, over) -> Column:
        first = over(lambda c: F.first(c, ignorenulls=True), f"f_{self.name}")
        return F.coalesce(over(F.sum, f"p_{self.name}") - F.coalesce(first, F.lit(False)).cast("int"), F.lit(0))


def sliding(rows: DataFrame, bounds: DataFrame, step: int, columns: Sequence[Sum], width: int = WINDOW) -> DataFrame:
    """(subject_id, w_end, columns) of every closed window [w_end - width, w_end]
    of the grid that holds one of the rows (subject_id, ts)."""
    pane = gcd(step, width)
    reach = 2 * width // pane
    partial = [c for x in columns for c in x.partial()]
    names = [p for x in columns for p in (f"p_{x.name}", *([f"k_{x.name}"] if isinstance(x, Mean) else [f"f_{x.name}"] if isinstance(x, Changes) else []))]
    # odd: within a pane; even: the second at its end
    place = (2 * F.ceil(F.col("ts") / pane) - (F.col("ts") % pane != 0).cast("int")).cast("bigint")
    panes = rows.withColumn("place", place).groupBy("subject_id", "place").agg(*partial)
    at = F.ceil(F.col("place") / 2) * pane
    panes = by_day(panes, at, at + width).join(days(bounds, step).drop("min_ts", "tip"), ["subject_id", "chunk"])
    after = F.lead("place").over(Window.partitionBy("subject_id", "chunk").orderBy("place"))
    panes = panes.withColumn("limit", F.least(F.col("place") + reach, F.coalesce(after - 1, F.col("place") + reach)))
    # ends of this day from this pane on, up to the next pane
    low = F.greatest(F.ceil(F.col("place") / 2) * pane, F.col("first_end"), F.col("chunk") * DAY)
    high = F.least(F.floor(F.col("limit") / 2) * pane, F.col("last_end"), (F.col("chunk") + 1) * DAY - 1)
    low, high = (F.ceil(low / step) * step).cast("bigint"), (F.floor(high / step) * step).cast("bigint")
    none = F.expr("cast(array() as array<bigint>)")
    own = F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(step).cast("bigint"))).otherwise(none)
    panes = panes.select("subject_id", "chunk", "place", own.alias("ends"), *names)
    # the end off the grid has a pane of its own, the window itself
    tips = bounds.filter("tip is not null").select("subject_id", "tip", (F.col("tip") - width).alias("low"), F.col("tip").alias("high"))
    tip = inside(rows, tips, width).groupBy("subject_id", "tip").agg(*partial)
    tip = tip.select("subject_id", F.lit(-1).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("place"), F.array("tip").alias("ends"), *names)
    points = panes.unionByName(tip).withColumn("w_end", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "ends")))
    mine = F.col("w_end").isNull()
    points = points.select("subject_id", "chunk", F.when(mine | (F.col("chunk") < 0), F.col("place")).otherwise((F.col("w_end") / pane).cast("bigint") * 2).alias("place"), "w_end", *[F.when(mine, F.col(n)).alias(n) for n in names])
    frame = Window.partitionBy("subject_id", "chunk").orderBy("place").rangeBetween(-reach, 0)
    out = points.select("subject_id", "w_end", *[x.merged(lambda f, c: f(F.col(c)).over(frame)).alias(x.name) for x in columns])
    return out.filter("w_end is not null")


def running(events: DataFrame, ends: DataFrame, up: dict[str, Column], down: dict[str, Column] | None = None) -> DataFrame:
    """(subject_id, w_end, up, down): aggregates of all events (subject_id,
    chunk, at, ...) of the end's day up to it; for ``down``, of those after it."""
    points = events.withColumn("w_end", F.lit(None).cast("bigint")).unionByName(ends.select("subject_id", day_of(F.col("w_end")).alias("chunk"), F.col("w_end").alias("at"), "w_end"), allowMissingColumns=True)
    days = Window.partitionBy("subject_id", "chunk").rowsBetween(Window.unboundedPreceding, 0)
    first = days.orderBy("at", F.col("w_end").isNotNull())
    points = points.withColumns({n: c.over(first) for n, c in up.items()})
    if down:
        last = days.orderBy(F.desc("at"), F.col("w_end").isNull())
        points = points.withColumns({n: c.over(last) for n, c in down.items()})
    return points.filter("w_end is not null").select("subject_id", "w_end", *up, *(down or {}))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in as many tasks as the session shuffles to: what few
    bytes grow to is not known to the planner, which would put them into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_blocks(items: DataFrame, block: int) -> DataFrame:
    """Each item once for every ``block`` of seconds that its [low, high] touches."""
    low, high = F.floor(F.col("low") / block), F.floor(F.col("high") / block)
    return spread(items.filter("low <= high").withColumn("block", F.explode(F.sequence(low, high))), "subject_id", "block")


def listed(rows: DataFrame, items: DataFrame, block: int, columns: dict[str, Column], distinct: bool = False) -> DataFrame:
    """``rows`` (subject_id, w_end, ...) with the sorted ids of the items (subject_id,
    id, low, high, ...) that hold the row's end, low <= w_end <= high: one column
    for each condition on the items; each id once, where ``distinct``.

    Ids are sorted once for a block of ends.  What holds the whole block is taken as
    it stands, only the rest is asked for each end; a task holds a block's
    items, and writes one end's at a time."""
    end, first = F.col("w_end"), F.col("block") * block
    whole = (F.col("low") <= first) & (F.col("high") >= first + block - 1)
    aggregates = [F.when(F.size(F.array_distinct(F.collect_list("id"))) < F.count("id"), True).otherwise(False).alias("_twice")] if distinct else []
    for n, c in columns.items():
        aggregates += [F.sort_array(F.collect_list(F.when(c & whole, F.col("id")))).alias(f"_whole_{n}"), F.sort_array(F.collect_list(F.when(c & ~whole, F.struct("id", "low", "high")))).alias(f"_part_{n}")]
    lists = in_blocks(items, block).groupBy("subject_id", "block").agg(*aggregates)
    held = spread(rows.withColumn("block", F.floor(end / block)), "subject_id", "block").join(lists.hint("merge"), ["subject_id", "block"], "left")

    def own(n: str) -> Column:
        part = F.filter(f"_part_{n}", lambda x: (x["low"] <= end) & (x["high"] >= end))["id"]
        ids = F.sort_array(F.concat(f"_whole_{n}", part))
        return F.when(F.col("_twice"), F.array_distinct(ids)).otherwise(ids) if distinct else ids

    return held.select(*rows.columns, *[own(n).alias(n) for n in columns])


def carried(points: DataFrame, value: str, order: list[Column | str], name: str) -> DataFrame:
    """``points`` (subject_id, chunk, ...) with the sum of ``value`` over all of
    the subject's points so far: a scan within each day, plus what earlier days
    sum up to, from one row a day."""
    daily = points.groupBy("subject_id", "chunk").agg(F.sum(value).alias("sum"))
    before = Window.partitionBy("subject_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select("subject_id", "chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carry"))
    within = Window.partitionBy("subject_id", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(name, F.sum(value).over(within)).join(daily, ["subject_id", "chunk"]).withColumn(name, F.col(name) + F.col("carry")).drop("carry")


def looking_back(rows: DataFrame, seconds: int, columns: dict[str, Column]) -> DataFrame:
    """``rows`` (subject_id, w_end, ...) with aggregates over the rows of the
    last ``seconds``, day by day."""
    held = by_day(rows, F.col("w_end"), F.col("w_end") + seconds)
    back = Window.partitionBy("subject_id", "chunk").orderBy("w_end").rangeBetween(-seconds, 0)
    return held.withColumns({n: c.over(back) for n, c in columns.items()}).filter(F.col("chunk") == day_of(F.col("w_end"))).drop("chunk")


def merged_runs(rows: DataFrame, by: list[str], at: str, joins: Callable[[Column, Column], Column], reach: int, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(by, run_start, run_end, columns): runs of rows, ordered by ``at``, where
    ``joins(before, at)`` holds between neighbours; it must not hold for more than
    ``reach`` seconds (at most a day).  ``columns`` gives for each name the
    aggregate of a run's rows, and that of the values ``name`` of its parts.

    Days are scanned apart.  Only runs that come within ``reach`` of a day's
    bounds can go on in the next day; these few are joined in a second scan."""
    if not 0 <= reach <= DAY:
        raise ValueError(f"reach: {reach}")
    rows = rows.withColumn("chunk", day_of(F.col(at)))
    within = Window.partitionBy(*by, "chunk").orderBy(at)
    opens = (~F.coalesce(joins(F.lag(at).over(within), F.col(at)), F.lit(False))).cast("int")
    rows = rows.withColumn("opens", opens).withColumn("run", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*by, "chunk", "run").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), *[c.alias(n) for n, (c, _) in columns.items()])
    low, high = F.col("chunk") * DAY, (F.col("chunk") + 1) * DAY
    parts = parts.withColumn("border", (F.col("run_start") - low < reach) | (high - F.col("run_end") <= reach))
    names = [*by, "run_start", "run_end", *columns]
    across = Window.partitionBy(*by).orderBy("run_start")
    ahead = F.coalesce(joins(F.lag("run_end").over(across), F.col("run_start")), F.lit(False))
    border = parts.filter("border").withColumn("opens", (~ahead).cast("int"))
    border = border.withColumn("run", F.sum("opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    border = border.groupBy(*by, "run").agg(*[c.alias(n) for n, (_, c) in columns.items()], F.min("run_start").alias("_from"), F.max("run_end").alias("_to"))
    border = border.withColumnsRenamed({"_from": "run_start", "_to": "run_end"})
    return parts.filter("NOT border").select(*names).unionByName(border.select(*names))
