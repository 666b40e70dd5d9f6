"""Array helpers that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column) -> Column:
    """Running sums of a short array, from ``start``; one longer than ``values``."""
    return F.aggregate(values, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array<long>.  Works by blocks, so that the
    copying within ``aggregate`` stays far below the square of the length."""

    def of(values: Column) -> Column:
        last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
        return let(blocks, summed)

    def summed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc + v))
        return let(_running(sums, F.lit(0).cast("long")), lambda starts: F.flatten(F.transform(blocks, lambda x, i: F.slice(_running(x, F.element_at(starts, i + 1)), F.lit(2), F.size(x)))))

    return let(values, of)


def located(text: Column, regex: str) -> Column:
    """All matches of ``regex``, leftmost and not overlapping, as an array of
    (start, end, found, before) in code points."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found"), F.split(text, regex, -1).alias("between"))

    def placed(parts: Column) -> Column:
        found, between = parts["found"], parts["between"]
        steps = F.transform(found, lambda m, i: (F.length(F.element_at(between, i + 1)) + F.when(i > 0, F.length(F.element_at(found, F.greatest(i, F.lit(1))))).otherwise(0)).cast("long"))
        return let(prefix_sums(steps), lambda starts: F.transform(found, lambda m, i: F.struct(F.element_at(starts, i + 1).alias("start"), (F.element_at(starts, i + 1) + F.length(m)).alias("end"), m.alias("found"), F.element_at(between, i + 1).alias("before"))))

    return let(parts, placed)
