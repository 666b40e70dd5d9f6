"""Score curves, weighted means over present parts, confidence and factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def switch_load(rate: Column) -> Column:
    return F.when(rate > 0, (1 - F.exp(-rate / 1.5)) * 100).when(rate.isNotNull(), 0.0)


def switch_stability(rate: Column) -> Column:
    return F.lit(100.0) - switch_load(rate)


def fall(x: Column, best: float, worst: float) -> Column:
    """100 at ``best`` or below, 0 at ``worst`` or above, linear between."""
    return clamp((F.lit(worst) - x) / (worst - best) * 100)


def add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


class Parts:
    """Named, weighted scores of which some may be null: weights are shared
    again over those that are present."""

    def __init__(self, *parts: tuple[str, float | Column, Column]):
        self.parts = [(name, w if isinstance(w, Column) else F.lit(float(w)), score) for name, w, score in parts]
        self.weight = add([F.when(s.isNotNull(), w).otherwise(0.0) for _, w, s in self.parts])

    def value(self) -> Column:
        total = add([F.when(s.isNotNull(), w * s).otherwise(0.0) for _, w, s in self.parts])
        return F.when(self.weight > 0, total / self.weight)

    def present(self) -> Column:
        return add([F.when(s.isNotNull(), 1).otherwise(0) for _, _, s in self.parts])

    def factors(self) -> Column:
        return shares(*[(name, F.when(s.isNotNull(), w)) for name, w, s in self.parts])


def shares(*parts: tuple[str, Column]) -> Column:
    """Factors (id, share) of the parts over 0, by their amounts."""
    total = add([F.coalesce(x, F.lit(0.0)) for _, x in parts])
    return F.filter(F.array(*[F.struct(F.lit(name).alias("id"), F.when(total > 0, x / total).alias("share")) for name, x in parts]), lambda f: f["share"] > 0)


def confidence(expected: int, present: Column, sums: Column, counts: Column) -> Column:
    """Coverage of the slots times the mean confidence of the evidence."""
    mean = F.when(counts > 0, sums / counts).otherwise(0.0)
    return clamp(F.least(present, F.lit(expected)) / expected * mean, 0.0, 1.0)
