"""Column functions on arrays of numbers: bands, differences, option scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def band_mean(values: Column | str, low: int, high: int) -> Column:
    """Mean of positions low <= i < high, counted from 0; null where the vector is shorter."""
    part = F.slice(values, low + 1, high - low)
    return F.when(F.size(values) >= high, total(part) / (high - low))


def difference(a: Column | str, b: Column | str) -> Column:
    """Element-wise a - b; raises where lengths differ, as neither cutting nor padding is meant."""
    checked = F.when(F.size(a) == F.size(b), a if isinstance(a, Column) else F.col(a)).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return F.zip_with(checked, b, lambda x, y: x - y)


def max_abs(values: Column | str) -> Column:
    return F.array_max(F.transform(values, lambda x: F.abs(x)))


def first_argmax(values: Column | str) -> Column:
    """Position, from 0, of the greatest value; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_sum_exp(values: Column | str) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))


def others(values: Column | str, gold: Column) -> Column:
    return F.filter(values, lambda x, i: i != gold)


def strict_hit(values: Column | str, gold: Column) -> Column:
    """Whether the gold option scores above all others; a tie is a miss."""
    return F.get(values, gold) > F.array_max(others(values, gold))


def pairwise(values: Column | str, gold: Column) -> Column:
    """Mean over the other options of 1 where gold scores above, 0.5 where equal, 0 where below."""
    mine, rest = F.get(values, gold), others(values, gold)
    return F.aggregate(F.transform(rest, lambda x: F.when(mine > x, 1.0).when(mine == x, 0.5).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(rest)
