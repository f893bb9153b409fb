"""Exact quantiles of strata of any size: no task holds the values of a stratum."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.packing import offsets


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = (), name: str = "q") -> DataFrame:
    """A row per stratum with values: the linear-interpolated quantiles as an array, in the order of ``shares``.

    Equal values are counted together, each gets its place among those of its stratum by running sums over ranges, and only
    those at the wanted places are gathered. Nulls are not counted; a missing stratum key is a stratum of its own.
    """
    found = df.select(*by, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL")
    counts = found.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
    placed = offsets(counts, "_value", "_n", by)
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total")).select("_total", *[F.col(c).alias(f"_of_{c}") for c in by])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])
        placed = placed.join(totals, same)
    else:
        placed = placed.withColumn("_total", F.lit(found.count()))
    at = [F.lit(p) * (F.col("_total") - 1) for p in shares]
    here = lambda place: (F.col("start") <= place) & (place < F.col("start") + F.col("_n"))
    ends = [(here(F.floor(h)), here(F.ceil(h))) for h in at]
    some = placed.where(reduce(lambda a, b: a | b, [x for pair in ends for x in pair]))
    held = [F.max(F.when(x, F.col("_value"))).alias(f"_{side}{i}") for i, pair in enumerate(ends) for side, x in zip(("low", "high"), pair)]
    rows = some.groupBy(*by, "_total").agg(*held)
    between = [F.col(f"_low{i}") + F.coalesce((F.col(f"_high{i}") - F.col(f"_low{i}")) * (h - F.floor(h)), F.lit(0.0)) for i, h in enumerate(at)]
    return rows.select(*by, F.array(*between).alias(name))
