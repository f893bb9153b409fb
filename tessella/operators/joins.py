"""Joins with a check: broadcasts of checked size, complete cases, key-set equality, role pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes up to which a side is broadcast; beyond, the join is left to Spark's shuffled joins.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows, counted no further than that, of at most ``size`` bytes."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema), F.lit(16))
    n, found = df.select(width.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and found <= size else df


def single(df: DataFrame) -> DataFrame:
    """df, which must have one row, to be joined to all rows of another: any other number of rows raises. It is aggregated to
    one row, so that what is broadcast is one."""
    n = F.count(F.lit(1))
    return F.broadcast(df.agg(F.when(n == 1, F.first(F.struct(*df.columns))).otherwise(F.raise_error(F.concat(F.lit("one row is wanted, not "), n.cast("string")))).alias("_row")).select("_row.*"))


def complete_cases(scores: DataFrame, item: str, arm: str, score: str, arms: list) -> DataFrame:
    """Items with a score in every one of the arms: one row with a column per arm."""
    wide = scores.where(F.col(arm).isin(arms)).groupBy(item).pivot(arm, arms).agg(F.first(score, ignorenulls=True))
    return wide.where(reduce(Column.__and__, [F.col(f"`{a}`").isNotNull() for a in arms]))


def key_mismatches(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that are not exactly once on both sides, with their counts there; empty when the key sets are equal."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "n_left").join(count(b, "n_right"), key, "full_outer").na.fill(0, ["n_left", "n_right"])
    return both.where("n_left <> 1 OR n_right <> 1")


def by_role(df: DataFrame, keys: list[str], role: str, roles: list[str], value: str) -> DataFrame:
    """One row per key with a column per role, in place of a self-join for each role."""
    return df.groupBy(*keys).pivot(role, roles).agg(F.first(value, ignorenulls=True))


def differing_rows(a: DataFrame, b: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity, but for the columns that may differ."""
    columns = [c for c in a.columns if c not in ignore]
    one = a.select(*columns).exceptAll(b.select(*columns)).withColumn("side", F.lit("left"))
    return one.unionAll(b.select(*columns).exceptAll(a.select(*columns)).withColumn("side", F.lit("right")))


def annotated_differences(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of rows that differ, or lack on one side, but for one column; and by how much that column differs where both have it."""
    rest = [c for c in a.columns if c not in (*key, value)]
    left = a.select(*key, F.struct(*rest).alias("_l"), F.col(value).alias("_a"))
    right = b.select(*key, F.struct(*rest).alias("_r"), F.col(value).alias("_b"))
    return left.join(right, key, "full_outer").select(*key, (~F.col("_l").eqNullSafe(F.col("_r"))).alias("differs"), F.abs(F.col("_a") - F.col("_b")).alias("delta"))
