"""Mergeable states of paired measures: partial over chunks, merged over chunks, tables and runs, finished at the end.

A state is a row: counts, sums, extremes, means and co-moments about them. States merge by Chan's rule, to one state per group
however they are split, without the cancellation that sums of squares suffer; they can be stored and merged with later ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["n", "n_missing", "n_same_bits", "n_equal"]
SUMS = ["sum_x", "sum_y", "sum_xx", "sum_dd", "sum_abs"]


def partial(rows: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """A state for each group of rows. Pairs with a missing side are counted and take no other part."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    # equal bits: unlike =, this tells 0.0 from -0.0, and NaN is itself
    pairs = rows.select(*by, a.alias("_x"), b.alias("_y"), F.coalesce(a.cast("string") == b.cast("string"), F.lit(False)).alias("_same"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    x_, y_ = F.when(both, F.col("_x")), F.when(both, F.col("_y"))
    d = x_ - y_
    n = F.count_if(both)
    return pairs.groupBy(*by).agg(
        n.alias("n"), F.count_if(~both).alias("n_missing"), F.count_if(F.col("_same")).alias("n_same_bits"), F.count_if(x_ == y_).alias("n_equal"),
        F.sum(x_).alias("sum_x"), F.sum(y_).alias("sum_y"), F.sum(x_ * x_).alias("sum_xx"), F.sum(d * d).alias("sum_dd"), F.sum(F.abs(d)).alias("sum_abs"),
        F.min(d).alias("least"), F.max(d).alias("most"), F.max(F.abs(d)).alias("max_abs"),
        F.avg(x_).alias("mean_x"), F.avg(y_).alias("mean_y"), (F.var_pop(x_) * n).alias("m_xx"), (F.var_pop(y_) * n).alias("m_yy"), (F.covar_pop(x_, y_) * n).alias("m_xy"),
    )


def merged(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One state for each group of states, in two passes: the means of all, then co-moments about these."""
    n = F.sum("n")
    total = states.groupBy(*by).agg(*[F.try_divide(F.sum(F.col("n") * F.col(m)), n).alias(f"_{m}") for m in ("mean_x", "mean_y")])
    if by:
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
        both = states.join(total.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_mean_x", "_mean_y"), same)
    else:
        both = states.crossJoin(F.broadcast(total))  # an aggregate without keys: one row
    dx, dy = F.col("mean_x") - F.col("_mean_x"), F.col("mean_y") - F.col("_mean_y")
    moment = lambda m, p: F.sum(F.col(m) + F.col("n") * p).alias(m)
    return both.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in COUNTS + SUMS], F.min("least").alias("least"), F.max("most").alias("most"), F.max("max_abs").alias("max_abs"),
        F.max("_mean_x").alias("mean_x"), F.max("_mean_y").alias("mean_y"), moment("m_xx", dx * dx), moment("m_yy", dy * dy), moment("m_xy", dx * dy),
    )


def profile() -> dict[str, Column]:
    """What a state tells: shares, differences, relative norm and correlation; null where there is nothing to divide by."""
    c = F.col
    return {
        "changed": 1 - F.try_divide(c("n_equal"), c("n")),
        "mean_difference": F.try_divide(c("sum_x") - c("sum_y"), c("n")),
        "mean_abs": F.try_divide(c("sum_abs"), c("n")),
        "relative_l2": F.sqrt(F.try_divide(c("sum_dd"), c("sum_xx"))),
        "correlation": F.try_divide(c("m_xy"), F.sqrt(c("m_xx") * c("m_yy"))),
        "sd_x": F.sqrt(F.try_divide(c("m_xx"), c("n") - 1)),
    }
