"""Intervals and summary statistics as aggregate or plain columns; Student's quantile for any degrees of freedom."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of k of n, as shares; null for n = 0."""
    p = F.try_divide(k, n)
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, (centre - spread) / scale), F.when(n > 0, (centre + spread) / scale)


def mean_interval(value: Column, critical: float | Column = Z95) -> tuple[Column, Column, Column]:
    """Aggregates: mean and bounds, mean -+ critical * sd / sqrt(n) with n - 1 in the variance."""
    half = critical * F.stddev_samp(value) / F.sqrt(F.count(value))
    return F.avg(value), F.avg(value) - half, F.avg(value) + half


def half_ratio(x: Column) -> Column:
    """Gamma(x + 1/2) / Gamma(x) for x > 0: Stirling's series beyond SHIFT, and what lies between as a product."""
    y = x + F.lit(float(SHIFT))
    series = 0.5 * F.log(y) - 1 / (8 * y) + 1 / (192 * y**3) - 1 / (640 * y**5) + 17 / (14336 * y**7)
    below = reduce(lambda a, k: a * ((x + k) / (x + (k + 0.5))), range(SHIFT), F.lit(1.0))
    return F.exp(series) * below


#: Up to where the ratio of gamma functions is a product, nodes of the quadrature, and steps to the root.
SHIFT, NODES, STEPS = 16, 32, 64


def t_quantile(df: Column, coverage: Column | float = 0.95) -> Column:
    """Two-sided critical value of Student's t for any degrees of freedom above 0 and any coverage between 0 and 1.

    With t = sqrt(df) tan(u), the coverage of -t..t is a constant times the integral of cos(u)^(df - 1) from 0 to u. The
    integrand is smooth at the scale of u for all df, so Gauss-Legendre nodes on 0..u give it to double precision. It falls
    with u, so that Newton's steps from 0 on never pass the root; their number is fixed. Null outside the domain.
    """
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    at = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(nodes, weights)])
    df = df.cast("double")
    held = F.struct(df.alias("df"), (F.lit(coverage) if isinstance(coverage, float) else coverage).cast("double").alias("p"), (2 * half_ratio(df / 2) / math.sqrt(math.pi)).alias("c"), F.lit(0.0).alias("u"))

    def density(s: Column, u: Column) -> Column:
        return F.exp((s["df"] - 1) / 2 * F.log1p(-(F.sin(u) ** 2)))

    def step(s: Column, _: Column) -> Column:
        area = F.aggregate(at, F.lit(0.0), lambda total, n: total + n["w"] * density(s, n["x"] * s["u"])) * s["u"] * s["c"]
        after = F.least(s["u"] + F.greatest(s["p"] - area, F.lit(0.0)) / (s["c"] * density(s, s["u"])), F.lit(math.pi / 2 * (1 - 1e-12)))
        return F.struct(s["df"].alias("df"), s["p"].alias("p"), s["c"].alias("c"), after.alias("u"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), held, step, lambda s: F.sqrt(s["df"]) * F.tan(s["u"]))
    return F.when((df > 0) & (held["p"] > 0) & (held["p"] < 1), found)
