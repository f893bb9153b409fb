"""Bootstraps whose draws do not depend on partitioning, retries or machines.

A resample of n rows with replacement gives each row a multiplicity, and the multiplicities are multinomial. They are drawn by
splitting: how many of the n draws fall in the left half of a range of places is binomial, given how many fall in the range.
The generator of each split is keyed by the seed and the range, so any task can follow the way from the whole down to its own
block of rows, for all replicates at once, and finds the numbers that every other task finds. Rows stay where they lie; only
(replicate, sum, n) of each task is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.packing import offsets

#: Rows of a block, the ranges that splitting ends at; and draws that a task holds at a time.
BLOCK, DRAWS_AT_ONCE = 4096, 1 << 21


def generator(seed: str, first: int, last: int) -> np.random.Generator:
    """The generator of the places from first to before last."""
    key = hashlib.sha256(f"{seed}:{first}:{last}".encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(key[:16], np.uint64)))


def draws_in_block(seed: str, n: int, reps: int, block: int, size: int) -> np.ndarray:
    """How many of each replicate's n draws fall in a block of ``size`` places: a binomial split for each halving on the way there."""
    low, high, draws = 0, -(-n // size), np.full(reps, n, np.int64)
    places = lambda a, b: min(b * size, n) - a * size
    while high - low > 1:
        mid = (low + high) // 2
        left = generator(seed, low * size, high * size).binomial(draws, places(low, mid) / places(low, high))
        low, high, draws = (low, mid, left) if block < mid else (mid, high, draws - left)
    return draws


def block_sums(values: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Each replicate's sum of as many draws of values as it has here."""
    out = np.zeros(len(draws))
    step = max(DRAWS_AT_ONCE // max(int(draws.max(initial=0)), 1), 1)
    for at in range(0, len(draws), step):
        some = draws[at : at + step]
        picked = values[rng.integers(0, len(values), int(some.sum()))]
        out[at : at + step] = np.bincount(np.repeat(np.arange(len(some)), some), weights=picked, minlength=len(some))
    return out


def bootstrap_means(values: DataFrame, order: str, value: str, seed: str, reps: int) -> DataFrame:
    """(rep, mean, n) of resamples of all rows, placed by a numeric column; rows that tie there are placed by their value.

    Rows without a value are left out before they are placed. An empty table has no resamples.
    """
    found = values.select(F.col(order).alias("_order"), F.col(value).cast("double").alias("_value"), F.lit(1).alias("_one")).where("_value IS NOT NULL")
    n, size = found.count(), BLOCK
    placed = offsets(found, "_order", "_one", ties=("_value",)).select((F.col("start") / size).cast("long").alias("block"), "start", "_value")

    def resampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(reps), np.zeros(reps, np.int64)
        at, held = None, []

        def close():
            if at is not None:
                draws = draws_in_block(seed, n, reps, at, size)
                counts[:] += draws
                sums[:] += block_sums(np.concatenate(held), draws, generator(seed, at * size, min((at + 1) * size, n)))

        for batch in batches:
            blocks, x = batch.column("block").to_numpy(), batch.column("_value").to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
            for start, end in zip(edges[:-1], edges[1:]):
                if end > start:
                    if blocks[start] != at:
                        close()
                        at, held = int(blocks[start]), []
                    held.append(x[start:end])
        close()
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(sums), pa.array(counts)], names=["rep", "sum", "n"])

    parts = placed.repartition("block").sortWithinPartitions("block", "start").mapInArrow(resampled, "rep long, sum double, n long")
    return parts.groupBy("rep").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).select("rep", (F.col("sum") / F.col("n")).alias("mean"), "n")


def _sorted(means: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("m"))  # one number per replicate


def rank_interval(means: DataFrame, low: int, high: int) -> DataFrame:
    """Elements at two places, from 0, of the sorted means: the rule that call sites fix as an index."""
    return _sorted(means).select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.lit(high)).alias("high"))


def interval_rules(means: DataFrame, coverage: float = 0.95) -> DataFrame:
    """(rule, low, high) by three rules: the places coverage leaves out on both sides counted from all replicates (249 and 9749
    of 10,000), the whole part of q * (replicates - 1), and linear interpolation there."""
    tail = (1 - coverage) / 2
    b, at = F.size("m"), lambda i: F.get("m", i.cast("int"))
    whole = lambda x: F.floor(x + F.lit(1e-9))  # noqa: E731  (0.025 * 10,000 is 250 for all binary fractions)
    place = lambda q: F.lit(q) * (b - 1)
    between = lambda q: at(F.floor(place(q))) + (at(F.ceil(place(q))) - at(F.floor(place(q)))) * (place(q) - F.floor(place(q)))
    row = lambda name, low, high: F.struct(F.lit(name).alias("rule"), low.alias("low"), high.alias("high"))
    counted = row("counted", at(whole(tail * b) - 1), at(whole((1 - tail) * b) - 1))
    rules = F.array(counted, row("index", at(whole(place(tail))), at(whole(place(1 - tail)))), row("interpolated", between(tail), between(1 - tail)))
    return _sorted(means).select(F.inline(rules))


def draw(seed: str, rep: Column, i: Column, n: Column) -> Column:
    """An index below n: 32 bits of SHA-256(seed:rep:i)."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), rep.cast("string"), i.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def two_way_means(cells: DataFrame, a: str, b: str, value: str, seed: str, reps: int) -> DataFrame:
    """(rep, mean) of a table of cells with both its sides resampled, independently of one another.

    Sides are what the cells name, in the order of numeric keys, each as many as there are; draws are hashes, dealt over tasks
    by replicate. A missing cell counts on neither side of the mean.
    """
    spark = cells.sparkSession

    def side(name: str, tag: str) -> DataFrame:
        keys = cells.select(F.col(name).alias("_key"), F.lit(1).alias("_one")).distinct()
        n = keys.count()
        placed = offsets(keys, "_key", "_one").select(F.col("start").alias("_place"), F.col("_key").alias(name))
        rows = spark.range(reps).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("i"))
        drawn = rows.groupBy("rep", draw(f"{seed}{tag}", F.col("rep"), F.col("i"), F.lit(max(n, 1))).alias("_place")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return drawn.join(placed, "_place").drop("_place")

    drawn = side(a, "a").join(cells, a).join(side(b, "b"), ["rep", b])
    weight = F.col(f"n_{a}") * F.col(f"n_{b}")
    return drawn.groupBy("rep").agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias("mean"))
