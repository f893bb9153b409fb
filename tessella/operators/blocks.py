"""Matrices as tables of blocks, multiplied by joins on block numbers; no task holds more than three blocks.

A matrix is rows (i, j, b): the block of rows i and columns j, row by row, with zeros where the matrix ends within a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _square(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size, size)


def blocked(rows: DataFrame, number: str, vector: str, size: int) -> DataFrame:
    """(i, j, b) of a matrix given by its rows, numbered from 0; a block is put together from ``size`` pieces at most."""
    pieces = F.expr(f"transform(sequence(0, (greatest(size({vector}), 1) - 1) div {size}), j -> struct(j, slice({vector}, j * {size} + 1, {size}) AS p))")
    each = rows.select((F.col(number) / size).cast("long").alias("i"), F.pmod(F.col(number), F.lit(size)).cast("int").alias("r"), F.inline_outer(pieces))
    grouped = each.where("j IS NOT NULL").groupBy("i", F.col("j").cast("long").alias("j")).agg(F.collect_list(F.struct("r", "p")).alias("ps"))

    def fill(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = np.zeros((part.num_rows, size, size))
            for k, rows_of in enumerate(part.column(2).to_pylist()):
                for x in rows_of:
                    out[k, x["r"], : len(x["p"])] = x["p"]
            blocks = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * size * size, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), blocks], names=["i", "j", "b"])

    return grouped.mapInArrow(fill, "i long, j long, b array<double>")


def _each(joined: DataFrame, f, size: int, keys: list[str]) -> DataFrame:
    """(keys.., value) with f of the blocks of each row, which come after the keys."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                found = f(*(_square(part.column(k), size) for k in range(len(keys), part.num_columns)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(found.tolist())], names=[*keys, "value"])

    kind = "double" if f in (_weighted, _energy) else "array<double>"
    return joined.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), f"value {kind}"]))


def _weighted(d, h, e):
    return np.einsum("nik,nkj,nij->n", d, h, e, optimize=True)


def _energy(a, b):
    return (a * b).sum((1, 2))


def gram(matrix: DataFrame, size: int) -> DataFrame:
    """(i, j, b) of the product of a matrix's transpose with the matrix: products of blocks that share their rows, added up cell
    by cell, partially before they are shuffled."""
    left, right = matrix.select("i", F.col("j").alias("k"), F.col("b").alias("bl")), matrix.select("i", F.col("j").alias("l"), F.col("b").alias("br"))
    products = _each(left.join(right, "i").select("k", "l", "bl", "br"), lambda a, b: np.einsum("nij,nik->njk", a, b).reshape(len(a), -1), size, ["k", "l"])
    cells = products.select("k", "l", F.posexplode("value").alias("at", "x")).groupBy("k", "l", "at").agg(F.sum("x").alias("x"))
    return cells.groupBy(F.col("k").alias("i"), F.col("l").alias("j")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("b"))


def weighted_square(matrix: DataFrame, weight: DataFrame, size: int) -> DataFrame:
    """One row, value: the sum of (M H) * M for a matrix M and a weight H, from triples of blocks that meet: block k of a row with
    block (k, j) of the weight with block j of the same row. Nothing but numbers is gathered."""
    first = matrix.select("i", F.col("j").alias("k"), F.col("b").alias("d"))
    met = first.join(weight.select(F.col("i").alias("k"), "j", F.col("b").alias("h")), "k").join(matrix.select("i", "j", F.col("b").alias("e")), ["i", "j"])
    return _each(met.select("i", "d", "h", "e"), _weighted, size, ["i"]).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
