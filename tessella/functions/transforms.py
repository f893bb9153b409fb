"""Walsh-Hadamard transforms of arrays, in Arrow batches, for any power of two."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def hadamard(values: np.ndarray) -> np.ndarray:
    """Orthonormal transform of the last axis, whose length is a power of two."""
    out, n, h = np.array(values, float), values.shape[-1], 1
    if n & (n - 1):
        raise ValueError("the length is no power of two")
    while h < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * h), 2, h)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(out.shape)
        h *= 2
    return out / np.sqrt(n)


@F.pandas_udf(ArrayType(DoubleType()))
def hadamard_array(values: pd.Series) -> pd.Series:
    """The transform of each array of the column, those of one length in a batch together; null stays null."""
    out = np.full(len(values), None, object)
    lengths = np.array([-1 if v is None else len(v) for v in values], int)
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        for i, row in zip(at, hadamard(np.stack([np.asarray(values.iloc[i], float) for i in at]))):
            out[i] = row
    return pd.Series(out)
