"""Ternary groups in JVM expressions: quantising, packing to 2-bit codes, reading them back."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values by 2-bit code; the last code is invalid (fixed by the format).
VALUES = [-1, 0, 1, None]


def absmean(values: Column | str) -> tuple[Column, Column]:
    """(scale, codes): scale is the mean magnitude; codes are x / scale, rounded half to even, clipped to -1..1."""
    scale = F.aggregate(F.transform(values, lambda x: F.abs(x)), F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return scale, F.transform(values, lambda x: F.when(scale == 0, 0).otherwise(F.least(F.greatest(F.rint(x / scale), F.lit(-1.0)), F.lit(1.0))).cast("int"))


def packed(codes: Column | str) -> Column:
    """Hex of 2 bits for each of -1, 0, 1, four to a byte, the first in the lowest bits. The number must divide by four."""
    byte = lambda i: F.aggregate(F.slice(codes, i * 4 + 1, 4), F.struct(F.lit(0).alias("b"), F.lit(1).alias("m")), lambda s, x: F.struct((s["b"] + (x + 1) * s["m"]).alias("b"), (s["m"] * 4).alias("m")), lambda s: s["b"])
    n = F.floor(F.size(codes) / 4).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.lower(F.hex(byte(i).cast("long"))), 2, "0")), "")


def unpacked(text: Column | str, strict: bool = False) -> Column:
    """The codes' values of packed hex; null for invalid ones, or with ``strict`` an error."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    byte = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    values = F.array(*[F.lit(v).cast("int") for v in VALUES])
    value = lambda code: F.get(values, code)
    if strict:
        value = lambda code: F.coalesce(F.get(values, code), F.raise_error(F.concat(F.lit("invalid code in "), text)).cast("int"))
    return F.flatten(F.transform(byte, lambda b: F.transform(F.array(*[F.lit(k) for k in (1, 4, 16, 64)]), lambda m: value(F.floor(b / m).cast("int") % 4))))


def one_bit(data: Column) -> Column:
    """Signs of bytes, one bit each, the lowest first: 1 is +1, 0 is -1."""

    @F.pandas_udf("array<int>")
    def signs(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else 2 * np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(np.int32) - 1)

    return signs(data)


def leaves(value: Column | str) -> Column:
    """Leaves of JSON values as a map from path to text; levels are joined by dots, places in lists are numbers."""

    @F.pandas_udf("map<string,string>")
    def walk(s: pd.Series) -> pd.Series:
        def of(text):
            if text is None:
                return None
            out, held = {}, [("", json.loads(text))]
            while held:
                path, x = held.pop()
                inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else None
                if inner is None:
                    out[path] = x if isinstance(x, str) else json.dumps(x)
                else:
                    held += [(f"{path}.{k}" if path else str(k), y) for k, y in inner]
            return out

        return s.map(of)

    return walk(value)
