"""Digests, manifests and reproduction checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_digests(spark, paths: list[str]) -> DataFrame:
    """(path, length, sha256) of whole files, read by the executors."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def violations(manifest: DataFrame, found: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """Entries that are missing, unexpected, or differ from the manifest."""
    both = manifest.select(key, F.col(digest).alias("expected")).join(found.select(key, F.col(digest).alias("found")), key, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def irreproducible(rows: DataFrame, stored: str, recomputed) -> DataFrame:
    """Rows whose stored metric is not what its inputs give."""
    return rows.where(~F.col(stored).eqNullSafe(recomputed))
