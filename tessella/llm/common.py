"""Shared plumbing of the training-data operators: scratch tables, Arrow helpers, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the word separators that every word-based contract here uses.
SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares. Only a local session, as in tests, gets one of its own where it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """The tables of one run of one operator, in a folder of its own in the shared folder.

    Writing a table cuts lineage at files that outlive executors. Tables go when they are released or the run is closed; what
    a lazy result still reads goes with ``close`` of its ``scratch``, or when the driver's JVM ends. Runs share nothing.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}", []
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)

    def folder(self, name: str) -> str:
        path = f"{self.root}/{len(self.paths)}-{name}"
        self.paths.append(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table."""
        path, schema = self.folder(name), df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
        # lets the context cleaner remove shuffle files of finished jobs, whose results are in tables
        self.spark._jvm.System.gc()
        back = self.spark.read.schema(schema).parquet(path)
        back.scratch_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for x in tables:
            self.drop(x.scratch_path)  # type: ignore[attr-defined]

    def close(self, *kept: DataFrame) -> None:
        """Removes all tables but these."""
        paths = {x.scratch_path for x in kept}  # type: ignore[attr-defined]
        for path in self.paths if paths else [self.root]:
            if path not in paths:
                self.drop(path)

    def result(self, df: DataFrame) -> DataFrame:
        """df, which knows that its tables lie here."""
        df.scratch = self  # type: ignore[attr-defined]
        return df


def finished(df: DataFrame) -> None:
    """Removes the tables behind the result of an operator that has been written elsewhere."""
    if (work := getattr(df, "scratch", None)) is not None:
        work.close()


def rows(docs: DataFrame) -> DataFrame:
    """(row, k, tag): each row whole, so that no column of docs, whatever its name, meets those of an operator; k and tag
    name it by its doc_id and text, as ``seeds.keyed`` does."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())


def row_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("tag")]


def unpacked(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of found(row, ..), some of them changed."""
    field = lambda c: F.col("row").getField(c)
    return found.select(*[changed.get(c, field(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The raw UTF-8 of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial hashes of any slice of a sequence of 64-bit values, from prefix sums modulo 2^64."""

    def __init__(self, base: int):
        assert base % 2 == 1
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.inverse, np.uint64)], dtype=np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._powers(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], dtype=np.uint64, out=out[1:])
        return out

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all windows of that length."""
        n = len(sums) - length
        return (sums[length:] - sums[:n]) * self.down[:n]

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


class WordHashes:
    """64-bit hashes of the words of texts, all at once from the bytes; a word is a run of anything but ASCII white space."""

    def __init__(self):
        self.rolling = Rolling(0x369DEA0F31A53F85)
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47))
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True

    def of(self, text: bytes) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(np.diff(self.blank[raw], prepend=True, append=True))
        return mix(self.rolling.slices(self.rolling.prefix(self.value[raw]), edge[::2], edge[1::2]))


def first_column(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads; columns beside them, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])
