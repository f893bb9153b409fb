"""Files in and out: JSON lines with a fallback, CSV, cases with their digest, packed ids, Arrow streams, headers, inventories."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share; it goes with the driver's JVM."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(shared)
    path = f"{shared.rstrip('/')}/tessella/{uuid.uuid4().hex}"
    system, p = _path(spark, path)
    system.mkdirs(p)
    system.deleteOnExit(p)
    return path


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    system, p = _path(spark, path)
    return system.exists(p)


#: Names the version that is current of what ``replace`` has written.
CURRENT = "_current"


def current(spark: SparkSession, path: str) -> str:
    """The folder that is read for a path: its current version, or the path itself where it has no versions."""
    system, pointer = _path(spark, f"{path}/{CURRENT}")
    if not system.exists(pointer):
        return path
    file = system.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()
    return f"{path}/{name}"


def jsonl(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """JSON lines of the first of the paths that exists."""
    for path in paths:
        if exists(spark, path):
            return spark.read.schema(schema).json(current(spark, path))
    raise FileNotFoundError(", ".join(paths))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, which must name the schema's columns in their order."""
    return spark.read.option("enforceSchema", False).csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_cases(df: DataFrame, path: str) -> str:
    """Tab-separated (id, kind, ids, arg) in the order of ids; returns the SHA-256 of the parts' digests in their order."""
    lines = df.select(F.concat_ws("\t", "id", "kind", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), F.coalesce("arg", F.lit(""))).alias("value"), "id")
    lines.repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)
    parts = df.sparkSession.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d")).orderBy("path")
    return hashlib.sha256("".join(x.d for x in parts.collect()).encode()).hexdigest()


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines where nothing was; an existing path is refused."""
    df.write.mode("errorifexists").json(path)


def replace(df: DataFrame, path: str) -> None:
    """JSON lines in place of what was there, in one step: a whole new version is written, then the small file that names the
    current one is replaced by a rename that overwrites. Readers by ``jsonl`` find the old version or the new one, at any moment,
    and so does a run after a crash; the version before stays for those that read it, older ones go."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    before = current(spark, path).removeprefix(f"{path}/")
    df.write.json(f"{path}/{version}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    (system, beside), (_, pointer) = _path(spark, f"{path}/_{version}"), _path(spark, f"{path}/{CURRENT}")
    file = system.create(beside, True)
    file.write(bytearray(version.encode()))
    file.close()
    option = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = spark._jvm.java.lang.Enum.valueOf(option, "OVERWRITE")
    hadoop.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, pointer, overwrite)
    for x in system.listStatus(pointer.getParent()):
        if x.getPath().getName() not in (version, before, CURRENT):
            system.delete(x.getPath(), True)


def pack_ids(ids: Column | str) -> Column:
    """An array of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<u4").tobytes())

    return pack(ids)


def unpack_ids(data: Column | str) -> Column:
    @F.pandas_udf("array<long>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, "<u4").astype(np.int64))

    return unpack(data)


def wrapped(sequences: DataFrame, number: str, total: int, start: int, count: int) -> DataFrame:
    """``count`` sequences from ``start`` on of ``total``, beginning again after the last; at counts their place in the batch."""
    places = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.pmod(k + start, F.lit(total)) == F.col(number))
    return sequences.withColumn("at", F.explode(places))


def arrow_streams(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of Arrow IPC streams, one file each, with the file's name as ``subject``; a file is read by one task."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.arrow$", 1).alias("subject"), "content")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for subject, content in zip(*(c.to_pylist() for c in part.columns)):
                for batch in pa.ipc.open_stream(io.BytesIO(content)):
                    yield pa.RecordBatch.from_arrays([pa.array([subject] * batch.num_rows), *batch.columns], names=["subject", *batch.schema.names])

    return files.mapInArrow(rows, f"subject string, {schema}")


def write_ids(sequences: DataFrame, number: str, ids: str, path: str, each: int) -> DataFrame:
    """Sequences of ids, numbered from 0, as files of unsigned 32-bit integers with ``each`` sequences a file; a row (file, first,
    n, sha256) for each. A task writes its files under names of its own and renames each when it is whole, so that a task that
    is run again replaces what is there by the same bytes. Runs as it is called."""
    numbered = sequences.select((F.col(number) / each).cast("long").alias("file"), F.col(number).cast("long").alias("number"), F.col(ids).cast("array<bigint>").alias("ids"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        at, out, digest, first, n, beside = None, None, None, 0, 0, ""

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                name = f"{at:012d}.u32"
                store.move(beside, f"{base}/{name}")
                yield pa.RecordBatch.from_pylist([{"file": name, "first": first, "n": n, "sha256": digest.hexdigest()}])

        for part in parts:
            numbers, names = part.column(1).to_numpy(), part.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(names)) + 1, len(names)] if len(names) else []
            for a, b in zip(edges, edges[1:]):
                if names[a] != at:
                    yield from close()
                    at, first, n, digest, beside = names[a], int(numbers[a]), 0, hashlib.sha256(), f"{base}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(beside)
                due = first + n + np.arange(b - a)
                if (numbers[a:b] != due).any():
                    raise ValueError(f"sequence {due[numbers[a:b] != due][0]} is missing")
                data = part.column(2).slice(a, b - a).flatten().to_numpy().astype("<u4").tobytes()
                out.write(data)
                digest.update(data)
                n += int(b - a)
        yield from close()

    done = numbered.repartition("file").sortWithinPartitions("file", "number").mapInArrow(run, "file string, first long, n long, sha256 string")
    report = f"{path}.report"
    done.write.parquet(report)
    return sequences.sparkSession.read.schema(done.schema).parquet(report)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids, words) of all files below a folder: numbers and words that text and JSON files of any depth mention."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [mentions(p, c.decode(errors="replace")) for p, c in zip(part.path, part.content)]
            yield pd.DataFrame({"path": part.path, "ids": [x[0] for x in found], "words": [x[1] for x in found]})

    return files.mapInPandas(rows, "path string, ids array<long>, words string")


def mentions(path: str, text: str) -> tuple[list[int], str]:
    """Whole numbers of a text, or of a JSON file's keys and values; and its lower-case words between blanks."""
    held = [json.loads(text)] if path.endswith(".json") else [text]
    ids: set[int] = set()
    words: list[str] = []
    while held:
        x = held.pop()
        if isinstance(x, dict):
            held += [*x.values(), *x.keys()]
        elif isinstance(x, list):
            held += x
        elif isinstance(x, bool | float) or x is None:
            continue
        elif isinstance(x, int):
            ids.add(x)
        else:
            ids.update(int(n) for n in re.findall(r"(?<![\w.])\d{1,18}(?![\w.])", str(x)))
            words.append(" ".join(re.findall("[a-z0-9]+", str(x).lower())))
    return sorted(ids), " " + " ".join(sorted(words)) + " "


def logit_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, row, values) of binary files with a header of two 32-bit integers, rows and width, then 32-bit floats by row."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part.file, part.content):
                n, w = struct.unpack("<ii", content[:8])
                if w != width or len(content) != 8 + 4 * n * w:
                    raise ValueError(f"{file}: {n} rows of {w} in {len(content)} bytes")
                values = np.frombuffer(content, "<f4", offset=8).reshape(n, w)
                yield pd.DataFrame({"file": file, "row": np.arange(n), "values": list(values)})

    return files.mapInPandas(rows, "file string, row long, values array<float>")


def markdown(rows: DataFrame, columns: dict[str, Column], order: str) -> DataFrame:
    """(place, line): the lines of a Markdown table, two of them its head, a line for each row in order. Rows are numbered by
    ranges of a sorted table, so none of it passes through the driver."""
    from tessella.operators.packing import offsets

    cells = [F.coalesce(c.cast("string"), F.lit("")) for c in columns.values()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    digest = F.conv(F.hex(F.substring(F.rpad(F.col(order).cast("string").cast("binary"), F.lit(7), F.lit(b"\0")), 1, 7)), 16, 10).cast("long")
    body = offsets(rows.select(digest.alias("_key"), F.col(order).alias("_by"), line.alias("line"), F.lit(1).alias("_one")), "_key", "_one", ties=("_by",))
    head = ["| " + " | ".join(columns) + " |", "| " + " | ".join(["---"] * len(columns)) + " |"]
    return rows.sparkSession.createDataFrame(list(enumerate(head)), "place long, line string").unionAll(body.select((F.col("start") + 2).alias("place"), "line"))


def interval_cell(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.2f [%.2f, %.2f]", mean, low, high)
