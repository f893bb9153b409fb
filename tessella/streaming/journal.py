"""Journals as streams: lines by byte offsets, each id once; and, as an extension, event-time windows with a bound on lateness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tessella.sources.ranges import Ranges, listed


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class JournalSource(DataSource):
    """format("journal"), as a stream: (path, offset, line) of files of option ``path`` that grow by whole lines.

    An offset is, for each file, the byte after its last line break; what follows is a line that is still being written, and
    comes when it is complete. A batch is cut into ranges of about ``rangeBytes``; a line belongs to the range that it begins in.
    """

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return "path string, offset bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Journal(self.options)


class _Journal(DataSourceStreamReader):
    #: Bytes that are looked through together for a line break.
    LOOK = 1 << 16

    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path in listed(self.path):
            file, known = Ranges(path), self.seen.get(path, 0)
            size = file.size()
            at = size
            while at > known:
                start = max(at - self.LOOK, known)
                found = file.read(start, at - start).rfind(b"\n")
                if found >= 0:
                    self.seen[path] = start + found + 1
                    break
                at = start
            file.close()
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen.update({p: max(n, self.seen.get(p, 0)) for p, n in end.items()})
        out = []
        for path, stop in sorted(end.items()):
            out += [_Range(path, a, min(a + self.step, stop)) for a in range(start.get(path, 0), stop, self.step)]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.stop <= part.start:
            return
        file = Ranges(part.path)
        size = file.size()
        # the line that the byte before lies in belongs to the range before
        at, held = (part.start - 1, b"") if part.start else (0, b"")
        skip = bool(part.start)
        begin = at
        while begin < part.stop:
            cut = held.find(b"\n")
            if cut < 0:
                if at >= size:
                    break
                piece = file.read(at, min(self.LOOK, size - at))
                at += len(piece)
                held += piece
                continue
            if skip:
                skip = False
            else:
                yield part.path, begin, held[:cut].decode(errors="replace")
            begin += cut + 1
            held = held[cut + 1 :]
        file.close()

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JournalSource)


def follow(spark: SparkSession, folder: str, range_bytes: int = 64 << 20) -> DataFrame:
    """A stream of the complete lines of journals in a folder; ``register`` first."""
    return spark.readStream.format("journal").option("path", folder).option("rangeBytes", range_bytes).load()


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines; one that is none raises, as only a journal's last line may be torn."""
    found = lines.select("path", "offset", F.from_json("line", f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    bad = F.raise_error(F.concat(F.lit("corrupt line of "), "path", F.lit(" at "), F.col("offset").cast("string")))
    return found.withColumn("_r", F.when(F.col("_r._corrupt").isNotNull(), bad).otherwise(F.col("_r"))).select("_r.*").drop("_corrupt")


def append_once(rows: DataFrame, key: str, out: str, checkpoint: str, before_commit: Callable[[int], None] | None = None):
    """Appends the first row of each key to a table of Parquet files; ends when all that is there is read.

    Keys seen are the stream's state, so the table is never read again. A batch goes to the folder ``batch=n`` and replaces what
    is there, so that one that is run again, after a crash at any moment, leaves the same rows once.
    """
    fresh = rows.dropDuplicates([key])

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if before_commit is not None:
            before_commit(n)

    query = fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(stream: DataFrame, time: str, kind: str, value: str, late: str, width: str) -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` behind the newest are left out."""
    w = F.window(time, width)
    sums = stream.withWatermark(time, late).groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), kind, "n", "total")
