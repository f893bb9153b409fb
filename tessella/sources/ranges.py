"""Files read by byte ranges: checked, bounded in size, tried again with back-off; and the data sources that read so.

A partition is a planned range, or the header, of one file; a file's payload is never loaded for its header, so its size does
not matter. ``register`` makes the sources known to a session.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessella.sources import tensors


def located(path: str):
    """(store, path there, what comes before it) of a path with or without a scheme; names may hold any character."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    if not mark:
        scheme, rest = "file", path.removeprefix("file:")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return store, base, f"{scheme}://{rest}".removesuffix(base)


def opened(path: str):
    """A file of any store that pyarrow knows, with ``size()`` and ``read_at(length, start)``."""
    store, base, _ = located(path)
    return store.open_input_file(base)


def sized(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Files of a folder, or those that commas separate, by name, each with its bytes; none is opened."""
    from pyarrow import fs

    out = []
    for one in path.split(","):
        store, base, before = located(one)
        info = store.get_file_info(base)
        found = store.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else [info]
        out += sorted((f"{before}{x.path}", x.size) for x in found if x.type != fs.FileType.Directory and x.base_name.endswith(suffix) and x.base_name[0] not in "._")
    return out


def listed(path: str, suffix: str = "") -> list[str]:
    return [name for name, _ in sized(path, suffix)]


class Ranges:
    """Ranges of one file. A range must be 1 to ``most`` bytes and come back whole; errors of the store are tried again, up to
    ``tries`` times in all, on a file opened anew, after waits that double."""

    def __init__(self, path: str, opener: Callable = opened, tries: int = 4, wait: float = 1.0, most: int = 16 << 20):
        self.path, self.opener, self.tries, self.wait, self.most = path, opener, tries, wait, most
        self.file, self.requests, self.bytes = None, 0, 0

    def _try(self, act: Callable) -> Any:
        for attempt in range(self.tries):
            try:
                if self.file is None:
                    self.file = self.opener(self.path)
                return act(self.file)
            except (OSError, TimeoutError):
                self.close()
                if attempt == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**attempt)

    def size(self) -> int:
        return self._try(lambda f: f.size())

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or not 0 < length <= self.most:
            raise ValueError(f"{self.path}: a range of {length} bytes at {start}")
        data = self._try(lambda f: f.read_at(length, start))
        if len(data) != length:
            raise ValueError(f"{self.path}: {len(data)} of {length} bytes at {start}")
        self.requests += 1
        self.bytes += length
        return data

    def pieces(self, start: int, length: int) -> Iterator[bytes]:
        for at in range(start, start + length, self.most):
            yield self.read(at, min(self.most, start + length - at))

    def close(self) -> None:
        if self.file is not None:
            try:
                self.file.close()
            except OSError:
                pass
            self.file = None


class Stretch:
    """A file as a stream for a header's parser: read ahead in small ranges, skipped over without reading."""

    def __init__(self, ranges: Ranges, ahead: int = 64 << 10):
        self.ranges, self.ahead, self.at, self.held, self.start, self.end = ranges, ahead, 0, b"", 0, ranges.size()

    def read(self, length: int) -> bytes:
        if self.at + length > self.end:
            raise ValueError(f"{self.ranges.path} ends within its header")
        if not self.start <= self.at <= self.at + length <= self.start + len(self.held):
            self.start = self.at
            self.held = b"".join(self.ranges.pieces(self.at, min(max(length, self.ahead), self.end - self.at))) if length else b""
        out = self.held[self.at - self.start : self.at - self.start + length]
        self.at += length
        return out

    def seek(self, offset: int, whence: int = 0) -> None:
        self.at = offset + (self.at if whence == 1 else 0)

    def tell(self) -> int:
        return self.at


class _Files(DataSourceReader):
    """A partition for each file."""

    def __init__(self, options):
        self.paths, self.suffix = options.get("paths", options.get("path", "")), options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        return [tensors._File(p) for p in listed(self.paths, self.suffix)]


class ShardHeaderSource(DataSource):
    """format("shard_headers"): a row for each tensor of shards: 8 bytes of size, JSON, payload. Only headers are read."""

    MOST = 8 << 20

    @classmethod
    def name(cls) -> str:
        return "shard_headers"

    def schema(self) -> str:
        return "path string, tensor string, dtype string, shape array<bigint>, start bigint, end bigint"

    def reader(self, schema) -> DataSourceReader:
        return _ShardHeaders(self.options)


class _ShardHeaders(_Files):
    def read(self, part) -> Iterator[tuple]:
        file = Ranges(part.path)
        whole = file.size()
        size = struct.unpack("<Q", file.read(0, 8))[0] if whole >= 8 else 0
        if not 2 <= size <= min(ShardHeaderSource.MOST, whole - 8):
            raise ValueError(f"{part.path}: a header of {size} bytes")
        for name, x in json.loads(file.read(8, size)).items():
            if name != "__metadata__":
                start, end = x["data_offsets"]
                if not 0 <= start <= end <= whole - 8 - size:
                    raise ValueError(f"{part.path}: {name} lies outside the payload")
                yield part.path, name, x["dtype"], x["shape"], start, end
        file.close()


class MetadataSource(DataSource):
    """format("container_metadata"): a row (path, key, value as JSON) for each metadata pair of tensor containers. Where a
    filter names keys, the values of others are skipped over and not read."""

    @classmethod
    def name(cls) -> str:
        return "container_metadata"

    def schema(self) -> str:
        return "path string, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Metadata(self.options)


class _Metadata(_Files):
    def __init__(self, options):
        super().__init__(options)
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                keys = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = keys if self.wanted is None else self.wanted & keys
            else:
                yield f

    def read(self, part) -> Iterator[tuple]:
        file = Ranges(part.path)
        found = tensors.Header(Stretch(file), self.wanted).metadata
        file.close()
        for key, value in found.items():
            if self.wanted is None or key in self.wanted:
                yield part.path, key, json.dumps(value)


class _Spans(InputPartition):
    """Stretches (path, start, stop) of files, in sequences."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


class IdSource(DataSource):
    """format("packed_ids"): (path, place, ids) of files of little-endian unsigned 32-bit ids in sequences of option ``length``;
    place counts from 0 within a file. A partition reads up to ``STEP`` bytes of one file, or small files until it has ``SHARED``
    bytes; a file must hold whole sequences."""

    STEP, SHARED = 64 << 20, 4 << 20

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "path string, place bigint, ids array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _Ids(self.options)


class _Ids(_Files):
    def __init__(self, options):
        super().__init__(options)
        self.bytes = 4 * int(options["length"])

    def partitions(self) -> list[InputPartition]:
        step, out, held, bytes_held = max(IdSource.STEP // self.bytes, 1), [], [], 0
        for path, size in sized(self.paths, self.suffix):
            if size is None:
                size = Ranges(path).size()
            if size % self.bytes:
                raise ValueError(f"{path}: {size} bytes are no whole sequences of {self.bytes}")
            n = size // self.bytes
            if size >= IdSource.SHARED:
                out += [_Spans([(path, a, min(a + step, n))]) for a in range(0, n, step)]
            elif n:
                if held and bytes_held + size > IdSource.SHARED:
                    out.append(_Spans(held))
                    held, bytes_held = [], 0
                held.append((path, 0, n))
                bytes_held += size
        return out + [_Spans(held)] * bool(held)

    def read(self, part: _Spans) -> Iterator[pa.RecordBatch]:
        import numpy as np

        some, kind = max((1 << 20) // self.bytes, 1), pa.list_(pa.int64())
        for path, start, stop in part.spans:
            file = Ranges(path, most=max(16 << 20, self.bytes))
            for a in range(start, stop, some):
                n = min(some, stop - a)
                flat = np.frombuffer(file.read(a * self.bytes, n * self.bytes), "<u4").astype(np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (self.bytes // 4)), pa.array(flat), type=kind)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(a, a + n)), ids], names=["path", "place", "ids"])
            file.close()


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ShardHeaderSource, MetadataSource, IdSource):
        spark.dataSource.register(source)
