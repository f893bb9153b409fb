"""Python data sources over containers of packed tensors: descriptors from the header, groups by byte ranges.

The container is the public GGUF layout: magic, version, counts, key-value pairs, tensor descriptors, aligned payload. The
header is read by seeking over what is not asked for; groups are read in ranges, one partition each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any, BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = b"GGUF"
#: Sizes of the scalar value types by their number in the format (fixed values).
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
STRING, ARRAY = 8, 9
#: Bytes of a ternary group: a half-precision scale and 128 2-bit codes.
GROUP_BYTES, GROUP_CODES = 34, 128


class Header:
    def __init__(self, f: BinaryIO, wanted: set[str] | None = None):
        self.f = f
        if f.read(4) != MAGIC:
            raise ValueError("not a tensor container")
        self.version, tensors, pairs = struct.unpack("<IQQ", f.read(20))
        self.metadata: dict[str, Any] = {}
        for _ in range(pairs):
            key, kind = self.text(), self.number("I")
            keep = wanted is None or key in wanted or key == "general.alignment"
            value = self.value(kind, keep)
            if keep:
                self.metadata[key] = value
        self.tensors = []
        for _ in range(tensors):
            name, rank = self.text(), self.number("I")
            dims = list(struct.unpack(f"<{rank}Q", f.read(8 * rank)))
            kind, offset = struct.unpack("<IQ", f.read(12))
            self.tensors.append((name, kind, dims, offset))
        align = int(self.metadata.get("general.alignment", 32))
        self.payload = -(-f.tell() // align) * align

    def number(self, code: str) -> Any:
        return struct.unpack(f"<{code}", self.f.read(struct.calcsize(f"<{code}")))[0]

    def text(self) -> str:
        return self.f.read(self.number("Q")).decode()

    def value(self, kind: int, keep: bool) -> Any:
        if kind in SCALARS:
            return self.number(SCALARS[kind])
        if kind == STRING:
            if keep:
                return self.text()
            self.f.seek(self.number("Q"), 1)
            return None
        if kind != ARRAY:
            raise ValueError(f"unknown value type {kind}")
        inner, n = self.number("I"), self.number("Q")
        if not keep and inner in SCALARS:
            self.f.seek(n * struct.calcsize(f"<{SCALARS[inner]}"), 1)
            return None
        return [self.value(inner, keep) for _ in range(n)]


def container(metadata: dict[str, tuple[int, Any]], descriptors: list[tuple[str, int, list[int], int]], align: int = 32) -> bytes:
    """The header of a container, up to its payload: pairs of key and (kind, value), where the value of an array is (kind, values)."""

    def text(x: str) -> bytes:
        return struct.pack("<Q", len(x.encode())) + x.encode()

    def value(kind: int, x: Any) -> bytes:
        if kind == STRING:
            return text(x)
        if kind == ARRAY:
            return struct.pack("<IQ", x[0], len(x[1])) + b"".join(value(x[0], y) for y in x[1])
        return struct.pack(f"<{SCALARS[kind]}", x)

    pairs = b"".join(text(k) + struct.pack("<I", kind) + value(kind, x) for k, (kind, x) in metadata.items())
    named = b"".join(text(n) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, kind, offset) for n, kind, dims, offset in descriptors)
    head = MAGIC + struct.pack("<IQQ", 3, len(descriptors), len(metadata)) + pairs + named
    return head + bytes(-len(head) % align)


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, stop: int = 0):
        self.path, self.start, self.stop = path, start, stop


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(base)


class TensorSource(DataSource):
    """format("tensors"): a row for each tensor of the files in option ``paths`` (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "path string, name string, kind int, dims array<bigint>, elements bigint, offset bigint"

    def reader(self, schema) -> DataSourceReader:
        return _TensorReader(self.options)


class _TensorReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, part: _File) -> Iterator[tuple]:
        with _open(part.path) as f:
            header = Header(f, set())
        for name, kind, dims, offset in header.tensors:
            n = 1
            for d in dims:
                n *= d
            yield part.path, name, kind, dims, n, header.payload + offset


class GroupSource(DataSource):
    """format("tensor_groups"): (group, scale, codes) of ternary groups at byte ``offset`` of ``path``, ``groups`` of them.

    With ``sample`` k, only k evenly spaced groups are read: i * (n - 1) div max(k - 1, 1).
    """

    @classmethod
    def name(cls) -> str:
        return "tensor_groups"

    def schema(self) -> str:
        return "group bigint, scale double, codes array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _GroupReader(self.options)


class _GroupReader(DataSourceReader):
    STEP = 1 << 16

    def __init__(self, options):
        self.path, self.offset, self.groups = options["path"], int(options.get("offset", 0)), int(options["groups"])
        self.sample = int(options["sample"]) if "sample" in options else None

    def partitions(self) -> list[InputPartition]:
        n = self.groups if self.sample is None else min(self.sample, self.groups)
        return [_File(self.path, a, min(n, a + self.STEP)) for a in range(0, n, self.STEP)]

    def read(self, part: _File) -> Iterator[tuple]:
        import numpy as np

        with _open(part.path) as f:
            if self.sample is None:
                f.seek(self.offset + part.start * GROUP_BYTES)
                raw, ids = f.read((part.stop - part.start) * GROUP_BYTES), range(part.start, part.stop)
            else:
                k = min(self.sample, self.groups)
                ids, pieces = [i * (self.groups - 1) // max(k - 1, 1) for i in range(part.start, part.stop)], []
                for g in ids:
                    f.seek(self.offset + g * GROUP_BYTES)
                    pieces.append(f.read(GROUP_BYTES))
                raw = b"".join(pieces)
        data = np.frombuffer(raw, np.uint8).reshape(-1, GROUP_BYTES)
        if len(data) != len(ids):
            raise ValueError("the file ends within a group")
        scale = data[:, :2].copy().view("<f2")[:, 0].astype(float)
        codes = ((data[:, 2:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(len(data), GROUP_CODES).astype(np.int32) - 1
        for g, s, c in zip(ids, scale.tolist(), codes.tolist()):
            yield g, s, c


def register(spark) -> None:
    spark.dataSource.register(TensorSource)
    spark.dataSource.register(GroupSource)
