"""Parsing from ranged reads: a file's blocks are fetched as its parser asks for them, so tags of large files cost a few blocks.

Files are listed by Spark and opened on the executors through Arrow's file systems (local, HDFS, S3, GCS by their URIs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tagloom import ship
from tagloom.operators import detect
from tagloom.sources.audio import _ARROW, SCHEMA, Parser, parse_one, scan
from tagloom.sources.parsers.base import Limits, using


class Ranged:
    """What parsers need of bytes, by reads of whole blocks; the last blocks read are kept."""

    def __init__(self, read: Callable[[int, int], bytes], size: int, block: int = 1 << 16, kept: int = 64) -> None:
        self.read, self.size, self.block, self.kept = read, size, block, kept
        self.blocks: dict[int, bytes] = {}
        self.fetched = 0

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[k] = self.read(k * self.block, min(self.block, self.size - k * self.block))
            self.fetched += len(self.blocks[k])
        return self.blocks[k]

    def __getitem__(self, key: int | slice) -> int | bytes:
        if isinstance(key, int):
            at = key + self.size if key < 0 else key
            if not 0 <= at < self.size:
                raise IndexError(key)
            return self._block(at // self.block)[at % self.block]
        start, end, step = key.indices(self.size)
        if step != 1 or start >= end:
            return b""
        first, last = start // self.block, (end - 1) // self.block
        if last - first >= self.kept // 2:  # one long read instead of many blocks
            self.fetched += end - start
            return self.read(start, end - start)
        whole = b"".join(self._block(k) for k in range(first, last + 1))
        return whole[start - first * self.block : end - first * self.block]

    def find(self, mark: bytes, start: int = 0, end: int | None = None) -> int:
        start, end, _ = slice(start, end).indices(self.size)
        at = start
        while at < end:
            stop = min(end, (at // self.block + 1) * self.block + len(mark) - 1)
            found = self[at:stop].find(mark)
            if found >= 0:
                return at + found
            at = (at // self.block + 1) * self.block
        return -1

    def rfind(self, mark: bytes, start: int = 0, end: int | None = None) -> int:
        start, end, _ = slice(start, end).indices(self.size)
        stop = end
        while stop > start:
            at = max(start, (stop - 1) // self.block * self.block)
            found = self[at : min(end, stop + len(mark) - 1)].rfind(mark)
            if found >= 0:
                return at + found
            stop = at
        return -1


def _opened(uri: str) -> pa.NativeFile:
    """A file by the path that Spark gives, whose characters aren't quoted as in Arrow's URIs."""
    scheme, _, rest = uri.partition(":")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    system, path = fs.FileSystem.from_uri(f"{scheme}://" + ("/" if scheme == "file" else "") + quote(rest.lstrip("/"), safe="/:@"))
    return system.open_input_file(path)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("fault", pa.string())])
    for batch in batches:
        rows = []
        for path, size in zip(*(batch.column(c).to_pylist() for c in ("path", "length")), strict=True):
            row = {"path": path, "length": size, "content": b"", "fault": None}
            try:
                with _opened(path) as f:
                    row["content"] = f.read_at(min(detect.HEADER, size), 0)
            except (OSError, pa.ArrowException) as e:
                row["fault"] = str(e)
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _parsed(parsers: dict[str, Parser] | None, limits: Limits | None, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, fmt, fault in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "format", "fault")), strict=True):
                row = {"path": path, "format": fmt}
                try:
                    if fault:
                        raise OSError(fault)
                    with using(limits), _opened(path) as f:
                        row |= parse_one(fmt, Ranged(lambda at, n, f=f: f.read_at(n, at), size, block), parsers)
                except (OSError, pa.ArrowException) as e:
                    row["error"] = {"kind": "io", "message": str(e)}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    return run


def read_ranges(spark: SparkSession, path: str, glob: str = "*", parsers: dict[str, Parser] | None = None, limits: Limits | None = None, block: int = 1 << 16) -> DataFrame:
    """Rows as audio.read_audio() gives them, of files of any size, from reads of blocks. A file that can't be opened is a row with an error."""
    from tagloom.sources.audio import PARSERS

    ship(spark)
    files = scan(spark, path, glob).select("path", "length")
    heads = detect.with_format(files.mapInArrow(_headers, "path string, length bigint, content binary, fault string"))
    both = (PARSERS | parsers) if parsers else None
    return heads.select("path", "length", "format", "fault").mapInArrow(_parsed(both, limits, block), SCHEMA)
