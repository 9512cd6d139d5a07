"""Ranged reads: the first and last bytes of files, for detection without reading whole files.

For folders that driver and executors see under one path, such as a mounted store; audio.scan() reads any other store.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tagloom import ship
from tagloom.operators import detect


class Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.head, self.tail, self.files = (int(options.get(k, v)) for k, v in (("header", detect.HEADER), ("tail", 0), ("filesperpartition", 1000)))

    def partitions(self) -> list[Part]:
        paths = sorted(str(p) for p in Path(self.root).rglob(self.glob) if p.is_file())
        return [Part(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as f:
                size = os.fstat(f.fileno()).st_size
                head = f.read(self.head)
                f.seek(max(0, size - self.tail))
                yield path, size, head, f.read(self.tail) if self.tail else b""


class Probe(DataSource):
    """spark.read.format("audio_probe").option("tail", 128).load(folder): path, length, header, tail."""

    @classmethod
    def name(cls) -> str:
        return "audio_probe"

    def schema(self) -> str:
        return "path string, length bigint, header binary, tail binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def probe(spark: SparkSession, folder: str, glob: str = "*", tail: int = 128) -> DataFrame:
    """(path, length, header, tail, format) of the files below a folder; 128 bytes of each are read from either end."""
    ship(spark)
    spark.dataSource.register(Probe)
    rows = spark.read.format("audio_probe").option("glob", glob).option("tail", tail).load(folder)
    return rows.withColumn("format", detect.detect_format("header", "path"))
