"""Chunks and atoms of parsed files as rows, and lookups by name and path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(audio: DataFrame) -> DataFrame:
    """(file_id, ordinal, path, offset, size) of every chunk that the parser of a file's format lists."""
    kind = "array<struct<id:string,path:string,offset:bigint,size:bigint>>"
    rows = audio.select(F.col("path").alias("file_id"), F.posexplode(F.from_json(F.get_json_object("extra", "$.chunks"), kind)).alias("ordinal", "c"))
    return rows.select("file_id", "ordinal", F.coalesce("c.path", "c.id").alias("path"), "c.offset", "c.size")


def find(rows: DataFrame, path: str) -> DataFrame:
    """The first chunk of each file at a path, such as 'fmt ' or 'moov.udta'."""
    first = F.min_by(F.struct("path", "offset", "size"), "ordinal").alias("c")
    return rows.where(F.col("path") == path).groupBy("file_id").agg(first).select("file_id", "c.*")


def findall(rows: DataFrame, name: str, recursive: bool = False) -> DataFrame:
    """Chunks by the last part of their path, on the top level or at any depth."""
    found = F.element_at(F.split("path", r"\."), -1) == name
    return rows.where(found if recursive else F.col("path") == name)


def children(rows: DataFrame, path: str) -> DataFrame:
    """What lies directly in a chunk."""
    return rows.where(F.col("path").startswith(path + ".") & ~F.contains(F.substr(F.col("path"), F.lit(len(path) + 2)), F.lit(".")))


def has(rows: DataFrame, path: str) -> DataFrame:
    return rows.groupBy("file_id").agg(F.bool_or(F.col("path") == path).alias("found"))
