"""Snapshots of tags and stream properties as JSON, and their reading under limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Caps on bytes of a snapshot, entries, and bytes of their strings.
MAX_INPUT, MAX_ENTRIES, MAX_STRINGS = 16 << 20, 10_000, 10 << 20
#: Caps on the depth and on the values of raw tags.
MAX_DEPTH, MAX_NODES = 64, 100_000
SCHEMA = "format string, filename string, stream_info struct<length_secs:double,bitrate:bigint,sample_rate:bigint,channels:int,bits_per_sample:int>, tags map<string,array<string>>"


def write(audio: DataFrame) -> DataFrame:
    """(path, json) of parsed audio rows; fields without a value are left out."""
    tags = F.map_from_entries(F.transform(F.coalesce("items", F.array()), lambda x: F.struct(x["key"], x["values"])))
    return audio.where("error is null").select("path", F.to_json(F.struct("format", F.col("path").alias("filename"), "stream_info", tags.alias("tags"))).alias("json"))


def _shape(json: Column) -> tuple[Column, Column]:
    """(depth, number of values) of a JSON text, by its brackets and commas outside of strings."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*"', "0")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    deep = F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), _step, lambda a: a["most"])
    return deep, 1 + F.regexp_count(bare, F.lit(",")) + F.regexp_count(bare, F.lit(r"[\[{]\s*[^\]}\s]"))


def _step(a: Column, c: Column) -> Column:
    now = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))


def read(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """The input's columns, snapshot (SCHEMA's struct) and error: what breaks a limit or isn't a snapshot has a null snapshot.

    A length that is negative or no number is null. raw_tags is kept as a variant where it is there.
    """
    small = F.octet_length(json_col) <= MAX_INPUT
    text = F.when(small, F.col(json_col))
    out = rows.withColumn("snapshot", F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}))
    tags = F.col("snapshot.tags")
    strings = F.aggregate(F.map_entries(tags), F.lit(0).cast("bigint"), lambda a, e: a + F.octet_length(e["key"]) + F.aggregate(e["value"], F.lit(0).cast("bigint"), lambda b, v: b + F.coalesce(F.octet_length(v), F.lit(0))))
    error = F.when(~small, "too large").when(F.col("snapshot").isNull() | F.col("snapshot.format").isNull(), "not a snapshot").when(F.size(tags) > MAX_ENTRIES, "too many entries").when(strings > MAX_STRINGS, "strings too long")
    deep, nodes = _shape(F.get_json_object(text, "$.raw_tags"))
    error = error.when(deep > MAX_DEPTH, "raw tags too deep").when(nodes > MAX_NODES, "too many raw values")
    out = out.withColumn("error", error).withColumn("raw_tags", F.try_variant_get(F.try_parse_json(text), "$.raw_tags", "variant"))
    length = F.col("snapshot.stream_info.length_secs")
    return out.withColumn("snapshot", F.when(F.col("error").isNull(), F.col("snapshot").withField("stream_info.length_secs", F.when((length >= 0) & ~F.isnan(length), length))))
