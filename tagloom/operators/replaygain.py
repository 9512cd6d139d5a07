"""ReplayGain values in tag items: reading, writing and clearing, a pivot and an unpivot of five keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalars as S

# Key, column, and whether it is a gain.
KEYS = (("REPLAYGAIN_TRACK_GAIN", "track_gain", True), ("REPLAYGAIN_TRACK_PEAK", "track_peak", False), ("REPLAYGAIN_ALBUM_GAIN", "album_gain", True), ("REPLAYGAIN_ALBUM_PEAK", "album_peak", False), ("REPLAYGAIN_REFERENCE_LOUDNESS", "reference_level", True))
REFERENCE = 89.0


def read(items: DataFrame) -> DataFrame:
    """(file_id, track_gain, track_peak, album_gain, album_peak, reference_level, bad) of files with such keys.

    Keys match without case; of keys that differ in case the least ordinal's first value counts. bad lists the keys
    whose value is no finite number; their column is null.
    """
    key, first = S.ascii_upper("key"), F.try_element_at("values", F.lit(1))
    rows = items.where(key.isin(*[k for k, _, _ in KEYS]))
    picked = [F.min_by(F.when(key == k, first), F.when(key == k, F.col("ordinal"))).alias(c) for k, c, _ in KEYS]
    out = rows.groupBy("file_id").agg(*picked)
    parsed = {c: (S.parse_gain if gain else S.parse_peak)(c) for _, c, gain in KEYS}
    bad = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & parsed[c].isNull(), F.lit(k)) for k, c, _ in KEYS]))
    return out.select("file_id", *[v.alias(c) for c, v in parsed.items()], bad.alias("bad"))


def write(gains: DataFrame) -> DataFrame:
    """Items of the columns that read() gives; the reference level only if it is over 0.01 from 89."""
    other = F.abs(F.col("reference_level").cast("double") - REFERENCE) > 0.01
    rows = [F.when(F.col(c).isNotNull() if c != "reference_level" else other, F.struct(F.lit(k).alias("key"), F.array(S.format_gain(c) if gain else S.format_peak(c)).alias("values"))) for k, c, gain in KEYS]
    out = gains.select("file_id", F.posexplode(F.array_compact(F.array(*rows))).alias("ordinal", "x"))
    return out.select("file_id", "ordinal", "x.key", "x.values").where("values[0] is not null")


def clear(items: DataFrame) -> DataFrame:
    return items.where(~S.ascii_upper("key").isin(*[k for k, _, _ in KEYS]))


def factors(gains: DataFrame) -> DataFrame:
    """(file_id, track_factor, album_factor, has_info, has_track_info, has_album_info)."""
    there = {c: F.col(c).isNotNull() for _, c, _ in KEYS}
    track, album = there["track_gain"] | there["track_peak"], there["album_gain"] | there["album_peak"]
    return gains.select("file_id", S.adjustment_factor("track_gain").alias("track_factor"), S.adjustment_factor("album_gain").alias("album_factor"), (track | album).alias("has_info"), track.alias("has_track_info"), album.alias("has_album_info"))


def from_rva2(frames: DataFrame, items: DataFrame) -> DataFrame:
    """Items with TXXX keys made of RVA2 frames (file_id, desc, gain, peak) where no such key is there."""
    kind = F.lower("desc")
    rows = frames.where(kind.isin("track", "album")).select("file_id", F.explode(F.array(F.struct(F.concat(F.lit("TXXX:REPLAYGAIN_"), F.upper("desc"), F.lit("_GAIN")).alias("key"), F.array(S.format_gain("gain")).alias("values")), F.struct(F.concat(F.lit("TXXX:REPLAYGAIN_"), F.upper("desc"), F.lit("_PEAK")).alias("key"), F.array(S.format_peak("peak")).alias("values")))).alias("x"))
    rows = rows.select("file_id", F.lit(None).cast("int").alias("ordinal"), "x.key", "x.values")
    own = items.select("file_id", F.upper("key").alias("have"))
    lacking = rows.join(own, (rows["file_id"] == own["file_id"]) & (F.upper(rows["key"]) == own["have"]), "left_anti")
    return items.unionByName(lacking)
