"""Differences between tag sets: one aggregation per side and one full outer join on (file_id, key)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import convert


@dataclass(frozen=True)
class Options:
    case_insensitive_keys: bool = False
    trim_values: bool = False
    include_keys: Sequence[str] | None = None
    exclude_keys: Sequence[str] = ()
    include_unchanged: bool = False
    normalize_custom_keys: bool = False


def _side(items: DataFrame, o: Options) -> DataFrame:
    """A row per normal key, the values of rows that share it put together in order. Keys are chosen before anything is shuffled."""
    key = F.lower("key") if o.case_insensitive_keys else F.col("key")
    fold = str.lower if o.case_insensitive_keys else str
    rows = items.select("file_id", "ordinal", key.alias("key"), (F.transform("values", S.trim) if o.trim_values else F.col("values")).alias("values"))
    if o.exclude_keys:
        rows = rows.where(~F.col("key").isin(*map(fold, o.exclude_keys)))
    if o.include_keys is not None:
        rows = rows.where(F.col("key").isin(*map(fold, o.include_keys)) if o.include_keys else F.lit(False))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "values")))
    return rows.groupBy("file_id", "key").agg(F.flatten(F.transform(parts, lambda x: x["values"])).alias("values"))


def diff(left: DataFrame, right: DataFrame, options: Options | None = None) -> DataFrame:
    """(file_id, key, status, left, right): changed, left_only, right_only and, if asked for, unchanged. Order of values counts."""
    o = options or Options()
    a, b = _side(left, o).withColumnRenamed("values", "left"), _side(right, o).withColumnRenamed("values", "right")
    status = F.when(F.col("left").isNull(), "right_only").when(F.col("right").isNull(), "left_only").when(F.col("left") == F.col("right"), "unchanged").otherwise("changed")
    out = a.join(b, ["file_id", "key"], "full_outer").select("file_id", "key", status.alias("status"), "left", "right")
    return out if o.include_unchanged else out.where("status <> 'unchanged'")


def as_items(tag_map: DataFrame, normalize_custom_keys: bool = False) -> DataFrame:
    """A tag map as items named by field; custom keys bare and in lower case if asked for."""
    key = F.when(F.col("is_custom"), F.lower(convert.strip_custom("field"))).otherwise(F.col("field")) if normalize_custom_keys else F.col("field")
    return tag_map.select("file_id", F.when(F.col("is_custom"), F.col("field")).otherwise(F.lit("")).alias("ordinal"), key.alias("key"), "values")


def diff_normalized(left_items: DataFrame, right_items: DataFrame, options: Options | None = None) -> DataFrame:
    """diff() of what two sets of items, each with a system column, mean in canonical fields."""
    o = options or Options()
    return diff(*(as_items(convert.extract(x), o.normalize_custom_keys) for x in (left_items, right_items)), o)


STREAM = ("length_secs", "bitrate", "sample_rate", "channels", "bits_per_sample")


def stream_diff(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(file_id, and per property struct(left, right) where the two differ, else null); lengths may differ by less than tolerance."""
    a, b = (x.select("file_id", *[F.col(c).alias(f"{side}_{c}") for c in STREAM]) for x, side in ((left, "l"), (right, "r")))
    both = a.join(b, "file_id")

    def changed(c: str) -> Column:
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) < tolerance, F.lit(False)) if c == "length_secs" else x.eqNullSafe(y)
        return F.when(~same, F.struct(x.alias("left"), y.alias("right"))).alias(c)

    return both.select("file_id", *[changed(c) for c in STREAM])


def summary(differences: DataFrame, streams: DataFrame | None = None) -> DataFrame:
    """(file_id, changed, left_only, right_only, unchanged, diff_count, differing_keys, is_identical, summary) of files that diff() has rows of.

    With streams, files of which only the stream differs are there too, and such files aren't identical.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = differences.groupBy("file_id").agg(n("changed"), n("left_only"), n("right_only"), n("unchanged"), F.sort_array(F.collect_list(F.when(F.col("status") != "unchanged", F.col("key")))).alias("differing_keys"))
    if streams is not None:
        odd = streams.where(" or ".join(f"{c} is not null" for c in STREAM)).select("file_id", F.lit(True).alias("stream"))
        out = out.join(odd, "file_id", "full_outer").fillna(0, ["changed", "left_only", "right_only", "unchanged"])
        out = out.withColumn("differing_keys", F.coalesce("differing_keys", F.array().cast("array<string>")))
    else:
        out = out.withColumn("stream", F.lit(None).cast("boolean"))
    out = out.withColumn("diff_count", F.expr("changed + left_only + right_only"))
    text = F.format_string("%d changed, %d removed, %d added, %d unchanged", "changed", "left_only", "right_only", "unchanged")
    return out.withColumn("is_identical", (F.col("diff_count") == 0) & F.col("stream").isNull()).withColumn("summary", text).drop("stream")


def get_change(differences: DataFrame, key: str) -> DataFrame:
    """(file_id, left, right) of the files whose values under a key changed."""
    return differences.where((F.col("status") == "changed") & (F.col("key") == key)).select("file_id", "left", "right")


def against_snapshot(items: DataFrame, snapshots: DataFrame, options: Options | None = None) -> DataFrame:
    """diff() of what snapshots (file_id, snapshot, as sources.snapshot.read() gives them) held, on the left, and items, on the right."""
    tags = F.col("snapshot.tags")
    before = snapshots.where(tags.isNotNull()).select("file_id", F.posexplode(F.sort_array(F.map_entries(tags))).alias("ordinal", "x"))
    before = before.select("file_id", "ordinal", F.col("x.key").alias("key"), F.col("x.value").alias("values"))
    return diff(before, items.select("file_id", "ordinal", "key", "values"), options or Options())
