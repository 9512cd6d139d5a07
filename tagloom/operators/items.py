"""The dictionary verbs on tag items (file_id, ordinal, key, values), a row per key of a file.

Each verb is a DataFrame transformation; only those that gather a file's rows shuffle, on file_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM_SCHEMA = "file_id string, ordinal int, key string, values array<string>"


def unpivot(files: DataFrame, tags: str = "tags", id_col: str = "file_id") -> DataFrame:
    """Items of a map column of tags; ordinal is the rank of the key in byte order."""
    keys = F.array_sort(F.map_keys(tags))
    out = files.select(F.col(id_col).alias("file_id"), F.posexplode(keys).alias("ordinal", "key"), F.col(tags).alias("__tags"))
    return out.select("file_id", "ordinal", "key", F.try_element_at("__tags", "key").alias("values"))


def pivot(items: DataFrame) -> DataFrame:
    """A row per file with a map of its tags; of rows that repeat a key the last ordinal counts."""
    last = items.groupBy("file_id", "key").agg(F.max_by("values", F.coalesce("ordinal", F.lit(-1))).alias("values"))
    return last.groupBy("file_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "values")))).alias("tags"))


def get(items: DataFrame, key: str) -> DataFrame:
    return items.where(F.col("key") == key).select("file_id", "values")


def get_first(items: DataFrame, key: str) -> DataFrame:
    return get(items, key).select("file_id", F.try_element_at("values", F.lit(1)).alias("value"))


def get_or(items: DataFrame, files: DataFrame, key: str, default: Sequence[str]) -> DataFrame:
    """The values of a key for every file of files, or the default where a file lacks it."""
    found = get(items, key)
    return files.select("file_id").distinct().join(found, "file_id", "left").select("file_id", F.coalesce("values", F.array(*map(F.lit, default)).cast("array<string>")).alias("values"))


def keys(items: DataFrame) -> DataFrame:
    return items.select("file_id", "key").distinct()


def count(items: DataFrame) -> DataFrame:
    return items.groupBy("file_id").agg(F.countDistinct("key").alias("n_keys"))


def contains(items: DataFrame, key: str) -> DataFrame:
    """(file_id, found) of each file that has items."""
    return items.groupBy("file_id").agg(F.bool_or(F.col("key") == key).alias("found"))


def family(key: Column | str, pattern: str) -> Column:
    """Whether a key is the pattern, or of its family: 'COMM' takes 'COMM:..', 'TXXX:a:' takes keys that start so."""
    k = F.col(key) if isinstance(key, str) else key
    return (k == pattern) | k.startswith(pattern if pattern.endswith(":") else pattern + ":")


def getall(items: DataFrame, pattern: str) -> DataFrame:
    return items.where(family("key", pattern))


def delall(items: DataFrame, pattern: str) -> DataFrame:
    return items.where(~family("key", pattern))


def remove(items: DataFrame, *names: str) -> DataFrame:
    return items.where(~F.col("key").isin(*names))


def setall(items: DataFrame, pattern: str, new: DataFrame) -> DataFrame:
    """The family of pattern replaced by the items in new."""
    return delall(items, pattern).unionByName(new)


def update(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items after changes (file_id, ordinal, key, values) in order of ordinal: the last for a key counts, an empty list deletes it.

    One aggregation on (file_id, key) with map-side combining; the result's ordinal is the rank of the key in its file.
    """
    both = items.withColumn("__turn", F.lit(-1)).unionByName(changes.withColumn("__turn", F.coalesce("ordinal", F.lit(0))))
    last = both.groupBy("file_id", "key").agg(F.max_by("values", F.struct("__turn", F.coalesce("ordinal", F.lit(0)))).alias("values"))
    return ranked(last.where(F.size("values") > 0))


def ranked(items: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("key")) - 1
    return items.withColumn("ordinal", order).select("file_id", "ordinal", "key", "values")


def pop(items: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what each file had under key, the items without it). A file that lacks the key gives its first key of that family."""
    pick = F.min(F.struct((F.col("key") != key).alias("far"), "key", "values"))
    taken = items.where(family("key", key)).groupBy("file_id").agg(pick.alias("x")).select("file_id", F.col("x.key").alias("key"), F.col("x.values").alias("values"))
    return taken, items.join(taken.select("file_id", "key"), ["file_id", "key"], "left_anti")


def popitem(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the item of the least key of each file, the items without it)."""
    taken = items.groupBy("file_id").agg(F.min(F.struct("key", "values")).alias("x")).select("file_id", F.col("x.key").alias("key"), F.col("x.values").alias("values"))
    return taken, items.join(taken.select("file_id", "key"), ["file_id", "key"], "left_anti")


def setdefault(items: DataFrame, defaults: DataFrame) -> DataFrame:
    """Items with those of defaults whose key a file lacks."""
    return items.unionByName(defaults.join(items.select("file_id", "key"), ["file_id", "key"], "left_anti").select(items.columns))


def merge_frames(items: DataFrame, separator: str | None = None) -> DataFrame:
    """Rows that repeat a key merged in order: values put together, or joined to one text by separator."""
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "values")))
    merged = F.flatten(F.transform(parts, lambda x: x["values"]))
    out = F.array(F.array_join(merged, separator)) if separator is not None else merged
    return items.groupBy("file_id", "key").agg(F.min("ordinal").alias("ordinal"), out.alias("values"))


def byte_budget(items: DataFrame, max_entries: int = 10_000, max_bytes: int = 50_000_000) -> DataFrame:
    """(file_id, entries, bytes, ok): octets of keys and values, against the caps for a batch of changes."""
    size = F.octet_length("key") + F.aggregate("values", F.lit(0).cast("bigint"), lambda a, v: a + F.octet_length(v))
    out = items.groupBy("file_id").agg(F.count("*").alias("entries"), F.sum(size).cast("bigint").alias("bytes"))
    return out.withColumn("ok", (F.col("entries") <= max_entries) & (F.col("bytes") <= max_bytes))


def update_checked(items: DataFrame, changes: DataFrame, max_entries: int = 10_000, max_bytes: int = 50_000_000) -> tuple[DataFrame, DataFrame]:
    """(items, refused): update() for the files whose changes keep within the caps; the others keep their items, whole, and are in refused (file_id, entries, bytes)."""
    over = byte_budget(changes, max_entries, max_bytes).where("not ok").select("file_id", "entries", "bytes")
    good = changes.join(over.select("file_id"), "file_id", "left_anti")
    return update(items, good.select("file_id", "ordinal", "key", "values")), over


def set_common_fields(items: DataFrame, fields: DataFrame, names: Sequence[str] = ("artist", "album", "title", "track_number", "date", "genre")) -> DataFrame:
    """Items with the values of fields (file_id and a column per common field; null leaves a field, '' deletes it) under its key, which is found without case."""
    other = {"track_number": "tracknumber"}
    new = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(other.get(n, n)).alias("name"), F.when(F.col(n) == "", F.array().cast("array<string>")).otherwise(F.array(n)).alias("new"))) for n in names if n in fields.columns]))
    wanted = fields.select("file_id", F.explode(new).alias("x")).select("file_id", "x.name", "x.new")
    low = F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    have = items.where(low.isin(*[other.get(n, n) for n in names])).select("file_id", low.alias("name"), "ordinal", "key")
    have = have.groupBy("file_id", "name").agg(F.min_by("key", "ordinal").alias("key"))
    changes = wanted.join(have, ["file_id", "name"], "left").select("file_id", F.lit(0).alias("ordinal"), F.coalesce("key", "name").alias("key"), F.col("new").alias("values"))
    return update(items.select("file_id", "ordinal", "key", "values"), changes)


def common_fields(items: DataFrame, names: Sequence[str] = ("artist", "album", "title", "track_number", "date", "genre")) -> DataFrame:
    """A column for each common field's first value; keys are matched without case."""
    low = F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = {"track_number": "tracknumber"}
    first = F.try_element_at("values", F.lit(1))
    return items.groupBy("file_id").agg(*[F.max_by(F.when(low == other.get(n, n), first), F.when(low == other.get(n, n), F.col("ordinal"))).alias(n) for n in names])


def match_patterns(items: DataFrame, patterns: DataFrame, most: int = 10_000) -> DataFrame:
    """Items with the name of the pattern (pattern, name, priority) that fits each key: an exact one first, else the least priority.

    Exact patterns are an equi-join. Patterns with * or ? need a comparison with each, so there may be most of them at
    most; that is checked, and bounds what is broadcast.
    """
    from tagloom.functions.scalars import from_glob

    wild = patterns.where(F.col("pattern").rlike(r"[*?]"))
    if (n := wild.limit(most + 1).count()) > most:
        raise ValueError(f"more than {most} patterns ({n})")
    names = items.select("key").distinct()
    exact = patterns.where(~F.col("pattern").rlike(r"[*?]")).select(F.col("pattern").alias("key"), "name", F.struct(F.lit(0).alias("kind"), "priority").alias("rank"))
    loose = F.broadcast(wild.withColumn("regex", from_glob("pattern")))
    fits = names.join(loose, F.expr("key rlike regex")).select("key", "name", F.struct(F.lit(1).alias("kind"), "priority").alias("rank"))
    best = names.join(exact, "key").select("key", "name", "rank").unionByName(fits).groupBy("key").agg(F.min_by("name", "rank").alias("name"))
    return items.join(best, "key", "left")
