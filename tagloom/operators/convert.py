"""Conversion between tag systems through canonical fields: extraction, options, application and merging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.plans import dims

_NONE = "array<string>"


def system_of_format(fmt: Column | str) -> Column:
    """The tag system of a format; null where the keys must tell."""
    c = F.col(fmt) if isinstance(fmt, str) else fmt
    pairs = [F.lit(x) for kv in dims.FORMAT_SYSTEM.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def system_from_keys(items: DataFrame) -> DataFrame:
    """(file_id, system): ID3v2 if over half of the keys look like frame ids and one is a known frame, else APEv2."""
    shape = F.col("key").rlike("^[A-Z0-9]{4}$")
    out = items.groupBy("file_id").agg(F.count_if(shape).alias("n"), F.count("*").alias("all"), F.bool_or(F.col("key").isin(*dims.KNOWN_FRAMES)).alias("known"))
    return out.select("file_id", F.when((F.col("n") > F.floor(F.col("all") / 2)) & F.col("known"), "ID3v2").otherwise("APEv2").alias("system"))


def system_of_keys(keys: Column) -> Column:
    """system_from_keys() of an array of all keys of a file."""
    shaped = F.size(F.filter(keys, lambda k: k.rlike("^[A-Z0-9]{4}$")))
    known = F.exists(keys, lambda k: k.isin(*dims.KNOWN_FRAMES))
    return F.when((shaped > F.floor(F.size(keys) / 2)) & known, "ID3v2").otherwise("APEv2")


def norm_key(system: Column | str, key: Column | str) -> Column:
    """A key as the lookup tables of its system hold it."""
    s, k = (F.col(x) if isinstance(x, str) else x for x in (system, key))
    id3 = F.when(k.startswith("TXXX:"), F.concat(F.lit("TXXX:"), S.ascii_lower(F.substr(k, F.lit(6))))).when(k.rlike("^[\\x00-\\x7F]{4}:"), F.substr(k, F.lit(1), F.lit(4))).otherwise(k)
    mp4 = F.when(k.rlike("^----:"), S.ascii_lower(k)).otherwise(k)
    return F.when(s == "ID3v2", id3).when(s == "VorbisComment", F.upper(k)).when(s == "MP4", mp4).when(s.isin("APEv2", "ASF"), S.ascii_lower(k))


def to_fields(items: DataFrame) -> DataFrame:
    """Items (with a system column) with the canonical field of each, null where there is none."""
    known = F.broadcast(dims.read_map(items.sparkSession))  # a fixed table of under 250 rows
    return items.withColumn("norm_key", norm_key("system", "key")).join(known, ["system", "norm_key"], "left").drop("norm_key")


#: Pairs of fields that stand in for each other when a file has only one.
TWINS = (("Publisher", "Label"), ("EncodedBy", "Encoder"))


def extract(items: DataFrame) -> DataFrame:
    """The tag map (file_id, field, is_custom, values) of items (file_id, ordinal, key, values, system).

    Lookup by broadcast, normal forms by expressions, then one aggregation on (file_id, field): the greatest ordinal
    wins, a Date the longer text and of equals the first. Items without values are skipped.
    """
    rows = to_fields(items.where(F.size("values") > 0))
    first = F.try_element_at("values", F.lit(1))
    pair = S.track_disc(first)
    split = F.col("system").isin("ID3v2", "APEv2", "MP4")
    one = lambda name, values: F.struct(F.lit(name).alias("field"), values.cast(_NONE).alias("values"), F.lit(False).alias("is_custom"), F.lit(0).alias("own"))
    both = lambda number, total: F.array(one(number, F.when(pair["number"].isNotNull(), F.array(pair["number"]))), one(total, F.when(pair["total"].isNotNull(), F.array(pair["total"]))))
    genre = F.when(F.col("system") == "ID3v2", F.transform("values", S.id3_genre)).otherwise(F.col("values"))
    genre = F.when(F.size("values") > 1, F.array(F.array_join(genre, ", "))).otherwise(genre)
    plain = lambda name, own: F.struct(name.alias("field"), F.col("values").cast(_NONE).alias("values"), F.lit(False).alias("is_custom"), F.lit(own).alias("own"))
    made = F.when(F.col("field").isNull(), F.array(F.struct(F.concat(F.coalesce(_prefix(F.col("system")), F.lit("unknown")), F.lit(":"), F.col("key")).alias("field"), F.col("values").cast(_NONE).alias("values"), F.lit(True).alias("is_custom"), F.lit(0).alias("own"))))
    made = made.when(split & (F.col("field") == "TrackNumber"), both("TrackNumber", "TotalTracks"))
    made = made.when(split & (F.col("field") == "DiscNumber"), both("DiscNumber", "TotalDiscs"))
    made = made.when(F.col("field") == "Genre", F.array(one("Genre", genre)))
    for a, b in (*TWINS, *((b, a) for a, b in TWINS)):
        made = made.when(F.col("field") == a, F.array(plain(F.lit(a), 0), plain(F.lit(b), -1)))
    made = made.otherwise(F.array(plain(F.col("field"), 0)))
    rows = rows.select("file_id", "ordinal", F.explode(made).alias("x")).where("x.values is not null").select("file_id", "ordinal", "x.field", "x.is_custom", "x.values", "x.own")
    length = F.octet_length(F.element_at("values", 1))
    rank = F.when(F.col("field") == "Date", F.struct(length.alias("a"), (-F.col("ordinal")).alias("b"))).otherwise(F.struct(F.col("own").alias("a"), F.col("ordinal").alias("b")))
    return rows.groupBy("file_id", "field", "is_custom").agg(F.max_by("values", rank).alias("values"))


def _prefix(system: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.PREFIX.items() for x in kv]), system)


def strip_custom(key: Column | str) -> Column:
    """A custom key without its system's prefix and its TXXX or free-form wrapper."""
    k = F.col(key) if isinstance(key, str) else key
    bare = F.regexp_replace(k, r"^(?:id3|vorbis|mp4|ape|asf|unknown):", "")
    return F.when(bare.startswith("TXXX:"), F.substr(bare, F.lit(6))).when(bare.startswith("----:"), F.regexp_replace(F.substr(bare, F.lit(6)), r"(?s)^[^:]*:", "")).otherwise(bare)


_PAIRS = {"TrackNumber": "TotalTracks", "DiscNumber": "TotalDiscs"}


def apply(tag_map: DataFrame, system: str) -> DataFrame:
    """(file_id, field, is_custom, key, values, status): the items that a tag map becomes in a system, and what was skipped.

    status is 'transferred', 'custom' or 'skipped' (no key for the field). Systems that hold 'N/M' get number and total
    combined, in the number's row; the total's row is transferred with a null key. Custom keys that name pictures are
    left out altogether.
    """
    known = F.broadcast(dims.write_map(tag_map.sparkSession).where(F.col("system") == system).select("field", "key"))  # under 50 rows
    rows = tag_map.where(F.size("values") > 0)
    custom = rows.where("is_custom").withColumn("bare", strip_custom("field"))
    low = F.lower("bare")
    custom = custom.where(~(low.startswith("apic") | low.contains("picture") | low.contains("cover art") | low.startswith("rva2")))
    wrap = {"ID3v2": "TXXX:", "MP4": dims.MP4_SPACE}.get(system, "")
    custom = custom.select("file_id", "field", "is_custom", F.concat(F.lit(wrap), "bare").alias("key"), "values", F.lit("custom").alias("status"))
    rows = rows.where("not is_custom")
    if system in ("VorbisComment", "ASF"):
        out = rows.join(known, "field", "left").select("file_id", "field", "is_custom", "key", "values", F.when(F.col("key").isNotNull(), "transferred").otherwise("skipped").alias("status"))
        # A total or number without a key of its own is passed over without report.
        return out.where(~((F.col("status") == "skipped") & F.col("field").isin(*_PAIRS, *_PAIRS.values()))).unionByName(custom)
    numbers, totals = F.col("field").isin(*_PAIRS), F.col("field").isin(*_PAIRS.values())
    plain = rows.where(~(numbers | totals)).join(known, "field", "left").select("file_id", "field", "is_custom", "key", "values", F.when(F.col("key").isNotNull(), "transferred").otherwise("skipped").alias("status"))
    of = F.when(F.col("field") == "TotalTracks", "TrackNumber").when(F.col("field") == "TotalDiscs", "DiscNumber").otherwise(F.col("field"))
    first = F.try_element_at("values", F.lit(1))
    pairs = rows.where(numbers | totals).withColumn("of", of).groupBy("file_id", "of").agg(F.max(F.when(numbers, first)).alias("n"), F.max(F.when(totals, first)).alias("t"))
    pairs = pairs.withColumn("both", F.array(S.combine_track_disc("n", "t"))).join(known.withColumnRenamed("field", "of"), "of")
    total = F.when(F.col("of") == "TrackNumber", "TotalTracks").otherwise("TotalDiscs")
    parts = F.filter(F.array(F.when(F.col("n").isNotNull(), F.struct(F.col("of").alias("field"), F.col("key").alias("key"), F.col("both").alias("values"))), F.when(F.col("t").isNotNull(), F.struct(total.alias("field"), F.when(F.col("n").isNull(), F.col("key")).alias("key"), F.when(F.col("n").isNull(), F.col("both")).alias("values")))), lambda x: x.isNotNull())
    pairs = pairs.select("file_id", F.explode(parts).alias("x")).select("file_id", "x.field", F.lit(False).alias("is_custom"), "x.key", "x.values", F.lit("transferred").alias("status"))
    return plain.unionByName(pairs).unionByName(custom)


def applied_items(applied: DataFrame) -> DataFrame:
    """The items of apply()'s rows; of rows with one key the greatest field wins."""
    rows = applied.where("key is not null")
    return rows.groupBy("file_id", "key").agg(F.max_by("values", "field").alias("values"))


def report(applied: DataFrame) -> DataFrame:
    """(file_id, transferred, custom_transferred, skipped): sorted field names per file."""
    names = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("field"))))
    return applied.groupBy("file_id").agg(names("transferred").alias("transferred"), names("custom").alias("custom_transferred"), names("skipped").alias("skipped"))


@dataclass(frozen=True)
class Options:
    include_fields: Sequence[str] | None = None
    exclude_fields: Sequence[str] = field(default_factory=tuple)
    transfer_custom: bool = True
    overwrite: bool = True
    clear_destination: bool = False


def selected(source: DataFrame, destination: DataFrame | None, options: Options) -> DataFrame:
    """What of a source tag map is transferred: chosen fields, and without overwriting only what the destination's map lacks."""
    rows = source.where(F.size("values") > 0)
    if options.include_fields is not None:
        rows = rows.where(F.col("is_custom") | F.col("field").isin(*options.include_fields))
    if options.exclude_fields:
        rows = rows.where(F.col("is_custom") | ~F.col("field").isin(*options.exclude_fields))
    if not options.transfer_custom:
        rows = rows.where(~F.col("is_custom"))
    if destination is not None and not options.overwrite and not options.clear_destination:
        rows = rows.join(destination.select("file_id", "field", "is_custom"), ["file_id", "field", "is_custom"], "left_anti")
    return rows


def convert(source_items: DataFrame, destination_items: DataFrame, system: str, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """(items of the destination after the transfer, report). Both inputs have (file_id, ordinal, key, values, system).

    The report needs no items and the items no report: each is a plan of its own. Without overwriting, both sides' items
    are extracted together, as one aggregation by file and field tells what the destination lacks.
    """
    options = options or Options()
    if options.overwrite or options.clear_destination:
        chosen = selected(extract(source_items), None, options)
    else:
        chosen = _lacking(source_items, destination_items, options)
    moved = apply(chosen, system)
    new = applied_items(moved)
    if options.clear_destination:
        return new, report(moved)
    old = destination_items.select("file_id", "key", "values", F.struct(F.lit(0).alias("new"), F.coalesce("ordinal", F.lit(0)).alias("ordinal")).alias("__turn"))
    new = new.withColumn("__turn", F.struct(F.lit(1).alias("new"), F.lit(0).alias("ordinal")))
    both = old.unionByName(new).groupBy("file_id", "key").agg(F.max_by("values", "__turn").alias("values"))
    return both, report(moved)


def _lacking(source_items: DataFrame, destination_items: DataFrame, options: Options) -> DataFrame:
    """What of the source's tag map is transferred to files that keep what they have, from one extraction of both sides."""
    mark = "\x00"  # parts the two sides' files; no path has it
    both = source_items.withColumn("file_id", F.concat(F.lit("s" + mark), "file_id")).unionByName(destination_items.select(*[F.concat(F.lit("d" + mark), c).alias(c) if c == "file_id" else F.col(c) for c in source_items.columns]))
    side = F.substr("file_id", F.lit(1), F.lit(1))
    maps = extract(both).select(F.substr("file_id", F.lit(3)).alias("file_id"), "field", "is_custom", "values", side.alias("__side"))
    mine = F.max(F.when(F.col("__side") == "s", F.col("values")))
    maps = maps.groupBy("file_id", "field", "is_custom").agg(mine.alias("values"), F.bool_or(F.col("__side") == "d").alias("__has"))
    return selected(maps.where("not __has and values is not null").drop("__has"), None, options)


def merge(left: DataFrame, right: DataFrame, overwrite: bool = True) -> DataFrame:
    """Two tag maps as one: where both have a field, right wins if overwrite, else left. One aggregation, no join."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1))).where(F.size("values") > 0)
    best = F.max_by if overwrite else F.min_by
    return both.groupBy("file_id", "field", "is_custom").agg(best("values", "__side").alias("values"))


def merge_pictures(left: Column | str, right: Column | str, overwrite: bool = True) -> Column:
    """Two arrays of pictures as one: right unless empty, or else those of right that left lacks put behind it."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.array()) for x in (left, right))
    return F.when(F.size(b) > 0, b).otherwise(a) if overwrite else F.array_union(a, b)
