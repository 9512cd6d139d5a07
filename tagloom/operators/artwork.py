"""Pictures of parsed files, and pictures kept in Vorbis comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PICTURE = "struct<mime_type:string,picture_type:int,description:string,data:string>"
#: The comment that holds a FLAC picture block in base64.
BLOCK = "metadata_block_picture"
# Names of picture types by number, from 0.
TYPES = [
    "Other", "File icon", "Other file icon", "Front cover", "Back cover", "Leaflet page", "Media", "Lead artist", "Artist", "Conductor", "Band", "Composer", "Lyricist", "Recording location",
    "During recording", "During performance", "Screen capture", "A bright coloured fish", "Illustration", "Band logo", "Publisher logo",
]


def image_type(data: Column | str) -> Column:
    """The MIME type that an image's first bytes speak for, null if unknown."""
    head = F.hex(F.substring(F.col(data) if isinstance(data, str) else data, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("47494638"), "image/gif").when(head.startswith("424D"), "image/bmp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def type_name(number: Column | str) -> Column:
    return F.try_element_at(F.array(*map(F.lit, TYPES)), (F.col(number) if isinstance(number, str) else number).cast("int") + 1)


def pictures(audio: DataFrame) -> DataFrame:
    """(path, ordinal, mime_type, picture_type, description, data) of every picture of parsed rows; the type of the bytes where none is told."""
    rows = audio.select("path", F.posexplode(F.from_json(F.get_json_object("extra", "$.pictures"), f"array<{PICTURE}>")).alias("ordinal", "p"))
    data = F.unbase64("p.data")
    return rows.select("path", "ordinal", F.coalesce(F.nullif("p.mime_type", F.lit("")), image_type(data)).alias("mime_type"), F.coalesce("p.picture_type", F.lit(0)).alias("picture_type"), F.col("p.description").alias("description"), data.alias("data"))


def covers(audio: DataFrame) -> DataFrame:
    """One picture per file: the front cover, or else the first."""
    first = F.min_by(F.struct("mime_type", "picture_type", "description", "data"), F.struct(F.col("picture_type") != 3, "ordinal"))
    return pictures(audio).groupBy("path").agg(first.alias("p")).select("path", "p.*")


def block(mime: Column | str, kind: Column | str, description: Column | str, data: Column | str) -> Column:
    """A FLAC picture block (dimensions left 0) in base64, as a comment's value."""
    m, k, d, x = (F.col(c) if isinstance(c, str) else c for c in (mime, kind, description, data))
    number = lambda n: F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0"))
    sized = lambda b: F.concat(number(F.octet_length(b)), b)
    return F.base64(F.concat(number(k), sized(F.encode(m, "utf-8")), sized(F.encode(d, "utf-8")), F.unhex(F.lit("00" * 16)), sized(x)))


def _is_block(key: Column) -> Column:
    return F.lower(key) == BLOCK


def add_pictures(items: DataFrame, new: DataFrame) -> DataFrame:
    """Vorbis items with new pictures (file_id, mime_type, picture_type, description, data) behind those they have."""
    lists = new.groupBy("file_id").agg(F.sort_array(F.collect_list(block("mime_type", "picture_type", "description", "data"))).alias("added"))
    old = items.where(_is_block(F.col("key"))).select("file_id", "ordinal", "values")
    both = lists.join(old, "file_id", "full_outer")
    rows = both.select("file_id", "ordinal", F.lit(BLOCK).alias("key"), F.concat(F.coalesce("values", F.array().cast("array<string>")), F.coalesce("added", F.array().cast("array<string>"))).alias("values"))
    return items.where(~_is_block(F.col("key"))).select("file_id", "ordinal", "key", "values").unionByName(rows)


def clear_pictures(items: DataFrame) -> DataFrame:
    return items.where(~_is_block(F.col("key")))
