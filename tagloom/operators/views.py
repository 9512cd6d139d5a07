"""Friendly views: tag items under the plain names of the easy key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.plans import dims

#: Patterns that friendly ID3 keys may follow besides the table, in the order in which they are tried.
MUSICBRAINZ = "http://musicbrainz.org"
PATTERNS = ("performer:*", "replaygain_*_gain", "replaygain_*_peak", "musicbrainz_*", "website:*")


#: Fixed value: cap on names that may be registered.
MAX_NAMES = 1024


def _registered(extra: dict[str, str] | None) -> dict[str, str]:
    if extra and len(extra) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names")
    return extra or {}


def easy_id3(items: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(file_id, name, values) of ID3 items; extra registers more names as name to frame for this call.

    Table first, then the rest of TXXX under its description in lower case. date falls back to TYER, then TDAT;
    genre is read as a list; comments and lyrics match by their frame id. The pairs of TMCL are 'performer:role'.
    """
    table = dims.EASY_ID3 | _registered(extra)
    known = items.sparkSession.createDataFrame([(k, n, 0) for n, k in table.items()] + [("TYER", "date", 1), ("TDAT", "date", 2), (f"UFID:{MUSICBRAINZ}", "musicbrainz_trackid", 0)], "frame string, name string, choice int")
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("values") / 2).cast("int")), lambda i: F.struct(F.element_at("values", 2 * i - 1).alias("role"), F.element_at("values", 2 * i).alias("who")))
    cast = items.where((F.col("key") == "TMCL") & (F.size("values") > 1)).select("file_id", F.posexplode(pairs).alias("n", "p"))
    cast = cast.groupBy("file_id", F.concat(F.lit("performer:"), "p.role").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "p.who"))), lambda x: x["who"]).alias("values"))
    frame = F.when(F.col("key").rlike("^(COMM|USLT|WOAR):"), F.substr(F.col("key"), F.lit(1), F.lit(4))).otherwise(F.col("key"))
    rows = items.withColumn("frame", frame).join(F.broadcast(known), "frame", "left")  # under 100 rows and the caller's
    other = F.when(F.col("key").startswith("TXXX:"), S.ascii_lower(F.substr(F.col("key"), F.lit(6))))
    rows = rows.withColumn("name", F.coalesce("name", other)).withColumn("choice", F.coalesce("choice", F.lit(9))).where("name is not null")
    values = F.when(F.col("name") == "genre", F.flatten(F.transform("values", S.genre_list))).otherwise(F.col("values"))
    return rows.groupBy("file_id", "name").agg(F.min_by(values, F.struct("choice", "key")).alias("values")).unionByName(cast)


def easy_mp4(items: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """(file_id, name, values) of MP4 items; keys outside of the table aren't shown."""
    table = dims.EASY_MP4 | _registered(extra)
    known = items.sparkSession.createDataFrame([(S.ascii_fold(k) if k.startswith("----:") else k, n) for n, k in table.items()], "atom string, name string")
    atom = F.when(F.col("key").startswith("----:"), S.ascii_lower("key")).otherwise(F.col("key"))
    rows = items.withColumn("atom", atom).join(F.broadcast(known), "atom")  # under 50 rows and the caller's
    return rows.groupBy("file_id", "name").agg(F.min_by("values", "key").alias("values"))


def matching(view: DataFrame, pattern: str) -> DataFrame:
    """Rows of a view whose name fits a shell pattern."""
    return view.where(S.fnmatch("name", pattern))


def easy_mp3(audio: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """easy_id3() of the MP3 files among parsed rows."""
    return easy_id3(_items(audio, "MP3"), extra)


def easy_m4a(audio: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """easy_mp4() of the MP4 files among parsed rows."""
    return easy_mp4(_items(audio, "MP4"), extra)


def _items(audio: DataFrame, fmt: str) -> DataFrame:
    rows = audio.where(F.col("format") == fmt).select(F.col("path").alias("file_id"), F.explode("items").alias("x"))
    return rows.select("file_id", "x.ordinal", "x.key", "x.values")
