"""Tag items derived from the star-schema tables: the same scalar expressions for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_YEAR = "concat('19', cast(40 + p_size as string))"
_GENRE = "case p_size % 4 when 0 then '(17)' when 1 then '(17)(18)' when 2 then concat('(52)', p_type) else cast(p_size as string) end"
_TRACK = "case when p_size % 5 = 0 then concat('x/', cast(p_size as string)) else concat('0', cast(p_size as string), '/50') end"

#: By system: (key, expressions of its values, condition under which a part has it) over part's columns.
ITEMS: dict[str, list[tuple[str, list[str], str]]] = {
    "ID3v2": [
        ("COMM::eng", ["p_type", "p_brand"], "true"), ("TALB", ["p_type"], "true"), ("TCON", [_GENRE], "p_size % 7 > 0"), ("TCON", [_GENRE, "p_brand"], "p_size % 7 = 0"), ("TDRC", [_YEAR], "true"), ("TENC", [], "p_size % 2 = 1"), ("TIT2", ["p_name"], "true"), ("TPE1", ["p_brand", "p_name"], "true"),
        ("TPOS", ["concat(' 0', cast(p_size % 3 as string), ' / 3 ')"], "true"), ("TPUB", ["p_brand"], "p_size % 3 = 0"), ("TRCK", [_TRACK], "true"), ("TSSE", ["p_type"], "p_size % 4 = 0"), ("TXXX:Barcode", ["cast(p_partkey as string)"], "true"), ("TXXX:LABEL", ["p_name"], "p_size % 6 = 0"), ("TXXX:Mood of day", ["p_type"], "true"), ("TYER", [f"concat({_YEAR}, '-05')"], "p_size % 2 = 0"),
    ],
    "VorbisComment": [
        ("ALBUM", ["p_type"], "true"), ("Artist", ["p_brand", "p_name"], "p_size % 2 = 0"), ("Artist", ["p_name", "p_brand"], "p_size % 2 = 1"), ("DISCNUMBER", ["cast(p_size % 3 as string)"], "true"), ("DISCTOTAL", ["'3'"], "true"), ("barcode", ["cast(p_partkey as string)"], "p_size % 3 > 0"), ("date", [_YEAR], "true"), ("genre", ["'Rock'", "p_type"], "true"), ("mood of day", ["p_type"], "true"), ("organization", ["p_brand"], "true"), ("title", ["case when p_size % 3 = 0 then upper(p_name) else p_name end"], "true"), ("totaltracks", ["'50'"], "true"), ("tracknumber", ["cast(p_size as string)"], "true"),
    ],
    "MP4": [
        ("----:COM.apple.iTunes:isrc", ["concat('US', cast(p_partkey as string))"], "true"), ("----:com.apple.iTunes:Songwriter", ["p_brand"], "p_size % 2 = 0"), ("cpil", ["case when p_size % 2 = 0 then 'true' else 'false' end"], "true"), ("disk", ["concat(cast(p_size % 3 as string), '/3')"], "true"), ("trkn", ["cast(p_size as string)"], "true"), ("©ART", ["p_brand"], "true"), ("©alb", ["p_type"], "true"), ("©day", [_YEAR], "true"), ("©gen", ["p_type"], "true"), ("©nam", ["p_name"], "true"), ("©too", ["p_brand"], "p_size % 5 = 0"), ("©xyz", ["p_type"], "true"),
    ],
    "APEv2": [
        ("ALBUM artist", ["p_brand"], "true"), ("Date", [f"concat({_YEAR}, '-01-02')"], "p_size % 2 = 0"), ("Disc", ["' 1/2'"], "true"), ("Genre", ["p_type", "p_brand"], "true"), ("Label", ["p_brand"], "p_size % 4 > 0"), ("Mood", ["p_type"], "true"), ("Rating", ["cast(p_size as string)"], "true"), ("Title", ["p_name"], "true"), ("Track", [_TRACK], "true"), ("Year", [_YEAR], "true"), ("artist", ["p_brand", "p_name"], "true"),
    ],
    "ASF": [
        ("Author", ["p_brand"], "true"), ("Copyright", ["p_type"], "true"), ("Is_Protected", ["'false'"], "true"), ("TITLE", ["p_name"], "true"), ("WM/PartOfSet", ["cast(p_size % 3 as string)"], "true"), ("WM/TrackNumber", ["cast(p_size as string)"], "true"), ("WM/Year", [_YEAR], "true"), ("wm/genre", ["p_type"], "true"), ("wm/trackcount", ["'50'"], "true"),
    ],
}


def items(spark: SparkSession, sf_dir: str, system: str, where: str = "true") -> DataFrame:
    """(file_id, ordinal, key, values, system): a file per part."""
    rows = [F.when(F.expr(cond), F.struct(F.lit(key).alias("key"), F.array(*[F.expr(v) for v in values]).cast("array<string>").alias("values"))) for key, values, cond in ITEMS[system]]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where(where)
    out = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.posexplode(F.array_compact(F.array(*rows))).alias("ordinal", "x"))
    return out.select("file_id", "ordinal", "x.key", "x.values", F.lit(system).alias("system"))


def items_sql(system: str, where: str = "true") -> str:
    """The same rows (file_id, ordinal, key, vals, system) as SQL."""
    rows = [f"case when {cond} then {{'key': '{key}', 'vals': [{', '.join(values)}]::varchar[]}} end" for key, values, cond in ITEMS[system]]
    return f"(select file_id, ordinal, x.key as key, x.vals as vals, '{system}' as system from (select file_id, unnest(l) as x, generate_subscripts(l, 1) - 1 as ordinal from (select 'p' || p_partkey as file_id, list_filter([{', '.join(rows)}], lambda x: x is not null) as l from part where {where})))"
