"""Queries over the tables at hand, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import artwork, convert, detect, diff, midi, render, replaygain, views
from tagloom.operators import items as I
from tagloom.plans import dims
from tagloom.plans.samples import items, items_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def flat(values: Column | str = "values") -> Column:
    return F.array_join(values, "\x1f")


def _flat(values: str = "vals") -> str:
    return f"array_to_string({values}, chr(31))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- dictionary verbs ------------------------------------------------------------------------------------------------


@register("items_unpivot", f"select file_id, ordinal::int as ordinal, key, {_flat()} as vals from {items_sql('ID3v2')}")
def _(spark, d):
    wide = I.pivot(items(spark, d, "ID3v2").drop("system"))
    return I.unpivot(wide).select("file_id", "ordinal", "key", flat().alias("vals"))


SQL["items_unpivot"] = f"select file_id, (row_number() over (partition by file_id order by key) - 1)::int as ordinal, key, {_flat()} as vals from {items_sql('ID3v2')}"


@register("items_pivot", f"select file_id, string_agg(key || '=' || {_flat()}, ';' order by key) as tags from {items_sql('VorbisComment')} group by file_id")
def _(spark, d):
    wide = I.pivot(items(spark, d, "VorbisComment").drop("system"))
    return wide.select("file_id", F.array_join(F.transform(F.array_sort(F.map_keys("tags")), lambda k: F.concat(k, F.lit("="), F.array_join(F.element_at("tags", k), "\x1f"))), ";").alias("tags"))


@register("dict_get_first", f"select file_id, vals[1] as value from {items_sql('ID3v2')} where key = 'TPE1'")
def _(spark, d):
    return I.get_first(items(spark, d, "ID3v2"), "TPE1")


@register("dict_get_or", f"select f.file_id, coalesce({_flat('i.vals')}, 'none') as vals from (select distinct file_id from {items_sql('ID3v2')}) f left join (select * from {items_sql('ID3v2')} where key = 'TPUB') i using (file_id)")
def _(spark, d):
    rows = items(spark, d, "ID3v2")
    return I.get_or(rows, rows, "TPUB", ["none"]).select("file_id", flat().alias("vals"))


@register("dict_contains", f"select file_id, bool_or(key = 'TYER') as found from {items_sql('ID3v2')} group by file_id")
def _(spark, d):
    return I.contains(items(spark, d, "ID3v2"), "TYER")


@register("dict_count", f"select file_id, count(distinct key) as n_keys from {items_sql('APEv2')} group by file_id")
def _(spark, d):
    return I.count(items(spark, d, "APEv2"))


def _changes(rows: DataFrame) -> DataFrame:
    new = F.array(
        F.struct(F.lit(0).alias("ordinal"), F.lit("TIT2").alias("key"), F.array(F.lit("first")).alias("values")),
        F.struct(F.lit(1).alias("ordinal"), F.lit("TIT2").alias("key"), F.array(F.lit("new"), F.col("file_id")).alias("values")),
        F.struct(F.lit(2).alias("ordinal"), F.lit("TALB").alias("key"), F.array().cast("array<string>").alias("values")),
        F.struct(F.lit(3).alias("ordinal"), F.lit("TKEY").alias("key"), F.array(F.lit("Am")).alias("values")),
    )
    return rows.select("file_id").distinct().select("file_id", F.explode(new).alias("x")).select("file_id", "x.ordinal", "x.key", "x.values")


_UPDATED = f"select file_id, key, {_flat()} as vals from {items_sql('ID3v2')} where key not in ('TIT2', 'TALB') and len(vals) > 0 union all select distinct file_id, 'TIT2', 'new' || chr(31) || file_id from {items_sql('ID3v2')} union all select distinct file_id, 'TKEY', 'Am' from {items_sql('ID3v2')}"


@register("dict_update", f"select file_id, (row_number() over (partition by file_id order by key) - 1)::int as ordinal, key, vals from ({_UPDATED})")
def _(spark, d):
    rows = items(spark, d, "ID3v2").drop("system")
    return I.update(rows, _changes(rows)).select("file_id", "ordinal", "key", flat().alias("vals"))


@register("dict_remove", f"select file_id, key, {_flat()} as vals from {items_sql('MP4')} where key not in ('©nam', 'trkn')")
def _(spark, d):
    return I.remove(items(spark, d, "MP4"), "©nam", "trkn").select("file_id", "key", flat().alias("vals"))


@register("dict_pop", f"select file_id, min(key) as key, {_flat('min_by(vals, key)')} as vals from {items_sql('ID3v2')} where key = 'TXXX' or starts_with(key, 'TXXX:') group by file_id")
def _(spark, d):
    return I.pop(items(spark, d, "ID3v2"), "TXXX")[0].select("file_id", "key", flat().alias("vals"))


@register("dict_popitem_rest", f"select file_id, key, {_flat()} as vals from (select *, row_number() over (partition by file_id order by key) as n from {items_sql('ASF')}) where n > 1")
def _(spark, d):
    return I.popitem(items(spark, d, "ASF"))[1].select("file_id", "key", flat().alias("vals"))


@register("dict_setdefault", f"select file_id, key, {_flat()} as vals from {items_sql('ID3v2')} union all select file_id, 'TPUB', 'unknown' from {items_sql('ID3v2')} group by file_id having not bool_or(key = 'TPUB')")
def _(spark, d):
    rows = items(spark, d, "ID3v2").drop("system")
    extra = rows.select("file_id").distinct().select("file_id", F.lit(None).cast("int").alias("ordinal"), F.lit("TPUB").alias("key"), F.array(F.lit("unknown")).alias("values"))
    return I.setdefault(rows, extra).select("file_id", "key", flat().alias("vals"))


@register("id3_getall_prefix", f"select file_id, key, {_flat()} as vals from {items_sql('ID3v2')} where key = 'TXXX' or starts_with(key, 'TXXX:')")
def _(spark, d):
    return I.getall(items(spark, d, "ID3v2"), "TXXX").select("file_id", "key", flat().alias("vals"))


@register("id3_delall", f"select file_id, key, {_flat()} as vals from {items_sql('ID3v2')} where not (key = 'COMM' or starts_with(key, 'COMM:'))")
def _(spark, d):
    return I.delall(items(spark, d, "ID3v2"), "COMM").select("file_id", "key", flat().alias("vals"))


@register("id3_merge_frames", "select 'c' || c_nationkey as file_id, c_mktsegment as key, string_agg(c_name || '/' || c_custkey, '/' order by c_custkey) as vals from customer group by all")
def _(spark, d):
    rows = _table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("file_id"), F.col("c_custkey").cast("int").alias("ordinal"), F.col("c_mktsegment").alias("key"), F.array("c_name", F.col("c_custkey").cast("string")).alias("values"))
    return I.merge_frames(rows, "/").select("file_id", "key", flat().alias("vals"))


@register("common_fields", f"select file_id, max(case when lower(key) = 'artist' then vals[1] end) as artist, max(case when lower(key) = 'album' then vals[1] end) as album, max(case when lower(key) = 'title' then vals[1] end) as title, max(case when lower(key) = 'tracknumber' then vals[1] end) as track_number, max(case when lower(key) = 'date' then vals[1] end) as date, max(case when lower(key) = 'genre' then vals[1] end) as genre from {items_sql('VorbisComment')} group by file_id")
def _(spark, d):
    return I.common_fields(items(spark, d, "VorbisComment"))


@register("tag_budget", "select 'd' || source as file_id, count(*) as entries, sum(strlen(lang) + coalesce(strlen(text), 0))::bigint as bytes, count(*) <= 10000 and sum(strlen(lang) + coalesce(strlen(text), 0)) <= 50000000 as ok from documents group by source")
def _(spark, d):
    rows = _table(spark, d, "documents").select(F.concat(F.lit("d"), "source").alias("file_id"), F.col("lang").alias("key"), F.array(F.coalesce("text", F.lit(""))).alias("values"))
    return I.byte_budget(rows)


# ---- conversion ------------------------------------------------------------------------------------------------------

_READ = ", ".join(f"({_text(s)}, {_text(k)}, {_text(f)})" for s in dims.SYSTEMS for k, f in dims.read_keys(s))
_WRITE = ", ".join(f"({_text(s)}, {_text(f)}, {_text(k)})" for s in dims.SYSTEMS for f, k in dims.write_keys(s).items())
_GENRES = "[" + ", ".join(map(_text, dims.GENRES)) + "]"
_NORM = "case system when 'ID3v2' then case when starts_with(key, 'TXXX:') then 'TXXX:' || lower(substr(key, 6)) when substr(key, 5, 1) = ':' then substr(key, 1, 4) else key end when 'VorbisComment' then upper(key) when 'MP4' then case when starts_with(key, '----:') then lower(key) else key end else lower(key) end"


def _mapped(rows: str) -> str:
    return f"(select i.*, m.field from (select *, {_NORM} as nk from {rows}) i left join (values {_READ}) as m(s, k, field) on i.system = m.s and i.nk = m.k)"


def _num(x: str) -> str:
    return f"case when regexp_full_match(trim({x}), '[0-9]+') then coalesce(nullif(ltrim(trim({x}), '0'), ''), '0') end"


def _genre(x: str) -> str:
    groups = rf"regexp_extract(trim({x}), '^((\([0-9]+\))+)', 1)"
    name = f"coalesce({_GENRES}[n::int + 1], n::int::varchar)"
    names = rf"list_transform(regexp_extract_all({groups}, '\(([0-9]+)\)', 1), lambda n: {name})"
    rest = f"trim(substr(trim({x}), length({groups}) + 1))"
    bare = f"case when regexp_full_match(trim({x}), '[0-9]+') then coalesce({_GENRES}[try_cast(trim({x}) as int) + 1], trim({x})) else trim({x}) end"
    return f"case when {groups} <> '' then case when {rest} = '' then array_to_string({names}, '/') else array_to_string(list_append({names}[:-2], {rest}), '/') end else {bare} end"


def _extracted(rows: str) -> str:
    """(file_id, field, is_custom, vals) of items in SQL."""
    custom = "case system when 'ID3v2' then 'id3' when 'VorbisComment' then 'vorbis' when 'MP4' then 'mp4' when 'APEv2' then 'ape' else 'asf' end || ':' || key"
    genre = f"case when system = 'ID3v2' then list_transform(vals, lambda g: {_genre('g')}) else vals end"
    split = "system in ('ID3v2', 'APEv2', 'MP4')"
    one = lambda field, vals, cond, own="0", order="ordinal": f"select file_id, {field} as field, false as is_custom, {vals} as vals, {own} as own, {order} as o from b where {cond}"
    parts = [
        f"select file_id, {custom} as field, true as is_custom, vals, 0 as own, ordinal as o from b where field is null",
        *[one(f"'{f}'", f"[{_num(side)}]", f"{split} and field = '{of}' and {_num(side)} is not null") for of, f, side in (("TrackNumber", "TrackNumber", "split_part(vals[1], '/', 1)"), ("TrackNumber", "TotalTracks", "substr(vals[1], length(split_part(vals[1], '/', 1)) + 2)"), ("DiscNumber", "DiscNumber", "split_part(vals[1], '/', 1)"), ("DiscNumber", "TotalDiscs", "substr(vals[1], length(split_part(vals[1], '/', 1)) + 2)"))],
        one("field", f"case when len(vals) > 1 then [array_to_string({genre}, ', ')] else {genre} end", "field = 'Genre'"),
        *[one(f"'{b}'", "vals", f"field = '{a}'", "-1") for x, y in convert.TWINS for a, b in ((x, y), (y, x))],
        one("field", "vals", "field = 'Date'", "strlen(vals[1])", "-ordinal"),
        one("field", "vals", f"field is not null and field not in ('Genre', 'Date') and not ({split} and field in ('TrackNumber', 'DiscNumber'))"),
    ]
    return f"(with b as (select * from {_mapped(rows)} where len(vals) > 0), p as ({' union all '.join(parts)}) select file_id, field, is_custom, vals from (select *, row_number() over (partition by file_id, field, is_custom order by own desc, o desc) as n from p) where n = 1)"


for _system in dims.SYSTEMS:

    @register(f"map_{_system.lower()}", f"select file_id, key, field from {_mapped(items_sql(_system))}")
    def _(spark, d, system=_system):
        return convert.to_fields(items(spark, d, system)).select("file_id", "key", "field")

    @register(f"extract_{_system.lower()}", f"select file_id, field, is_custom, {_flat()} as vals from {_extracted(items_sql(_system))}")
    def _(spark, d, system=_system):
        return convert.extract(items(spark, d, system)).select("file_id", "field", "is_custom", flat().alias("vals"))


def _both_sql() -> str:
    return f"(select * from {items_sql('ID3v2', 'p_partkey % 2 = 0')} union all select * from {items_sql('APEv2', 'p_partkey % 2 = 1')})"


@register("detect_system_from_keys", f"select file_id, case when count(*) filter (regexp_full_match(key, '[A-Z0-9]{{4}}')) > count(*) // 2 and bool_or(key in ({', '.join(map(_text, dims.KNOWN_FRAMES))})) then 'ID3v2' else 'APEv2' end as system from {_both_sql()} group by file_id")
def _(spark, d):
    return convert.system_from_keys(items(spark, d, "ID3v2", "p_partkey % 2 = 0").unionByName(items(spark, d, "APEv2", "p_partkey % 2 = 1")))


_STRIP = r"case when starts_with(regexp_replace(field, '^(id3|vorbis|mp4|ape|asf|unknown):', ''), 'TXXX:') then substr(regexp_replace(field, '^(id3|vorbis|mp4|ape|asf|unknown):', ''), 6) when starts_with(regexp_replace(field, '^(id3|vorbis|mp4|ape|asf|unknown):', ''), '----:') then regexp_replace(substr(regexp_replace(field, '^(id3|vorbis|mp4|ape|asf|unknown):', ''), 6), '^[^:]*:', '') else regexp_replace(field, '^(id3|vorbis|mp4|ape|asf|unknown):', '') end"


def _applied(tag_map: str, system: str) -> str:
    """(file_id, field, is_custom, key, vals, status) of a tag map in SQL."""
    keys = f"(select f, k from (values {_WRITE}) as w(s, f, k) where s = '{system}')"
    wrap = {"ID3v2": "'TXXX:' || ", "MP4": f"'{dims.MP4_SPACE}' || "}.get(system, "")
    custom = f"select file_id, field, true as is_custom, {wrap}bare as key, vals, 'custom' as status from (select *, {_STRIP} as bare from {tag_map} where is_custom) where not regexp_matches(lower(bare), '^apic|picture|cover art|^rva2')"
    pairs = "('TrackNumber', 'TotalTracks', 'DiscNumber', 'TotalDiscs')"
    joined = f"select t.file_id, t.field, false as is_custom, w.k as key, t.vals, case when w.k is null then 'skipped' else 'transferred' end as status from {tag_map} t left join {keys} w on t.field = w.f where not t.is_custom"
    if system in ("VorbisComment", "ASF"):
        return f"({joined} and not (w.k is null and t.field in {pairs}) union all {custom})"
    both = f"(select file_id, case when field in ('TrackNumber', 'TotalTracks') then 'TrackNumber' else 'DiscNumber' end as f, max(case when field in ('TrackNumber', 'DiscNumber') then vals[1] end) as n, max(case when field in ('TotalTracks', 'TotalDiscs') then vals[1] end) as t from {tag_map} where not is_custom and field in {pairs} group by 1, 2)"
    text = "[case when t is null then n else coalesce(n, '0') || '/' || t end]"
    number = f"select file_id, f as field, false, k, {text}, 'transferred' from {both} join {keys} using (f) where n is not null"
    total = f"select file_id, case f when 'TrackNumber' then 'TotalTracks' else 'TotalDiscs' end, false, case when n is null then k end, case when n is null then {text} end, 'transferred' from {both} join {keys} using (f) where t is not null"
    return f"({joined} and t.field not in {pairs} union all {number} union all {total} union all {custom})"


for _source, _target in (("VorbisComment", "ID3v2"), ("ID3v2", "VorbisComment"), ("ID3v2", "MP4"), ("MP4", "APEv2"), ("APEv2", "ASF"), ("ASF", "ID3v2")):

    @register(f"apply_{_source.lower()}_to_{_target.lower()}", f"select file_id, field, is_custom, key, {_flat()} as vals, status from {_applied(_extracted(items_sql(_source)), _target)}")
    def _(spark, d, source=_source, target=_target):
        return convert.apply(convert.extract(items(spark, d, source)), target).select("file_id", "field", "is_custom", "key", flat().alias("vals"), "status")


@register("convert_report", f"select file_id, coalesce(string_agg(case when status = 'transferred' then field end, ',' order by field), '') as transferred, coalesce(string_agg(case when status = 'custom' then field end, ',' order by field), '') as custom, coalesce(string_agg(case when status = 'skipped' then field end, ',' order by field), '') as skipped from {_applied(_extracted(items_sql('VorbisComment')), 'MP4')} group by file_id")
def _(spark, d):
    out = convert.report(convert.apply(convert.extract(items(spark, d, "VorbisComment")), "MP4"))
    return out.select("file_id", F.array_join("transferred", ",").alias("transferred"), F.array_join("custom_transferred", ",").alias("custom"), F.array_join("skipped", ",").alias("skipped"))


def _moved(spark: SparkSession, d: str, options: convert.Options) -> DataFrame:
    new, _ = convert.convert(items(spark, d, "ID3v2"), items(spark, d, "VorbisComment"), "VorbisComment", options)
    return new.select("file_id", "key", flat().alias("vals"))


def _moved_sql(where: str = "true", clear: bool = False, keep: bool = False) -> str:
    source, old = _extracted(items_sql("ID3v2")), items_sql("VorbisComment")
    chosen = f"(select * from {source} s where {where}" + (f" and not exists (select 1 from {_extracted(old)} x where x.file_id = s.file_id and x.field = s.field and x.is_custom = s.is_custom)" if keep else "") + ")"
    new = f"(select file_id, key, max_by(vals, field) as vals from {_applied(chosen, 'VorbisComment')} where key is not null group by file_id, key)"
    if clear:
        return f"select file_id, key, {_flat()} as vals from {new}"
    return f"select file_id, key, {_flat()} as vals from {new} union all select file_id, key, {_flat()} from {old} o where not exists (select 1 from {new} n where n.file_id = o.file_id and n.key = o.key)"


@register("convert_include", _moved_sql("is_custom or field in ('Title', 'Artist', 'TrackNumber')"))
def _(spark, d):
    return _moved(spark, d, convert.Options(include_fields=("Title", "Artist", "TrackNumber")))


@register("convert_exclude", _moved_sql("not is_custom and field not in ('Title', 'Comment')"))
def _(spark, d):
    return _moved(spark, d, convert.Options(exclude_fields=("Title", "Comment"), transfer_custom=False))


@register("convert_no_overwrite", _moved_sql(keep=True))
def _(spark, d):
    return _moved(spark, d, convert.Options(overwrite=False))


@register("convert_clear", _moved_sql(clear=True))
def _(spark, d):
    return _moved(spark, d, convert.Options(clear_destination=True))


for _name, _over in (("merge_overwrite", True), ("merge_keep", False)):

    @register(_name, f"select coalesce(a.file_id, b.file_id) as file_id, coalesce(a.field, b.field) as field, coalesce(a.is_custom, b.is_custom) as is_custom, {_flat('coalesce(b.vals, a.vals)' if _over else 'coalesce(a.vals, b.vals)')} as vals from {_extracted(items_sql('ID3v2'))} a full join {_extracted(items_sql('APEv2'))} b on a.file_id = b.file_id and a.field = b.field and a.is_custom = b.is_custom")
    def _(spark, d, over=_over):
        a, b = (convert.extract(items(spark, d, s)) for s in ("ID3v2", "APEv2"))
        return convert.merge(a, b, over).select("file_id", "field", "is_custom", flat().alias("vals"))


# ---- differences -----------------------------------------------------------------------------------------------------


def _perturbed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as tag items, and a changed copy of them."""
    c = _table(spark, d, "customer")
    left = F.array(F.struct(F.lit("Name").alias("key"), F.array("c_name").alias("values")), F.struct(F.lit("name").alias("key"), F.array(F.concat(F.lit(" "), "c_mktsegment")).alias("values")), F.struct(F.lit("Segment").alias("key"), F.array("c_mktsegment", "c_name").alias("values")), F.struct(F.lit("nation").alias("key"), F.array(F.col("c_nationkey").cast("string")).alias("values")))
    right = F.array(F.struct(F.lit("Name").alias("key"), F.array("c_name").alias("values")), F.struct(F.lit("name").alias("key"), F.array(F.concat("c_mktsegment", F.lit("\t"))).alias("values")), F.struct(F.lit("segment").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", "c_name")).otherwise(F.array("c_name", "c_mktsegment")).alias("values")), F.struct(F.concat(F.lit("extra"), F.col("c_custkey") % 3).alias("key"), F.array(F.lit("x")).alias("values")))
    side = lambda x: c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("file_id"), F.posexplode(x).alias("ordinal", "x")).select("file_id", "ordinal", "x.key", "x.values")
    return side(left), side(right)


_ID = "'c' || c_custkey"
_LEFT = f"(select {_ID} as file_id, 0 as o, 'Name' as key, [c_name] as vals from customer union all select {_ID}, 1, 'name', [' ' || c_mktsegment] from customer union all select {_ID}, 2, 'Segment', [c_mktsegment, c_name] from customer union all select {_ID}, 3, 'nation', [c_nationkey::varchar] from customer)"
_RIGHT = f"(select {_ID} as file_id, 0 as o, 'Name' as key, [c_name] as vals from customer union all select {_ID}, 1, 'name', [c_mktsegment || chr(9)] from customer union all select {_ID}, 2, 'segment', case when c_custkey % 2 = 0 then [c_mktsegment, c_name] else [c_name, c_mktsegment] end from customer union all select {_ID}, 3, 'extra' || c_custkey % 3, ['x'] from customer)"


def _diff_sql(left: str = _LEFT, right: str = _RIGHT, lower: bool = False, trim: bool = False, where: str = "true", unchanged: bool = False) -> str:
    key, vals = ("lower(key)" if lower else "key"), ("list_transform(vals, lambda v: trim(v, chr(9) || ' '))" if trim else "vals")
    side = lambda x: f"(select file_id, key, flatten(list(vals order by o)) as vals from (select file_id, o, {key} as key, {vals} as vals from {x}) where {where} group by file_id, key)"
    rows = f"(select coalesce(a.file_id, b.file_id) as file_id, coalesce(a.key, b.key) as key, case when a.vals is null then 'right_only' when b.vals is null then 'left_only' when a.vals = b.vals then 'unchanged' else 'changed' end as status, a.vals as l, b.vals as r from {side(left)} a full join {side(right)} b on a.file_id = b.file_id and a.key = b.key)"
    return f"select file_id, key, status, {_flat('l')} as l, {_flat('r')} as r from {rows}" + ("" if unchanged else " where status <> 'unchanged'")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "key", "status", flat("left").alias("l"), flat("right").alias("r"))


for _name, _options, _sql in (
    ("diff_items", diff.Options(), _diff_sql()),
    ("diff_unchanged", diff.Options(include_unchanged=True), _diff_sql(unchanged=True)),
    ("diff_ci_keys", diff.Options(case_insensitive_keys=True, include_unchanged=True), _diff_sql(lower=True, unchanged=True)),
    ("diff_trim", diff.Options(trim_values=True), _diff_sql(trim=True)),
    ("diff_include", diff.Options(include_keys=("Name", "segment")), _diff_sql(where="key in ('Name', 'segment')")),
    ("diff_exclude", diff.Options(case_insensitive_keys=True, exclude_keys=("NAME",)), _diff_sql(lower=True, where="key <> 'name'")),
):

    @register(_name, _sql)
    def _(spark, d, options=_options):
        return _shown(diff.diff(*_perturbed(spark, d), options))


@register("diff_summary", f"select file_id, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'left_only') as left_only, count(*) filter (status = 'right_only') as right_only, count(*) filter (status <> 'unchanged') as diff_count, coalesce(string_agg(case when status <> 'unchanged' then key end, ',' order by key), '') as differing_keys, count(*) filter (status <> 'unchanged') = 0 as is_identical, count(*) filter (status = 'changed') || ' changed, ' || count(*) filter (status = 'left_only') || ' removed, ' || count(*) filter (status = 'right_only') || ' added, ' || count(*) filter (status = 'unchanged') || ' unchanged' as summary from ({_diff_sql(unchanged=True)}) group by file_id")
def _(spark, d):
    out = diff.summary(diff.diff(*_perturbed(spark, d), diff.Options(include_unchanged=True)))
    return out.select("file_id", "changed", "left_only", "right_only", "diff_count", F.array_join("differing_keys", ",").alias("differing_keys"), "is_identical", "summary")


def _named(rows: str, bare: bool) -> str:
    key = f"case when is_custom then lower({_STRIP}) else field end" if bare else "field"
    return f"(select file_id, case when is_custom then field else '' end as o, {key} as key, vals from {_extracted(rows)})"


@register("diff_normalized", _diff_sql(_named(items_sql("ID3v2"), False), _named(items_sql("VorbisComment"), False), unchanged=True))
def _(spark, d):
    return _shown(diff.diff_normalized(items(spark, d, "ID3v2"), items(spark, d, "VorbisComment"), diff.Options(include_unchanged=True)))


@register("diff_custom_keys", _diff_sql(_named(items_sql("ID3v2"), True), _named(items_sql("VorbisComment"), True)))
def _(spark, d):
    return _shown(diff.diff_normalized(items(spark, d, "ID3v2"), items(spark, d, "VorbisComment"), diff.Options(normalize_custom_keys=True)))


def _streams(spark: SparkSession, d: str, right: bool) -> DataFrame:
    t = _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    far = F.when(F.col("l_orderkey") % 2 == 0, 1e-8).otherwise(0.5) if right else F.lit(0.0)
    rate = F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("q").cast("bigint")) if right else F.col("q").cast("bigint")
    return t.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("file_id"), (F.col("p") + far).alias("length_secs"), rate.alias("bitrate"), F.lit(44100).cast("bigint").alias("sample_rate"), F.when(F.col("l_orderkey") % 7 == 0, None).otherwise(2 + (F.col("l_orderkey") % 3 == 0).cast("int") * int(right)).alias("channels"), F.lit(16).alias("bits_per_sample"))


@register("stream_info_diff", "select 'o' || k as file_id, k % 2 <> 0 as length_changed, case when k % 5 = 0 then q end as bitrate_left, case when k % 3 = 0 and k % 7 <> 0 then 3 end as channels_right from (select l_orderkey as k, max(l_quantity)::bigint as q from lineitem group by 1)")
def _(spark, d):
    out = diff.stream_diff(_streams(spark, d, False), _streams(spark, d, True))
    return out.select("file_id", F.col("length_secs").isNotNull().alias("length_changed"), F.col("bitrate.left").alias("bitrate_left"), F.col("channels.right").alias("channels_right"))


# ---- scalar functions ------------------------------------------------------------------------------------------------

_RAW_TRACK = "case p_partkey % 6 when 0 then concat(cast(p_size as string), '/12') when 1 then concat('00', cast(p_size as string)) when 2 then '' when 3 then concat('  ', cast(p_size as string), ' / 010  ') when 4 then '/12' else concat(p_name, '/', cast(p_size as string)) end"


def _part(spark: SparkSession, d: str, **columns: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in columns.items()])


@register("track_disc_split", f"select p_partkey, {_num('split_part(x, chr(47), 1)')} as number, {_num('case when contains(x, chr(47)) then substr(x, length(split_part(x, chr(47), 1)) + 2) end')} as total from (select p_partkey, {_RAW_TRACK} as x from part)")
def _(spark, d):
    return _part(spark, d, x=_RAW_TRACK).select("p_partkey", S.track_disc("x")["number"].alias("number"), S.track_disc("x")["total"].alias("total"))


@register("track_disc_combine", "select p_partkey, case when p_size % 3 = 0 and p_size % 2 = 0 then '' when p_size % 2 = 0 then p_size || '' when p_size % 3 = 0 then '0/' || p_partkey else p_size || '/' || p_partkey end as text from part")
def _(spark, d):
    rows = _part(spark, d, n="case when p_size % 3 > 0 then cast(p_size as string) end", t="case when p_size % 2 > 0 then cast(p_partkey as string) end")
    return rows.select("p_partkey", S.combine_track_disc("n", "t").alias("text"))


_RAW_GENRE = "case p_partkey % 7 when 0 then concat('(', cast(p_partkey % 250 as string), ')') when 1 then concat('(17)(', cast(p_size as string), ')') when 2 then concat('(17)(18)', p_type) when 3 then cast(p_partkey % 250 as string) when 4 then concat(' ', p_name, ' ') when 5 then '' else concat('(', p_name, ')') end"


@register("genre_resolve", f"select p_partkey, {_genre('x')} as genre from (select p_partkey, {_RAW_GENRE} as x from part)")
def _(spark, d):
    return _part(spark, d, x=_RAW_GENRE).select("p_partkey", S.id3_genre("x").alias("genre"))


@register("genre_lookup", f"select p_partkey, {_GENRES}[p_partkey % 200 + 1] as name, case when p_partkey % 200 < 192 then (p_partkey % 200)::int end as number from part")
def _(spark, d):
    return _table(spark, d, "part").select("p_partkey", S.genre_name(F.col("p_partkey") % 200).alias("name"), S.genre_number(F.upper(S.genre_name(F.col("p_partkey") % 200))).alias("number"))


_RAW_BOOL = "case p_partkey % 8 when 0 then '1' when 1 then ' True ' when 2 then 'YES' when 3 then '0' when 4 then 'no' when 5 then '' when 6 then 'FALSE' else concat(' ', p_name) end"


@register("boolean_normalise", f"select p_partkey, case when lower(trim(x)) in ('1', 'true', 'yes') then '1' when lower(trim(x)) in ('0', 'false', 'no', '') then '0' else trim(x) end as value from (select p_partkey, {_RAW_BOOL} as x from part)")
def _(spark, d):
    return _part(spark, d, x=_RAW_BOOL).select("p_partkey", S.boolean("x").alias("value"))


@register("date_normalise", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as date, year(o_orderdate)::int as y, case when o_orderkey % 3 > 0 then month(o_orderdate)::int end as m, case when o_orderkey % 3 > 1 then day(o_orderdate)::int end as d from orders")
def _(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = _table(spark, d, "orders").select("o_orderkey", S.date(F.concat(F.lit(" \t"), day, F.lit("\n"))).alias("date"), S.timestamp(F.substring(day, 1, 4)).alias("y"), S.timestamp(F.when(F.col("o_orderkey") % 3 == 0, F.substr(day, F.lit(1), F.lit(4))).when(F.col("o_orderkey") % 3 == 1, F.substr(day, F.lit(1), F.lit(7))).otherwise(day)).alias("t"))
    return rows.select("o_orderkey", "date", F.col("y.year").alias("y"), F.col("t.month").alias("m"), F.col("t.day").alias("d"))


_RAW_GAIN = "case l_linenumber % 4 when 0 then concat(' ', cast(cast(l_quantity as int) as string), '.25 dB ') when 1 then concat('-', cast(cast(l_quantity as int) as string), '.5dB') when 2 then concat('+', cast(cast(l_quantity as int) as string)) else concat(cast(cast(l_quantity as int) as string), 'f dB') end"


@register("replaygain_parse", f"select l_orderkey, l_linenumber, l_partkey, try_cast(regexp_replace(trim(x), ' ?dB$', '') as float)::double as gain from (select *, {_RAW_GAIN} as x from lineitem)")
def _(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.parse_gain(F.expr(_RAW_GAIN)).cast("double").alias("gain"))


@register("replaygain_format", "select distinct l_quantity::int as q, case when q % 2 = 0 then '+' || q || '.50 dB' else '-' || q || '.25 dB' end as gain, q || '.015625' as peak from (select l_quantity, l_quantity::int as q from lineitem)")
def _(spark, d):
    q = _table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("q")).distinct()
    return q.select("q", S.format_gain(F.when(F.col("q") % 2 == 0, F.col("q") + 0.5).otherwise(-F.col("q") - 0.25).cast("float")).alias("gain"), S.format_peak((F.col("q") + 0.015625).cast("float")).alias("peak"))


@register("replaygain_adjust", "select l_orderkey, l_linenumber, l_partkey, round(pow(10, -l_quantity / 20), 5) as factor from lineitem")
def _(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.adjustment_factor(-F.col("l_quantity")).cast("double"), 5).alias("factor"))


@register("replaygain_items", "select 'p' || p_partkey as file_id, (-p_size - 0.5)::double as track_gain, case when p_size % 2 = 0 then 0.5::double end as track_peak, case when p_size % 3 = 0 then 'REPLAYGAIN_ALBUM_GAIN' else '' end as bad, round(pow(10, (-p_size - 0.5) / 20), 5) as factor, p_size % 3 = 1 as has_album from part")
def _(spark, d):
    p = _table(spark, d, "part")
    rows = F.array_compact(F.array(
        F.struct(F.lit("replaygain_track_gain").alias("key"), F.array(F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(".50 dB"))).alias("values")),
        F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("REPLAYGAIN_TRACK_PEAK").alias("key"), F.array(F.lit("0.5")).alias("values"))),
        F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("REPLAYGAIN_ALBUM_GAIN").alias("key"), F.array(F.lit("loud")).alias("values"))).when(F.col("p_size") % 3 == 1, F.struct(F.lit("REPLAYGAIN_ALBUM_GAIN").alias("key"), F.array(F.lit("1")).alias("values"))),
        F.struct(F.lit("TITLE").alias("key"), F.array("p_name").alias("values")),
    ))
    tags = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id"), F.posexplode(rows).alias("ordinal", "x")).select("file_id", "ordinal", "x.key", "x.values")
    gains = replaygain.read(tags)
    both = gains.join(replaygain.factors(gains), "file_id")
    return both.select("file_id", F.col("track_gain").cast("double").alias("track_gain"), F.col("track_peak").cast("double").alias("track_peak"), F.array_join("bad", ",").alias("bad"), F.round(F.col("track_factor").cast("double"), 5).alias("factor"), F.col("has_album_info").alias("has_album"))


@register("glob_keys", f"select file_id, key from {items_sql('ID3v2')} where regexp_full_match(key, 'T[PX].*')")
def _(spark, d):
    return items(spark, d, "ID3v2").where(S.fnmatch("key", "T[PX]*")).select("file_id", "key")


@register("padding_policy", "select o_orderkey, case when o_custkey * 20 between 0 and 10240 + floor(o_totalprice / 100)::bigint then (o_custkey * 20)::bigint else 1024 + floor(o_totalprice / 1000)::bigint end as padding from orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", S.padding(F.col("o_custkey") * 20, F.floor("o_totalprice")).alias("padding"))


@register("synchsafe", "select o_orderkey, (o_orderkey * 997 % 268435456)::bigint as n, ((n & 127) + ((n >> 7) & 127) * 256 + ((n >> 14) & 127) * 65536 + ((n >> 21) & 127) * 16777216)::bigint as coded, n as decoded from orders")
def _(spark, d):
    n = (F.col("o_orderkey") * 997 % 268435456).cast("bigint")
    return _table(spark, d, "orders").select("o_orderkey", n.alias("n"), S.synchsafe_encode(n).alias("coded"), S.synchsafe_decode(S.synchsafe_encode(n)).alias("decoded"))


@register("intround", "select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0)::bigint as n from lineitem")
def _(spark, d):
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.intround(F.col("l_quantity") / 2).alias("n"))


# ---- detection, views, MIDI ------------------------------------------------------------------------------------------

#: (name, header in hex, file name, format): cases with ties and extensions.
HEADERS = [
    ("mp4", "000000206674797049534F4D", "a.m4a", "MP4"), ("mp4b", "00000020667479704D344120", "a.bin", "MP4"), ("asf", "3026B2758E66CF11A6D900AA0062CE6C", "x", "ASF"), ("vorbis", "4F67675300" + "00" * 23 + "01766F72626973", "a.ogg", "OggVorbis"), ("opus", "4F67675300" + "00" * 23 + "4F70757348656164", "a.opus", "OggOpus"), ("speex", "4F67675300" + "00" * 23 + "5370656578202020", "a.ogg", "OggOpus"), ("speex2", "4F67675300" + "00" * 23 + "5370656578202020", "a.spx", "OggSpeex"), ("theora", "4F67675300" + "00" * 23 + "807468656F7261", "a.ogv", "OggTheora"), ("oggflac", "4F67675300" + "00" * 23 + "7F464C4143010000664C6143", "a.oga", "OggFlac"), ("ogg", "4F67675300", "a.ogg", "OggOpus"),
    ("flac", "664C6143000000", "a", "FLAC"), ("id3flac", "49443304000000000000664C6143", "a", "FLAC"), ("aiff", "464F524D0000000041494646", "a.aif", "AIFF"), ("wave", "524946460000000057415645", "a", "WAVE"), ("dff", "46524D38", "a.dff", "DSDIFF"), ("dsf", "44534420", "a.dsf", "DSF"), ("ape", "4D414320", "a.ape", "MonkeysAudio"), ("apetag", "4150455441474558", "a.ape", "MonkeysAudio"), ("apetag2", "4150455441474558", "a", "APEv2"), ("wv", "7776706B", "a.wv", "WavPack"), ("tak", "7442614B", "a.tak", "TAK"), ("tta", "54544131", "a.tta", "TrueAudio"), ("ofr", "4F465220", "a.ofr", "OptimFROG"),
    ("mp3", "FFFB9044", "a", "MP3"), ("id3", "494433040000", "a.mp3", "MP3"), ("id3only", "494433040000", "a", "MP3"), ("id3tta", "494433040000", "a.tta", "TrueAudio"), ("mpc", "4D502B07", "a.mpc", "Musepack"), ("mpc8", "4D50434B", "a", "Musepack"), ("aac", "41444946", "a.aac", "AAC"), ("adts", "FFF15080", "a", None), ("ac3", "0B770000", "a.ac3", "AC3"), ("mid", "4D546864", "a.mid", "SMF"), ("midext", "00000000", "a.kar", "SMF"), ("none", "00000000", "a.txt", None),
]


@register("detect_format_score", f"select n_nationkey, name, format from nation cross join (values {', '.join(f'({_text(n)}, {_text(f) if f else chr(39) + chr(39)})' for n, _, _, f in HEADERS)}) as h(name, format)")
def _(spark, d):
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.unhex(F.lit(h)).alias("content"), F.lit(p).alias("path")) for n, h, p, _ in HEADERS]))
    rows = _table(spark, d, "nation").select("n_nationkey", cases.alias("h")).select("n_nationkey", "h.*")
    return detect.with_format(rows).select("n_nationkey", "name", F.coalesce("format", F.lit("")).alias("format"))


def _genre_list(x: str) -> str:
    """The friendly view's reading of a genre text, a list, in SQL."""
    groups = rf"regexp_extract({x}, '^((\([^()]*\)\s*)+)', 1)"
    name = f"case when regexp_full_match(m, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{{1,2}})') then coalesce({_GENRES}[try_cast(m as int) + 1], try_cast(m as int)::varchar) else m end"
    names = rf"list_transform(list_filter(regexp_extract_all({groups}, '\(([^()]*)\)', 1), lambda m: m <> ''), lambda m: {name})"
    rest = f"trim(substr({x}, length({groups}) + 1))"
    listed = f"list_concat({names}, case when {rest} = '' then []::varchar[] else [{rest}] end)"
    plain = f"list_filter(list_transform(string_split({x}, chr(0)), lambda p: trim(p)), lambda p: p <> '')"
    return f"(case when {x} = '' then []::varchar[] when starts_with({x}, '(') and len({listed}) > 0 then {listed} when not starts_with({x}, '(') and len({plain}) > 0 then {plain} else [{x}] end)"


@register("easy_id3_view", f"select file_id, name, {_flat()} as vals from (select file_id, name, first(vals order by choice, key) as vals from (select i.file_id, i.key, case when n.name = 'genre' then flatten(list_transform(i.vals, lambda v: {_genre_list('v')})) else i.vals end as vals, coalesce(n.name, case when starts_with(i.key, 'TXXX:') then lower(substr(i.key, 6)) end) as name, coalesce(n.choice, 9) as choice from {items_sql('ID3v2')} i left join (values {', '.join(f'({_text(k)}, {_text(n)}, 0)' for n, k in dims.EASY_ID3.items())}, ('TYER', 'date', 1), ('TDAT', 'date', 2)) as n(frame, name, choice) on case when starts_with(i.key, 'COMM:') then 'COMM' else i.key end = n.frame) where name is not null group by file_id, name)")
def _(spark, d):
    return views.easy_id3(items(spark, d, "ID3v2")).select("file_id", "name", flat().alias("vals"))


@register("easy_mp4_view", f"select i.file_id, n.name, {_flat('i.vals')} as vals from {items_sql('MP4')} i join (values {', '.join(f'({_text(k.lower() if k.startswith(chr(45)) else k)}, {_text(n)})' for n, k in dims.EASY_MP4.items())}) as n(atom, name) on case when starts_with(i.key, '----:') then lower(i.key) else i.key end = n.atom")
def _(spark, d):
    return views.easy_mp4(items(spark, d, "MP4")).select("file_id", "name", flat().alias("vals"))


@register("midi_duration", "with e as (select 'u' || user_id as file_id, event_type as track, event_id as seq, (epoch_ms(ts) - epoch_ms(timestamp '2024-01-01'))::bigint // 1000 as tick, case when event_id % 50 = 0 then 300000 + (event_id * 1000) % 400000 end as tempo from events), m as (select file_id, track, tick, tempo, seq from e where tempo is not null union all select file_id, track, 0, 500000, -1 from e group by 1, 2), x as (select m.*, z.fin, lead(m.tick) over (partition by m.file_id, m.track order by m.tick, m.seq) as nxt from m join (select file_id, track, max(tick) as fin from e group by 1, 2) z on m.file_id = z.file_id and m.track = z.track), s as (select file_id, track, sum((least(coalesce(nxt, fin), fin) - tick) * tempo / 480 / 1e6) as secs from x group by 1, 2) select file_id, round(max(secs), 6) as length_secs from s group by 1")
def _(spark, d):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tick = F.floor((F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(start)) / 1000).cast("bigint")
    rows = _table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_id"), F.col("event_type").alias("track"), F.col("event_id").alias("seq"), tick.alias("tick"), F.when(F.col("event_id") % 50 == 0, 300000 + (F.col("event_id") * 1000) % 400000).alias("tempo"), F.lit(480).alias("division"))
    return midi.durations(rows).select("file_id", F.round("length_secs", 6).alias("length_secs"))


# ---- texts and pictures ----------------------------------------------------------------------------------------------

_LINE = "case status when 'changed' then '~' when 'left_only' then '-' when 'right_only' then '+' else '=' end || ' ' || lpad(key, w, ' ') || ': ' || case status when 'changed' then l || ' → ' || r else coalesce(l, r) end || chr(10)"
_QUOTED = "'[' || array_to_string(list_transform({}, lambda v: '\"' || replace(v, chr(9), '\\t') || '\"'), ', ') || ']'"


def _pretty_sql() -> str:
    side = lambda x: f"(select file_id, key, flatten(list(vals order by o)) as vals from {x} group by file_id, key)"
    rows = f"(select coalesce(a.file_id, b.file_id) as file_id, coalesce(a.key, b.key) as key, case when a.vals is null then 'right_only' when b.vals is null then 'left_only' when a.vals = b.vals then 'unchanged' else 'changed' end as status, {_QUOTED.format('a.vals')} as l, {_QUOTED.format('b.vals')} as r from {side(_LEFT)} a full join {side(_RIGHT)} b on a.file_id = b.file_id and a.key = b.key)"
    return f"select file_id, string_agg({_LINE}, '' order by case status when 'changed' then 0 when 'left_only' then 1 when 'right_only' then 2 else 3 end, key) as text from (select *, (max(strlen(key)) over (partition by file_id))::int as w from {rows}) group by file_id"


@register("diff_pretty", _pretty_sql())
def _(spark, d):
    return render.pretty(diff.diff(*_perturbed(spark, d), diff.Options(include_unchanged=True)), full=True)


@register("image_types", "select n_nationkey, case n_nationkey % 5 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/gif' when 3 then 'image/webp' else '' end as mime, ['Other', 'File icon', 'Other file icon', 'Front cover'][n_nationkey % 4 + 1] as name from nation")
def _(spark, d):
    k = F.col("n_nationkey")
    data = F.unhex(F.when(k % 5 == 0, "89504E470D0A1A0A00").when(k % 5 == 1, "FFD8FFE000").when(k % 5 == 2, "474946383961").when(k % 5 == 3, "524946460000000057454250").otherwise("00"))
    return _table(spark, d, "nation").select("n_nationkey", F.coalesce(artwork.image_type(data), F.lit("")).alias("mime"), artwork.type_name(k % 4).alias("name"))


@register("glob_lookup", f"select file_id, key, case when key = 'TPE1' then 'lead' when starts_with(key, 'TXXX:') then 'user' when regexp_full_match(key, 'T.L.') then 'title or album' when starts_with(key, 'T') then 'text' end as name from {items_sql('ID3v2')}")
def _(spark, d):
    patterns = spark.createDataFrame([("TPE1", "lead", 9), ("TXXX:*", "user", 0), ("T?L?", "title or album", 1), ("T*", "text", 2)], "pattern string, name string, priority int")
    return I.match_patterns(items(spark, d, "ID3v2"), patterns).select("file_id", "key", "name")


@register("frame_id_upgrade", "select n_nationkey, key, case key when 'TT2' then 'TIT2' when 'TP1' then 'TPE1' when 'PIC' then 'APIC' when 'TXXX' then 'TXXX' end as frame, regexp_full_match(key, '[A-Z][A-Z0-9]{3}') as valid from nation cross join (values ('TT2'), ('TP1'), ('PIC'), ('TXXX'), ('ZZZ')) as k(key)")
def _(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("TT2", "TP1", "PIC", "TXXX", "ZZZ")))).alias("key"))
    return rows.select("n_nationkey", "key", S.upgrade_frame_id("key").alias("frame"), S.is_frame_id("key").alias("valid"))


@register("bit_padded_int", "select p_partkey, ((p_partkey % 128) + 128 * ((p_partkey // 128) % 128) + 16384 * (p_size % 128))::bigint as n from part")
def _(spark, d):
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    data = F.concat(byte(F.col("p_size") % 128), byte(F.floor(F.col("p_partkey") / 128) % 128), byte(F.col("p_partkey") % 128))
    return _table(spark, d, "part").select("p_partkey", S.bit_padded(data).alias("n"))


@register("text_limits", "select doc_id, coalesce(strlen(text), 0) > 2000 as over from documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", S.over_limit("text", 2000).alias("over"))
