"""Queries of parsers and writers: small files made from their formats' rules, once per nation, with the rows they must give as SQL literals."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import scalars as S
from tagloom.operators import artwork, detect, diff, render, views
from tagloom.operators import items as I
from tagloom.plans import fixtures
from tagloom.plans.queries import QUERIES, _table, _text, register
from tagloom.sources import audio, snapshot
from tagloom.sources.parsers import vorbis
from tagloom.sources.parsers.base import Limits

_ID3 = "TALB=An album;TCON=(17);TIT2=Títle;TPE1=One+Two;TRCK=3/12;TXXX:BARCODE=123"
_V1 = "TALB=An album;TIT2=Títle;TPE1=One;TRCK=3"
_COMMENTS = "artist=One+Two;title=Títle;tracknumber=3"
_APE = "Artist=One+Two;Title=Títle;Track=3/12"
_M4A = "----:com.apple.iTunes:ISRC=US1;cpil=true;tmpo=120;trkn=3/12;©ART=One+Two;©nam=Títle"
_WMA = "Author=One;Title=Títle;WM/AlbumTitle=An album;WM/TrackNumber=3"
#: What each file must give: seconds to six places, bitrate, sample rate, channels, bits a sample, tags.
FILES: dict[str, tuple[float, int | None, int | None, int | None, int | None, str]] = {
    "a.wav": (1.0, 1411200, 44100, 2, 16, _ID3), "a.aif": (2.0, 705600, 44100, 1, 16, _ID3), "a.flac": (2.0, 1411200, 44100, 2, 16, _COMMENTS), "a.ogg": (2.0, 128000, 44100, 2, None, _COMMENTS), "a.opus": (2.0, None, 48000, 2, None, _COMMENTS), "a.spx": (2.0, 27800, 16000, 1, None, _COMMENTS), "a.oga": (1.0, 0, 44100, 2, 16, _COMMENTS), "a.ogv": (2.0, 200000, None, None, None, _COMMENTS),
    "a.mp3": (0.52125, 128000, 44100, 2, None, _ID3), "x.mp3": (26.122449, 2554, 44100, 2, None, ""), "lame.mp3": (26.122449, 2554, 44100, 2, None, ""), "v1.mp3": (0.52125, 128000, 44100, 2, None, _V1), "a.m4a": (2.0, 128000, 44100, 2, 16, _M4A), "a.wma": (2.0, 128000, 44100, 2, 16, _WMA),
    "a.ape": (1.694512, None, 44100, 2, 16, _APE), "a.wv": (2.0, None, 44100, 2, 16, _APE), "a.mpc": (1.998367, 817, 44100, 2, None, _APE), "8.mpc": (2.0, 628, 44100, 2, None, _APE), "a.tak": (2.0, None, 44100, 2, 16, _APE), "a.ofr": (2.0, None, 44100, 2, 16, _APE), "a.tta": (2.0, None, 44100, 2, 16, _V1),
    "a.dsf": (2.0, 5644800, 2822400, 2, 1, _ID3), "a.dff": (1.0, 5644800, 2822400, 2, 1, _ID3), "a.aac": (0.2322, 127821, 44100, 2, None, ""), "a.ac3": (1.0, 192000, 48000, 2, None, ""), "a.mid": (1.5, None, None, None, None, ""), "ties.mid": (1.0, None, None, None, None, ""),
}
#: The key under which each format's writer gets the new title.
TITLES = {"FLAC": "title", "OggVorbis": "title", "OggOpus": "title", "OggSpeex": "title", "OggFlac": "title", "OggTheora": "title", "MP4": "©nam", "ASF": "Title", "MonkeysAudio": "Title", "WavPack": "Title", "Musepack": "Title", "TAK": "Title", "OptimFROG": "Title", "MP3": "TIT2", "WAVE": "TIT2", "AIFF": "TIT2", "DSF": "TIT2", "DSDIFF": "TIT2", "TrueAudio": "TIT2"}


def _short(name: str) -> str:
    return fixtures.FILES[name][1].lower() + {"x.mp3": "_xing", "lame.mp3": "_lame", "v1.mp3": "_id3v1", "8.mpc": "_sv8", "ties.mid": "_ties"}.get(name, "")


def _files(spark: SparkSession, d: str, name: str, data: bytes) -> DataFrame:
    """A file per nation with the same bytes."""
    return _table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(f"/{name}")).alias("path"), F.lit(bytearray(data)).alias("content"))


def _nation() -> F.Column:
    return F.substring_index("path", "/", 1).cast("int").alias("n_nationkey")


def _tags(items: str = "items") -> F.Column:
    return F.array_join(F.transform(items, lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["values"], "+"))), ";").alias("tags")


def _row(parsed: DataFrame) -> DataFrame:
    info = [F.col(f"stream_info.{c}").alias(c) for c in ("bitrate", "sample_rate", "channels", "bits_per_sample")]
    return parsed.select(_nation(), "format", F.round("stream_info.length_secs", 6).alias("length_secs"), *info, _tags())


def _sql(name: str, tags: str | None = None) -> str:
    secs, rate, hertz, channels, bits, text = FILES[name]
    number = lambda n, t: f"{'null' if n is None else n}::{t}"
    return f"select n_nationkey, '{fixtures.FILES[name][1]}' as format, {secs}::double as length_secs, {number(rate, 'bigint')} as bitrate, {number(hertz, 'bigint')} as sample_rate, {number(channels, 'int')} as channels, {number(bits, 'int')} as bits_per_sample, {tags or _text(text)} as tags from nation"


for _name in FILES:

    @register(f"parse_{_short(_name)}", _sql(_name))
    def _(spark, d, name=_name):
        return _row(audio.parse_audio(_files(spark, d, name, fixtures.FILES[name][0])))


def _retagged(spark: SparkSession, d: str, name: str, data: bytes, key: str) -> DataFrame:
    """The files written anew with the nation's name as their only item, and parsed."""
    new = _table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(f"/{name}")).alias("file_id"), F.lit(key).alias("key"), F.array(F.concat("n_name", F.lit(" ü"))).alias("values"))
    return audio.parse_audio(audio.retag(_files(spark, d, name, data), new).select("path", "content"))


for _name in [n for n in FILES if fixtures.FILES[n][1] in TITLES and n not in ("x.mp3", "lame.mp3", "v1.mp3", "8.mpc")]:
    _key = TITLES[fixtures.FILES[_name][1]]

    @register(f"write_{_short(_name)}", f"select n_nationkey, '{fixtures.FILES[_name][1]}' as format, {FILES[_name][2] or 'null'}::bigint as sample_rate, {_text(_key + '=')} || n_name || ' ü' as tags from nation")
    def _(spark, d, name=_name, key=_key):
        return _row(_retagged(spark, d, name, fixtures.FILES[name][0], key)).select("n_nationkey", "format", "sample_rate", "tags")


# ---- frames ----------------------------------------------------------------------------------------------------------

_ENTRY = "array<struct<id:string,key:string,fields:string>>"


def _frames(parsed: DataFrame) -> DataFrame:
    """(n_nationkey, frame, key, fields) of the frames that are no items; fields as JSON."""
    return parsed.select(_nation(), F.explode(F.from_json(F.get_json_object("extra", "$.frames"), _ENTRY)).alias("x")).select("n_nationkey", F.col("x.id").alias("frame"), F.col("x.key").alias("key"), F.col("x.fields").alias("fields"))


#: Frames of fixtures.FRAMES that aren't pictures: key and fields as JSON.
FRAMES = [
    ("PRIV", "PRIV:me", '{"data":"AAEC","owner":"me"}'),
    ("GEOB", "GEOB:ü", '{"data":"aGk=","desc":"ü","encoding":1,"filename":"a.txt","mime":"text/plain"}'),
    ("SYLT", "SYLT:d:eng", '{"desc":"d","encoding":3,"format":2,"lang":"eng","lines":[{"text":"One","time":0},{"text":"Two","time":1500}],"type":1}'),
    ("USER", "USER:eng", '{"encoding":3,"lang":"eng","text":"free"}'),
    ("OWNE", "OWNE", '{"date":"20200102","encoding":0,"price":"EUR1","seller":"S"}'),
    ("ETCO", "ETCO", '{"events":[{"time":500,"type":3}],"format":2}'),
    ("EQU2", "EQU2:eq", '{"adjustments":[{"frequency":100.5,"gain":-1.5}],"identification":"eq","method":1}'),
    ("SEEK", "SEEK", '{"offset":77}'),
    ("SIGN", "SIGN:129", '{"data":"c2ln","group":129}'),
    ("ENCR", "ENCR:o", '{"data":"","method":130,"owner":"o"}'),
    ("GRID", "GRID:131", '{"data":"eA==","group":131,"owner":"g"}'),
    ("AENC", "AENC:a", '{"data":"","owner":"a","preview_length":2,"preview_start":1}'),
    ("RBUF", "RBUF", '{"info":1,"offset":9,"size":4096}'),
    ("RVRB", "RVRB", '{"bounce_left":3,"bounce_right":4,"feedback_ltl":5,"feedback_ltr":6,"feedback_rtl":8,"feedback_rtr":7,"left":1,"premix_ltr":9,"premix_rtl":10,"right":2}'),
    ("POSS", "POSS", '{"format":2,"position":1234}'),
    ("LINK", "LINK:TIT2:http://x", '{"data":"","frame_id":"TIT2","url":"http://x"}'),
    ("MCDI", "MCDI", '{"data":"AQID"}'),
    ("SYTC", "SYTC", '{"data":"eAA=","format":2}'),
    ("MLLT", "MLLT", '{"bits_for_bytes":8,"bits_for_milliseconds":8,"bytes":417,"data":"AAA=","frames":1,"milliseconds":26}'),
    ("COMR", "COMR", '{"contact":"http://s","data":"","desc":"file","encoding":3,"format":0,"mime":"image/png","price":"EUR2","seller":"Shop","valid_until":"20300101"}'),
    ("ASPI", "ASPI", '{"bits":8,"data":"AA==","length":100,"points":1,"start":0}'),
    ("CHAP", "CHAP:c1", '{"element_id":"c1","end_offset":4294967295,"end_time":1000,"start_offset":4294967295,"start_time":0,"sub_frames":[{"id":"TIT2","value":["Chapter ü"]}]}'),
    ("CTOC", "CTOC:toc", '{"child_ids":["c1"],"element_id":"toc","flags":3,"sub_frames":[{"id":"CHAP","value":{"element_id":"c2","end_offset":0,"end_time":2,"start_offset":0,"start_time":1,"sub_frames":[]}}]}'),
]


def _frames_sql(names: set[str] | None = None) -> str:
    rows = ", ".join(f"({_text(f)}, {_text(k)}, {_text(j)})" for f, k, j in FRAMES if names is None or f in names)
    return f"select n_nationkey, frame, key, fields from nation cross join (values {rows}) as x(frame, key, fields)"


for _names in (("PRIV", "GEOB", "USER", "OWNE", "LINK", "MCDI"), ("SYLT",), ("CHAP",), ("CTOC",), ("ETCO", "MLLT", "SYTC", "POSS", "SEEK", "ASPI", "RBUF", "RVRB", "EQU2"), ("ENCR", "GRID", "SIGN", "AENC", "COMR")):

    @register(f"id3_frames_{'_'.join(_names).lower()}", _frames_sql(set(_names)))
    def _(spark, d, names=_names):
        return _frames(audio.parse_audio(_files(spark, d, "a.mp3", fixtures.mp3(tag=fixtures.id3_frames(names)))))


@register("retag_keeps_id3_frames", _frames_sql())
def _(spark, d):
    return _frames(_retagged(spark, d, "a.mp3", fixtures.mp3(tag=fixtures.id3_frames()), "TIT2"))


# ---- pictures --------------------------------------------------------------------------------------------------------

_PNG = base64.b64decode("iVBORw0KGgo=")


def _pictures(parsed: DataFrame) -> DataFrame:
    return artwork.pictures(parsed).select(_nation(), "mime_type", "picture_type", "description", F.hex("data").alias("data"))


def _new_pictures(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A picture per nation, with its name for a description."""
    n = _table(spark, d, "nation")
    return n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(f"/{name}")).alias("path"), F.lit("image/png").alias("mime_type"), F.lit(3).alias("picture_type"), F.col("n_name").alias("description"), F.lit(bytearray(_PNG)).alias("data"))


_OWN = f"select n_nationkey, 'image/png' as mime_type, 3 as picture_type, n_name as description, '{_PNG.hex().upper()}' as data from nation"
_PLAIN = f"select n_nationkey, 'image/png' as mime_type, 3 as picture_type, '' as description, '{_PNG.hex().upper()}' as data from nation"
for _name in ("a.flac", "a.mp3", "a.wma", "a.ape", "a.ogg", "a.wav", "a.m4a"):

    @register(f"pictures_add_{_short(_name)}", _PLAIN + " union all select n_nationkey, 'image/jpeg', 3, '', 'FFD8FFE0' from nation" if _name == "a.m4a" else _OWN)
    def _(spark, d, name=_name):
        new = audio.with_pictures(_files(spark, d, name, fixtures.FILES[name][0]), _new_pictures(spark, d, name))
        return _pictures(audio.parse_audio(new.select("path", "content")))

    @register(f"pictures_clear_{_short(_name)}", f"select n_nationkey, 0 as pictures, {_text(FILES[_name][5])} as tags from nation")
    def _(spark, d, name=_name):
        new = audio.with_pictures(_files(spark, d, name, fixtures.FILES[name][0]), _new_pictures(spark, d, name)).select("path", "content")
        gone = audio.parse_audio(audio.with_pictures(new, _new_pictures(spark, d, name).limit(0), add=False).select("path", "content"))
        return gone.select(_nation(), F.coalesce(F.json_array_length(F.get_json_object("extra", "$.pictures")), F.lit(0)).alias("pictures"), _tags())


# ---- text modes, limits, detection, snapshots ------------------------------------------------------------------------

_ODD = b"\x01\0\0\0v" + b"\x04\0\0\0" + b"".join(len(x).to_bytes(4, "little") + x for x in (b"A=\xff1", b"none", b"B\x01=2", b"C=3"))
for _mode, _want in (("replace", "a=�1;b?=2;c=3;unknown0=none"), ("ignore", "a=1;c=3"), ("strict", None)):

    @register(f"vorbis_errors_{_mode}", f"select n_nationkey, {'null' if _want is None else _text(_want)}::varchar as tags, {'true' if _want is None else 'false'} as failed from nation")
    def _(spark, d, mode=_mode):
        files = _files(spark, d, "a.comment", _ODD).withColumn("content", F.concat(F.lit(bytearray(b"fLaC")), "content"))
        rows = audio.parse_audio(files, {"FLAC": lambda data, errors=mode: vorbis.decode(data[4:], errors=errors)[0]})
        return rows.select(_nation(), _tags(), F.col("error").isNotNull().alias("failed"))


@register("parse_limits", "select n_nationkey, n_nationkey % 2 = 0 as refused from nation")
def _(spark, d):
    files = _files(spark, d, "a.mp3", fixtures.FILES["a.mp3"][0])
    few, many = files.where("cast(substring_index(path, '/', 1) as int) % 2 = 0"), files.where("cast(substring_index(path, '/', 1) as int) % 2 = 1")
    both = audio.parse_audio(few, limits=Limits(tag=100, image=100)).unionByName(audio.parse_audio(many, limits=Limits(tag=256 << 20, image=128 << 20)))
    return both.select(_nation(), (F.col("error.kind") == "limit").alias("refused")).fillna(False, ["refused"])


#: (header in hex, name, format) by the first mark: these differ from the scores where a tag or a name speaks louder.
MAGIC = [("49443303000000000000664C6143", "a.flac", "MP3"), ("664C6143000000", "a.mp3", "FLAC"), ("0000002066747970", "a", "MP4"), ("5249464600000000", "a", "WAVE"), ("464F524D00000000", "a", "AIFF"), ("3026B27500", "a", "ASF"), ("44534420", "a", "DSF"), ("46524D38", "a", "DSDIFF"), ("4D414320", "a", "MonkeysAudio"), ("7776706B", "a", "WavPack"), ("4D546864", "a", "SMF"), ("FFFB9044", "a.aac", "MP3"), ("FFF15080", "a.aac", "AAC"), ("4F67675300", "a", "Ogg"), ("4F67675300" + "00" * 23 + "4F70757348656164", "a", "OggOpus"), ("0B77000000", "a.ac3", "AC3"), ("00", "a.tta", "TrueAudio"), ("00000000", "a.txt", "")]


@register("detect_magic_first", f"select n_nationkey, name, hex, format from nation cross join (values {', '.join(f'({_text(h)}, {_text(n)}, {_text(f)})' for h, n, f in MAGIC)}) as x(hex, name, format)")
def _(spark, d):
    cases = F.explode(F.array(*[F.struct(F.lit(h).alias("hex"), F.lit(n).alias("name")) for h, n, _ in MAGIC]))
    rows = _table(spark, d, "nation").select("n_nationkey", cases.alias("x")).select("n_nationkey", "x.name", "x.hex")
    return rows.withColumn("format", F.coalesce(detect.magic_first(F.unhex("hex"), F.col("name")), F.lit("")))


@register("snapshot_diff", "select 'n' || n_nationkey as file_id, key, status, l, r from (select n_nationkey, 'title' as key, 'changed' as status, n_name as l, n_name || '!' as r from nation where n_nationkey % 2 = 1 union all select n_nationkey, 'album', 'left_only', 'x', null from nation union all select n_nationkey, 'genre', 'right_only', null, 'y' from nation)")
def _(spark, d):
    n = _table(spark, d, "nation").withColumn("file_id", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    taken = n.select("file_id", F.to_json(F.struct(F.lit("FLAC").alias("format"), F.create_map(F.lit("title"), F.array("n_name"), F.lit("album"), F.array(F.lit("x"))).alias("tags"))).alias("json"))
    title = F.when(F.col("n_nationkey") % 2 == 1, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))
    now = n.select("file_id", F.posexplode(F.array(F.struct(F.lit("genre").alias("key"), F.array(F.lit("y")).alias("values")), F.struct(F.lit("title").alias("key"), F.array(title).alias("values")))).alias("ordinal", "x")).select("file_id", "ordinal", "x.key", "x.values")
    out = diff.against_snapshot(now, snapshot.read(taken))
    return out.select("file_id", "key", "status", F.array_join("left", "+").alias("l"), F.array_join("right", "+").alias("r"))


@register("snapshot_caps", "select n_nationkey, case n_nationkey % 3 when 0 then 'raw tags too deep' when 1 then 'too many raw values' else '' end as error from nation")
def _(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("["), 65), F.repeat(F.lit("]"), 65))).when(k % 3 == 1, F.concat(F.lit("[0"), F.repeat(F.lit(",0"), 100_000), F.lit("]"))).otherwise(F.concat(F.repeat(F.lit("["), 64), F.lit('"[[,,"'), F.repeat(F.lit("]"), 64)))
    rows = _table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"format": "X", "tags": {}, "raw_tags": '), raw, F.lit("}")).alias("json"))
    return snapshot.read(rows).select("n_nationkey", F.coalesce("error", F.lit("")).alias("error"))


@register("snapshot_round_trip", "select n_nationkey, 'FLAC' as format, 2.0::double as length_secs, 'One+Two' as artist from nation")
def _(spark, d):
    back = snapshot.read(snapshot.write(audio.parse_audio(_files(spark, d, "a.flac", fixtures.FILES["a.flac"][0]))))
    return back.select(_nation(), F.col("snapshot.format").alias("format"), F.col("snapshot.stream_info.length_secs").alias("length_secs"), F.array_join(F.col("snapshot.tags")["artist"], "+").alias("artist"))


@register("easy_views_of_files", "select n_nationkey, name, vals from nation cross join (values ('album', 'An album'), ('artist', 'One+Two'), ('barcode', '123'), ('genre', 'Rock'), ('title', 'Títle'), ('tracknumber', '3/12'), ('m4a:artist', 'One+Two'), ('m4a:bpm', '120'), ('m4a:compilation', 'true'), ('m4a:title', 'Títle'), ('m4a:tracknumber', '3/12')) as x(name, vals)")
def _(spark, d):
    parsed = audio.parse_audio(_files(spark, d, "a.mp3", fixtures.FILES["a.mp3"][0]).unionByName(_files(spark, d, "a.m4a", fixtures.FILES["a.m4a"][0])))
    both = views.easy_mp3(parsed).unionByName(views.easy_m4a(parsed).withColumn("name", F.concat(F.lit("m4a:"), "name")))
    return both.select(F.substring_index("file_id", "/", 1).cast("int").alias("n_nationkey"), "name", F.array_join("values", "+").alias("vals"))


@register("tag_items_of_files", "select n_nationkey, system, count(*) as n from nation cross join (values ('ID3v2', 6), ('VorbisComment', 3), ('APEv2', 3), ('ID3v2', 4)) as x(system, k) cross join range(k) group by all")
def _(spark, d):
    names = ("a.mp3", "a.flac", "a.ape", "a.tta")
    files = [_files(spark, d, n, fixtures.FILES[n][0]) for n in names]
    rows = audio.tag_items(audio.parse_audio(files[0].unionAll(files[1]).unionAll(files[2]).unionAll(files[3])))
    return rows.groupBy(F.substring_index("file_id", "/", 1).cast("int").alias("n_nationkey"), "system").agg(F.count("*").alias("n"))


@register("diff_get_change", "select 'c' || c_custkey as file_id, c_mktsegment || chr(31) || c_name as l, c_name || chr(31) || c_mktsegment as r from customer where c_custkey % 2 = 1")
def _(spark, d):
    from tagloom.plans.queries import _perturbed

    out = diff.get_change(diff.diff(*_perturbed(spark, d), diff.Options(case_insensitive_keys=True)), "segment")
    return out.select("file_id", F.array_join("left", "\x1f").alias("l"), F.array_join("right", "\x1f").alias("r"))


@register("dict_update_checked", "select 'p' || p_partkey as file_id, case when p_size % 2 = 0 then p_name else 'new' end as title, p_size % 2 = 0 as refused from part")
def _(spark, d):
    p = _table(spark, d, "part")
    own = F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file_id")
    old = p.select(own, F.lit(0).alias("ordinal"), F.lit("title").alias("key"), F.array("p_name").alias("values"))
    new = p.select(own, F.lit(0).alias("ordinal"), F.lit("title").alias("key"), F.array(F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("x"), 200)).otherwise("new")).alias("values"))
    out, refused = I.update_checked(old, new, max_bytes=100)
    return out.join(refused.select("file_id", F.lit(True).alias("refused")), "file_id", "left").select("file_id", F.col("values")[0].alias("title"), F.coalesce("refused", F.lit(False)).alias("refused"))


@register("common_fields_set", "select 'p' || p_partkey as file_id, key, vals from part cross join (values ('Title', 1), ('artist', 2), ('genre', 3)) as x(key, k) cross join lateral (select case k when 1 then p_brand when 2 then p_type else 'kept' end as vals)")
def _(spark, d):
    p = _table(spark, d, "part").withColumn("file_id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    old = p.select("file_id", F.posexplode(F.array(F.struct(F.lit("Title").alias("key"), F.array("p_name").alias("values")), F.struct(F.lit("ALBUM").alias("key"), F.array(F.lit("x")).alias("values")), F.struct(F.lit("genre").alias("key"), F.array(F.lit("kept")).alias("values")))).alias("ordinal", "x")).select("file_id", "ordinal", "x.key", "x.values")
    new = p.select("file_id", F.col("p_brand").alias("title"), F.col("p_type").alias("artist"), F.lit("").alias("album"), F.lit(None).cast("string").alias("genre"))
    return I.set_common_fields(old, new).select("file_id", "key", F.col("values")[0].alias("vals"))


@register("stream_text", "select n_nationkey, '2.00 seconds, 1411 kbps, 44100 Hz, 2 channels, 16 bit' as text from nation")
def _(spark, d):
    parsed = audio.parse_audio(_files(spark, d, "a.flac", fixtures.FILES["a.flac"][0]))
    return parsed.select(_nation(), render.stream_text("stream_info").alias("text"))


@register("diff_unified", "select 'n' || n_nationkey as file_id, case when n_nationkey % 2 = 0 then 'No differences' else '--- left' || chr(10) || '+++ right' || chr(10) || '~ k: [\"a\"] → [\"b\"]' || chr(10) end as text from nation")
def _(spark, d):
    side = lambda v: _table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file_id"), F.lit(0).alias("ordinal"), F.lit("k").alias("key"), F.array(v).alias("values"))
    right = side(F.when(F.col("n_nationkey") % 2 == 1, "b").otherwise("a"))
    return render.unified(diff.diff(side(F.lit("a")), right, diff.Options(include_unchanged=True)))


@register("frame_id_downgrade", "select n_nationkey, key, frame from nation cross join (values ('TIT2', 'TT2'), ('TDRC', 'TYE'), ('TXXX', 'TXX'), ('APIC', 'PIC'), ('TIPL', '')) as x(key, frame)")
def _(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, ("TIT2", "TDRC", "TXXX", "APIC", "TIPL")))).alias("key"))
    return rows.withColumn("frame", F.coalesce(S.downgrade_frame_id("key"), F.lit("")))


@register("decode_text", "select n_nationkey, mark, case when starts_with(mark, 'utf-32') then 'ü' else n_name end as text from nation cross join (values ('utf-8'), ('utf-16le'), ('utf-16be'), ('utf-32le'), ('utf-32be'), ('')) as x(mark)")
def _(spark, d):
    marks = {"utf-8": "EFBBBF", "utf-16le": "FFFE", "utf-16be": "FEFF", "": ""}
    cases = [F.struct(F.lit(m).alias("mark"), F.concat(F.unhex(F.lit(h)), F.encode("n_name", m or "utf-8")).alias("data")) for m, h in marks.items()]
    cases += [F.struct(F.lit(m).alias("mark"), F.unhex(F.lit(h)).alias("data")) for m, h in (("utf-32le", "FFFE0000FC000000"), ("utf-32be", "0000FEFF000000FC"))]
    return _table(spark, d, "nation").select("n_nationkey", F.explode(F.array(*cases)).alias("x")).select("n_nationkey", "x.mark", S.decode_text("x.data").alias("text"))


@register("lame_settings", "select n_nationkey, '--preset insane' as settings from nation")
def _(spark, d):
    parsed = audio.parse_audio(_files(spark, d, "a.mp3", fixtures.lame()))
    return parsed.select(_nation(), F.get_json_object("extra", "$.encoder_settings").alias("settings"))


#: Names of the queries whose plans parse bytes in Python.
PARSING = {n for n in QUERIES if n.split("_")[0] in ("parse", "write", "id3", "retag", "pictures", "vorbis", "snapshot", "easy", "tag", "stream", "lame")} - {"id3_getall_prefix", "id3_delall", "id3_merge_frames", "easy_id3_view", "easy_mp4_view", "tag_budget", "snapshot_diff", "snapshot_caps", "stream_info_diff"}
