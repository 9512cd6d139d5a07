"""Audio files as rows: scan, detection, parsing, and writing of new files with other tags.

spark.read.format("binaryFile") lists and reads the files; a file's format is found by an expression over its first
bytes, and only parsing the bytes needs Python, in Arrow batches. A file that can't be parsed becomes a row with error.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import ship
from tagloom.operators import convert, detect
from tagloom.sources.parsers import ape, asf, chunks, flac, id3, mp4, mpeg, ogg, rewrite, streams
from tagloom.sources.parsers.base import Limits, Padding, ParseError, Parsed, padding, using

Parser = Callable[[bytes], Parsed]
PARSERS: dict[str, Parser] = {
    "MP4": mp4.parse, "ASF": asf.parse, "OggVorbis": ogg.vorbis_stream, "OggFlac": ogg.ogg_flac, "OggOpus": ogg.opus, "OggSpeex": ogg.speex, "OggTheora": ogg.theora, "FLAC": flac.parse, "AIFF": chunks.aiff, "WAVE": chunks.wave, "DSDIFF": chunks.dsdiff, "DSF": chunks.dsf,
    "MonkeysAudio": ape.monkeys_audio, "WavPack": ape.wavpack, "TAK": ape.tak, "TrueAudio": ape.true_audio, "OptimFROG": ape.optimfrog, "MP3": mpeg.parse, "Musepack": ape.musepack, "APEv2": ape.bare, "ID3": id3.both, "AAC": streams.aac, "AC3": streams.ac3, "SMF": streams.smf,
}

STREAM = "struct<length_secs:double,bitrate:bigint,sample_rate:bigint,channels:int,bits_per_sample:int>"
ITEMS = "array<struct<ordinal:int,key:string,values:array<string>>>"
SCHEMA = f"path string, format string, stream_info {STREAM}, items {ITEMS}, extra string, error struct<kind:string,message:string>"

_ARROW = pa.schema(
    [
        ("path", pa.string()), ("format", pa.string()),
        ("stream_info", pa.struct([("length_secs", pa.float64()), ("bitrate", pa.int64()), ("sample_rate", pa.int64()), ("channels", pa.int32()), ("bits_per_sample", pa.int32())])),
        ("items", pa.list_(pa.struct([("ordinal", pa.int32()), ("key", pa.string()), ("values", pa.list_(pa.string()))]))), ("extra", pa.string()),
        ("error", pa.struct([("kind", pa.string()), ("message", pa.string())])),
    ]
)


def parse_one(fmt: str | None, data: bytes, parsers: dict[str, Parser] | None = None) -> dict:
    """The columns of SCHEMA besides path and format for one file."""
    parser = (parsers or PARSERS).get(fmt or "")
    if parser is None:
        return {"error": {"kind": "unsupported", "message": f"no parser for {fmt}"}}
    try:
        p = parser(data)
    except ParseError as e:
        return {"error": {"kind": e.kind, "message": str(e)}}
    except (ValueError, IndexError, KeyError, OverflowError, ZeroDivisionError) as e:
        return {"error": {"kind": "malformed", "message": f"{type(e).__name__}: {e}"}}
    info = {k: getattr(p, k) for k in ("length_secs", "bitrate", "sample_rate", "channels", "bits_per_sample")}
    items = [{"ordinal": i, "key": k, "values": v} for i, (k, v) in enumerate(sorted(p.items, key=lambda x: x[0].encode("utf-8", "replace")))]
    return {"stream_info": info, "items": items, "extra": json.dumps(p.extra, sort_keys=True, default=str)}


def _parse(parsers: dict[str, Parser] | None, limits: Limits | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, fmt, data in zip(*(batch.column(c) for c in ("path", "format", "content")), strict=True):  # one file's bytes at a time
                with using(limits):
                    rows.append({"path": path.as_py(), "format": fmt.as_py()} | parse_one(fmt.as_py(), data.as_py() or b"", parsers))
                size += len(rows[-1].get("extra") or "")
                if size > 4 << 20 or len(rows) >= 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def parse_audio(files: DataFrame, parsers: dict[str, Parser] | None = None, limits: Limits | None = None) -> DataFrame:
    """Rows of SCHEMA for files (path, content). parsers replaces or adds parsers by format name, limits the caps, for this call."""
    ship(files.sparkSession)
    both = (PARSERS | parsers) if parsers else None
    rows = detect.with_format(files.select("path", "content"))
    content = F.when(F.col("format").isin(*(both or PARSERS)), F.col("content")).alias("content")  # other files' bytes needn't go to Python
    return rows.select("path", "format", content).mapInArrow(_parse(both, limits), SCHEMA)


def scan(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a path; content isn't read unless it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def read_audio(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 1 << 30) -> DataFrame:
    """Parsed rows of all files below a path. Files over max_bytes aren't read and come back with an error."""
    files = scan(spark, path, glob)
    big = files.where(F.col("length") > max_bytes)
    over = big.select("path", F.lit(None).cast("string").alias("format"), F.lit(None).cast(STREAM).alias("stream_info"), F.lit(None).cast(ITEMS).alias("items"), F.lit(None).cast("string").alias("extra"), F.struct(F.lit("limit").alias("kind"), F.format_string("%d bytes", "length").alias("message")).alias("error"))
    return parse_audio(files.where(F.col("length") <= max_bytes)).unionByName(over)


def tag_items(audio: DataFrame) -> DataFrame:
    """(file_id, ordinal, key, values, system) of parsed rows, for the operators on items; keys tell the system where the format doesn't.

    A file's items are one row until here, so its keys are looked at where they stand: one parse and no shuffle.
    """
    system = F.coalesce(convert.system_of_format("format"), convert.system_of_keys(F.col("items.key")))
    rows = audio.select(F.col("path").alias("file_id"), system.alias("system"), F.explode("items").alias("x"))
    return rows.select("file_id", "x.ordinal", "x.key", "x.values", "system")


def stream_info(audio: DataFrame) -> DataFrame:
    return audio.select(F.col("path").alias("file_id"), "stream_info.*")


Items = list[tuple[str, list[str]]]
#: Pictures to write instead of those there are; None keeps them.
Pictures = list[dict] | None
#: Formats whose tags can be written: the bytes with new items. What the old tag holds beside its items is kept.
WRITERS: dict[str, Callable[..., bytes]] = {"FLAC": flac.write}


def _id3_tag(items: Items, old: bytes, at: int, pictures: Pictures, policy: Padding) -> bytes:
    """A tag of these items and of the old tag's frames that are no items, with other pictures if any are given; nothing for nothing."""
    size = id3.tag_size(old, at)
    place = (size, len(old) - at - size)
    if pictures is None:
        return id3.encode(items, id3.kept(old, at), place, policy) if items else b""
    return id3.encode(items, id3.kept(old, at, pictures=False) + id3.picture_frames(pictures), place, policy)


def _id3_file(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
    at, _ = id3.before_audio(data)
    end = len(data) - (128 if data[-128:-125] == b"TAG" else 0)
    return _id3_tag(items, data, 0, pictures, policy) + data[at:end] + (id3.encode_v1(items) if end < len(data) else b"")


def _ape_file(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
    others = ape.kept(data)
    if pictures is not None:
        others = [x for x in others if not x[8:].lower().startswith(b"cover art")] + ape.picture_items(pictures)
    return ape.without(data) + (ape.encode(items, others) if items or pictures is not None and others else b"")


def _riff_file(order: str, name: bytes):
    def write(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
        parts = list(chunks.walk(data, 12, len(data), order))
        rest = b"".join(data[a - 8 : a + s] + b"\0" * (s & 1) for n, a, s in parts if n.strip().lower() != "id3")
        tag = _id3_tag(items, data, next((a for n, a, _ in parts if n.strip().lower() == "id3"), len(data)), pictures, policy)
        if tag:
            rest += name + len(tag).to_bytes(4, order) + tag + b"\0" * (len(tag) & 1)
        return data[:4] + (len(rest) + 4).to_bytes(4, order) + data[8:12] + rest

    return write


def _dsf_file(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
    at = int.from_bytes(data[20:28], "little")
    body, tag = data[: at or len(data)], _id3_tag(items, data, at or len(data), pictures, policy)
    return body[:12] + (len(body) + len(tag)).to_bytes(8, "little") + (len(body) if tag else 0).to_bytes(8, "little") + body[28:] + tag


def _dsdiff_file(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
    parts = list(chunks.walk(data, 16, len(data), "big", wide=True))
    rest = b"".join(data[a - 12 : a + s] + b"\0" * (s & 1) for n, a, s in parts if n.strip().lower() != "id3")
    tag = _id3_tag(items, data, next((a for n, a, _ in parts if n.strip().lower() == "id3"), len(data)), pictures, policy)
    rest += b"ID3 " + len(tag).to_bytes(8, "big") + tag + b"\0" * (len(tag) & 1) if tag else b""
    return data[:4] + (len(rest) + 4).to_bytes(8, "big") + data[12:16] + rest


def _id3_tag_file(data: bytes, items: Items, pictures: Pictures = None, policy: Padding = padding) -> bytes:
    return _id3_tag(items, data, 0, pictures, policy)


WRITERS |= {"DSF": _dsf_file, "DSDIFF": _dsdiff_file, "ID3": _id3_tag_file}
WRITERS |= {"MP3": _id3_file, "TrueAudio": _id3_file, "WAVE": _riff_file("little", b"id3 "), "AIFF": _riff_file("big", b"ID3 ")} | {f: _ape_file for f in ("MonkeysAudio", "WavPack", "Musepack", "TAK", "OptimFROG", "APEv2")}

WRITERS |= {"MP4": rewrite.mp4_tags, "ASF": rewrite.asf_tags} | {f: rewrite.ogg_tags for f in ("OggVorbis", "OggOpus", "OggSpeex", "OggTheora", "OggFlac")}


#: Formats whose writers leave padding, as a policy tells.
PADDED = {"FLAC", "MP4", "MP3", "TrueAudio", "WAVE", "AIFF", "DSF", "DSDIFF", "ID3"}


def write_tags(data: bytes, fmt: str, items: Items, policy: Padding = padding) -> bytes:
    """A file's bytes with these items as its tags; none clears them, pictures and other frames too where they are in the tag."""
    if fmt not in WRITERS:
        raise ParseError("unsupported", f"tags of {fmt} can't be written")
    return WRITERS[fmt](data, items, **({"policy": policy} if fmt in PADDED else {}))


def write_pictures(data: bytes, fmt: str, pictures: list[dict], add: bool = False) -> bytes:
    """A file's bytes with these pictures (mime_type, picture_type, description, data in base64) instead of, or behind, its own; its items stay."""
    if fmt not in WRITERS:
        raise ParseError("unsupported", f"tags of {fmt} can't be written")
    old = PARSERS[fmt](data)
    return WRITERS[fmt](data, old.items, (old.extra.get("pictures", []) if add else []) + pictures)


def _repicture(add: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, fmt, data, pictures in zip(*(batch.column(c) for c in ("path", "format", "content", "pictures")), strict=True):
                new, error = None, None
                try:
                    new = write_pictures(data.as_py() or b"", fmt.as_py() or "", [p | {"data": base64.b64encode(p["data"] or b"").decode()} for p in pictures.as_py() or []], add)
                except (ParseError, ValueError, IndexError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "content": new, "error": error}], schema=schema)

    return run


def with_pictures(files: DataFrame, pictures: DataFrame, add: bool = True) -> DataFrame:
    """(path, content, error): files (path, content) with pictures (path, mime_type, picture_type, description, data) behind their own, or instead of them.

    Files without rows in pictures keep theirs with add, and lose them without: an empty table clears all.
    """
    ship(files.sparkSession)
    lists = pictures.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("picture_type", "description", "mime_type", "data"))).alias("pictures"))
    rows = detect.with_format(files.select("path", "content")).join(lists, "path", "left")
    return rows.select("path", "format", "content", "pictures").mapInArrow(_repicture(add), "path string, content binary, error string")


def _rewrite(policy: Padding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for path, fmt, data, items in zip(*(batch.column(c) for c in ("path", "format", "content", "items")), strict=True):
                new, error = None, None
                try:
                    new = write_tags(data.as_py() or b"", fmt.as_py() or "", [(x["key"], x["values"]) for x in items.as_py() or []], policy)
                except (ParseError, ValueError, IndexError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "content": new, "error": error}], schema=schema)

    return run


def retag(files: DataFrame, items: DataFrame, policy: Padding = padding) -> DataFrame:
    """(path, content, error): files (path, content) with the given items (file_id, key, values) as their tags. Inputs stay as they are.

    policy tells the bytes of padding, from what the old tag's place would leave and the bytes behind it.
    """
    ship(files.sparkSession)
    lists = items.groupBy(F.col("file_id").alias("path")).agg(F.sort_array(F.collect_list(F.struct("key", "values"))).alias("items"))
    rows = detect.with_format(files.select("path", "content")).join(lists, "path", "left")
    return rows.select("path", "format", "content", "items").mapInArrow(_rewrite(policy), "path string, content binary, error string")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Writes each content to a new file below a folder, through Spark's file systems, as one row per file of Parquet keyed by path; returns what was written."""
    out = f"{folder}/{uuid.uuid4().hex}"
    files.select("path", "content").write.parquet(out)
    return files.sparkSession.read.parquet(out)
