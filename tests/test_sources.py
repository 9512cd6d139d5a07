"""Parsers, the scan of a folder, new files with other tags, and snapshots, on files made here."""

from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from tagloom.operators import artwork, chunks, convert, diff, render
from tagloom.sources import audio, probe, ranged, snapshot
from tagloom.sources.parsers import ape, asf, base, flac, frames, id3, mp4, ogg, rewrite, vorbis
from tagloom.streaming import ingest
from tagloom.plans import fixtures
from tagloom.plans.fixtures import APE_ITEMS, COMMENTS, FILES, ITEMS, mp3


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("audio")
    for name, (data, _, _) in FILES.items():
        (path / name).write_bytes(data)
    (path / "junk.mpc").write_bytes(b"ID3 dsfdsfdsMP+  ")
    (path / "empty.flac").write_bytes(b"")
    (path / "note.txt").write_bytes(b"text")
    return str(path)


@pytest.fixture(scope="module")
def parsed(spark, folder):
    return {r["path"].rsplit("/", 1)[1]: r.asDict(recursive=True) for r in audio.read_audio(spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(FILES))
def test_properties(parsed, name):
    row = parsed[name]
    assert row["error"] is None and row["format"] == FILES[name][1]
    assert row["stream_info"]["length_secs"] == pytest.approx(FILES[name][2], abs=1e-6)


def test_details(parsed):
    info = {n: r["stream_info"] for n, r in parsed.items()}
    assert info["a.wav"] == {"length_secs": 1.0, "bitrate": 1411200, "sample_rate": 44100, "channels": 2, "bits_per_sample": 16}
    assert info["a.flac"]["bitrate"] == 1411200 and info["a.m4a"]["bitrate"] == 128000 and info["a.wma"]["bitrate"] == 128000
    assert (info["a.aac"]["channels"], info["a.aac"]["sample_rate"]) == (2, 44100)
    assert (info["a.ac3"]["bitrate"], info["a.ac3"]["channels"], info["a.ac3"]["sample_rate"]) == (192000, 2, 48000)
    assert info["x.mp3"]["bitrate"] == int(417 * 20 * 8 / (1000 * 1152 / 44100))
    assert info["a.dff"]["bitrate"] == 2 * 2822400 and info["8.mpc"]["channels"] == 2
    assert json.loads(parsed["a.m4a"]["extra"])["chapters"] == [{"start": 1.0, "title": "One"}]


def test_items(parsed):
    items = {n: {x["key"]: x["values"] for x in r["items"] or []} for n, r in parsed.items()}
    for name in ("a.wav", "a.aif", "a.mp3", "a.dsf", "a.dff"):
        assert items[name] == dict(ITEMS), name
    for name in ("a.flac", "a.ogg", "a.opus", "a.spx", "a.oga", "a.ogv"):
        assert items[name] == {k.lower(): v for k, v in COMMENTS}, name
    for name in ("a.ape", "a.wv", "a.mpc", "8.mpc", "a.tak", "a.ofr"):
        assert items[name] == dict(APE_ITEMS), name
    assert items["a.m4a"] == {"----:com.apple.iTunes:ISRC": ["US1"], "cpil": ["true"], "tmpo": ["120"], "trkn": ["3/12"], "©ART": ["One", "Two"], "©nam": ["Títle"]}
    assert items["a.wma"] == {"Author": ["One"], "Title": ["Títle"], "WM/AlbumTitle": ["An album"], "WM/TrackNumber": ["3"]}
    assert items["v1.mp3"]["TIT2"] == ["Títle"] and items["v1.mp3"]["TRCK"] == ["3"]


def test_bad_files_are_rows(parsed):
    assert parsed["junk.mpc"]["error"] and "empty.flac" not in parsed and parsed["note.txt"]["error"]["kind"] == "unsupported"
    for name, (data, fmt, _) in FILES.items():
        for cut in (3, 11, 20, 40, 60, len(data) // 2):
            audio.parse_one(fmt, data[:cut])  # an error row at worst
        audio.parse_one(fmt, data[:16] + b"\xff" * 64 + data[80:])


def test_conversion_of_parsed_files(spark, folder):
    rows = audio.tag_items(audio.read_audio(spark, folder, "a.*"))
    maps = convert.extract(rows)
    titles = {r["file_id"].rsplit("/", 1)[1]: r["values"] for r in maps.where("field = 'Title'").collect()}
    assert len(titles) >= 18 and set(map(tuple, titles.values())) == {("Títle",)}
    one = lambda name: rows.where(F.col("file_id").endswith(name)).withColumn("file_id", F.lit("f"))
    left = {r["key"]: r["status"] for r in diff.diff_normalized(one("a.mp3"), one("a.ape")).collect()}
    assert "Title" not in left and left["Genre"] == "left_only"


def test_new_files_with_other_tags(spark, folder):
    oggs = ["a.ogg", "a.opus", "a.spx", "a.oga", "a.ogv"]
    names = ["a.flac", "a.mp3", "a.wav", "a.aif", "a.ape", "a.wv", "a.tta", "v1.mp3", "a.dsf", "a.dff", "a.m4a", "a.wma", *oggs]
    files = audio.scan(spark, folder).where(F.regexp_extract("path", "[^/]+$", 0).isin(names))
    new = {"a.flac": [("title", ["Nëw"])], "a.ape": [("Title", ["Nëw"])], "a.wv": [("Title", ["Nëw", "er"])], "a.m4a": [("----:com.apple.iTunes:ISRC", ["X"]), ("cpil", ["false"]), ("tmpo", ["-3"]), ("trkn", ["4/5"]), ("©nam", ["Nëw", "er"])], "a.wma": [("Title", ["Nëw"]), ("WM/Genre", ["One", "Two"]), ("WM/Year", ["1999"])]} | {o: [("title", ["Nëw" * 30_000])] for o in oggs}
    paths = [r.path for r in files.select("path").collect()]
    rows = [(p, k, v) for p in paths for k, v in new.get(p.rsplit("/", 1)[1], [("TIT2", ["Nëw"])])]
    out = audio.retag(files, spark.createDataFrame(rows, "file_id string, key string, values array<string>"))
    assert out.where("error is not null").count() == 0
    again = {r["path"].rsplit("/", 1)[1]: r.asDict(recursive=True) for r in audio.parse_audio(out.select("path", "content")).collect()}
    for name in names:
        assert again[name]["error"] is None and {x["key"]: x["values"] for x in again[name]["items"]} == dict(new.get(name, [("TIT2", ["Nëw"])])), name
        assert again[name]["stream_info"]["length_secs"] == pytest.approx(FILES[name][2], rel=0.2)
    cleared = audio.parse_audio(audio.retag(files, spark.createDataFrame([], "file_id string, key string, values array<string>")).select("path", "content"))
    assert cleared.where(F.size("items") > 0).count() == 0
    assert audio.retag(audio.scan(spark, folder, "a.mid"), spark.createDataFrame([], "file_id string, key string, values array<string>")).where("error is not null").count() == 1


def test_writers_keep_what_they_do_not_change():
    frames = json.loads(audio.parse_one("ID3", fixtures.id3_frames())["extra"])
    for name in ("a.mp3", "a.wav", "a.dsf"):
        make = {"a.mp3": lambda t: mp3(tag=t), "a.wav": fixtures.riff, "a.dsf": fixtures.dsf}[name]
        fmt = FILES[name][1]
        new = audio.write_tags(make(fixtures.id3_frames()), fmt, [("POPM:me", ["200", "7"]), ("PCNT", ["300"]), ("TIT2", ["new"])])
        got = audio.parse_one(fmt, new)
        extra = json.loads(got["extra"])
        assert [(x["key"], x["values"]) for x in got["items"]] == [("PCNT", ["300"]), ("POPM:me", ["200", "7"]), ("TIT2", ["new"])], name
        assert extra["frames"] == frames["frames"] and extra["pictures"] == frames["pictures"], name
    assert id3.kept(audio.write_tags(mp3(tag=fixtures.id3_frames()), "MP3", [("TIT2", ["new"])])) == id3.kept(fixtures.id3_frames())  # byte for byte
    cover = b"cover.jpg\0\xff\xd8\xff\xe0"
    binary = len(cover).to_bytes(4, "little") + b"\x02\0\0\0Cover Art (Front)\0" + cover
    old = b"MAC " + bytes(60) + ape.encode(APE_ITEMS, [binary])
    assert ape.kept(audio.write_tags(old, "MonkeysAudio", [("Title", ["x"])])) == [binary]
    assert ape.tag(old).extra["pictures"][0]["picture_type"] == 3
    wma = audio.write_tags(FILES["a.wma"][0], "ASF", [("Title", ["x"]), ("WM/AlbumTitle", ["An album"]), ("WM/TrackNumber", ["4"])])
    assert asf.attributes(wma) == {"WM/AlbumTitle": [(0, "An album\0".encode("utf-16-le"))], "WM/TrackNumber": [(3, b"\4\0\0\0")]}
    pictured = rewrite.asf_tags(FILES["a.wma"][0], [("Title", ["x"])], [{"mime_type": "image/png", "picture_type": 3, "description": "d", "data": "AAEC"}])
    assert asf.attributes(rewrite.asf_tags(pictured, [("Title", ["y"])]))["WM/Picture"] == asf.attributes(pictured)["WM/Picture"]


def test_mp4_keeps_unknown_atoms():
    atom = lambda name, body: (len(body) + 8).to_bytes(4, "big") + name + body
    odd = atom(b"zzzz", atom(b"data", b"\0\0\0\0\0\0\0\0\1\2"))
    data = FILES["a.m4a"][0]
    ilst = next((a, b) for p, a, b in mp4.atoms(data) if p == "moov.udta.meta.ilst")
    grown = bytearray(data[: ilst[1]] + odd + data[ilst[1] :])
    for p, a, b in mp4.atoms(data):
        if p in ("moov", "moov.udta", "moov.udta.meta", "moov.udta.meta.ilst"):
            grown[a - 8 : a - 4] = (b - a + 8 + len(odd)).to_bytes(4, "big")
    parsed = mp4.parse(bytes(grown))
    assert parsed.extra["unknown_atoms"] == [{"name": "zzzz", "data": base64.b64encode(odd[8:]).decode()}] and "zzzz" not in dict(parsed.items)
    new = rewrite.mp4_tags(bytes(grown), [("shwm", ["2"]), ("©nam", ["x"])])
    assert odd in new and dict(mp4.parse(new).items) == {"shwm": ["2"], "©nam": ["x"]}


def test_padding_policies():
    data = FILES["a.mp3"][0]
    first = audio.write_tags(data, "MP3", [("TIT2", ["x"])])
    again = audio.write_tags(first, "MP3", [("TIT2", ["longer title"])])
    assert len(again) == len(first)  # written in the same place
    assert id3.tag_size(audio.write_tags(data, "MP3", [("TIT2", ["x"])], lambda left, content: 5)) == 10 + 10 + 2 + 5
    song = flac.write(FILES["a.flac"][0], [("title", ["x"])], policy=lambda left, content: 7)
    assert [s for k, _, s, _ in flac.blocks(song) if k == 1] == [7]
    assert len(flac.write(flac.write(FILES["a.flac"][0], [("title", ["x"])]), [("title", ["xyz"])])) == len(flac.write(FILES["a.flac"][0], [("title", ["x"])]))


def test_encrypted_frames_stay():
    body = b"TIT2\0\0\0\2\0\0\3a" + b"PRIV\0\0\0\4\0\x04\x80abc"
    tag = b"ID3\4\0\0" + bytes((0, 0, 0, len(body))) + body
    assert id3.decode(tag).extra["frames"][0]["encrypted"] and dict(id3.decode(tag).items) == {"TIT2": ["a"]}
    assert id3.kept(tag) == b"PRIV\0\0\0\4\0\x04\x80abc"
    old = b"ID3\3\0\0" + bytes((0, 0, 0, 14)) + b"PRIV\0\0\0\4\0\x40\x80abc"
    assert id3.kept(old) == b"PRIV\0\0\0\4\0\x04\x80abc"
    people = b"ID3\3\0\0" + bytes((0, 0, 0, 17)) + b"IPLS\0\0\0\7\0\0\0mix\0AB"
    assert dict(id3.decode(people).items) == {"TIPL": ["mix", "AB"]}


def test_chapters_are_read_to_a_depth():
    deep = {"element_id": "x", "sub_frames": []}
    for _ in range(5):
        deep = {"element_id": "x", "sub_frames": [{"id": "CHAP", "value": deep}]}
    raw = frames.encode("CHAP", deep)
    with pytest.raises(base.ParseError):
        frames.decode("CHAP", raw, lambda b: [(f, d) for f, d, _ in id3._frames(b, 4, False)])


def test_pictures_of_files(spark, folder):
    names = ["a.flac", "a.mp3", "a.wma", "a.ape"]
    files = audio.scan(spark, folder).where(F.regexp_extract("path", "[^/]+$", 0).isin(names)).select("path", "content")
    new = files.select("path", F.lit("image/jpeg").alias("mime_type"), F.lit(4).alias("picture_type"), F.lit("back").alias("description"), F.unhex(F.lit("FFD8FFE0")).alias("data"))
    once = audio.with_pictures(files, new)
    twice = audio.parse_audio(audio.with_pictures(once, new.withColumn("picture_type", F.lit(3))).select("path", "content"))
    got = {(r.path.rsplit("/", 1)[1], r.picture_type) for r in artwork.pictures(twice).collect()}
    assert got == {(n, k) for n in names for k in (3, 4)} and once.where("error is not null").count() == 0


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_ranged_bytes_parse_alike(block):
    for name, (data, fmt, _) in FILES.items():
        lazy = ranged.Ranged(lambda at, n, d=data: d[at : at + n], len(data), block)
        assert audio.parse_one(fmt, lazy) == audio.parse_one(fmt, data), name
    big = fixtures.riff(id3.encode(ITEMS))[:-1] + bytes(1 + (50 << 20))
    lazy = ranged.Ranged(lambda at, n: big[at : at + n], len(big))
    assert audio.parse_one("WAVE", lazy)["stream_info"] and lazy.fetched < 1 << 20
    odd = ranged.Ranged(lambda at, n: b"abcabcabc"[at : at + n], 9, 2)
    for mark in (b"abc", b"ca", b"x", b"c"):
        for a in range(9):
            assert (odd.find(mark, a), odd.rfind(mark, a)) == (b"abcabcabc".find(mark, a), b"abcabcabc".rfind(mark, a))


def test_ranged_reading_of_a_folder(spark, folder):
    whole = {r["path"]: r.asDict(recursive=True) for r in audio.read_audio(spark, folder, "a.*").collect()}
    assert {r["path"]: r.asDict(recursive=True) for r in ranged.read_ranges(spark, folder, "a.*").collect()} == whole


def test_codecs():
    assert dict(id3.decode(id3.encode(ITEMS)).items) == dict(ITEMS)
    assert dict(ape.tag(b"x" * 50 + ape.encode(APE_ITEMS)).items) == dict(APE_ITEMS)
    assert dict(ape.tag(b"x" * 50 + ape.encode(APE_ITEMS) + id3.encode_v1(ITEMS)).items) == dict(APE_ITEMS)
    assert ape.without(b"x" * 50 + ape.encode(APE_ITEMS)) == b"x" * 50
    assert dict(vorbis.decode(vorbis.encode(COMMENTS))[0].items) == {k.lower(): v for k, v in COMMENTS}
    picture = {"mime_type": "image/png", "picture_type": 3, "description": "d", "width": 1, "height": 2, "depth": 24, "colors": 0, "data": "AAEC"}
    assert vorbis.picture(vorbis.encode_picture(picture)) == picture
    assert flac.parse(flac.write(FILES["a.flac"][0], [("a b", ["1", "2"])])).items == [("a b", ["1", "2"])]
    assert ogg.crc(b"123456789") == 0x89A1897F
    old = b"ID3\x02\0\0" + bytes((0, 0, 0, 20)) + b"TT2\0\0\x04\0abc" + b"TYE\0\0\x05\x001999"[:10]
    assert dict(id3.decode(old.ljust(30, b"\0")).items)["TIT2"] == ["abc"]
    v3 = b"ID3\x03\0\0\0\0\0\x40" + b"TYER\0\0\0\x05\0\0\x002001" + b"TDAT\0\0\0\x05\0\0\x002503" + bytes(34)
    assert dict(id3.decode(v3).items) == {"TDRC": ["2001-03-25"]}
    with pytest.raises(base.ParseError):
        vorbis.decode(b"\xff\xff\xff\x7f")
    assert len(mp3()) == 20 * 417


def test_snapshots(spark, folder):
    rows = snapshot.write(audio.read_audio(spark, folder, "a.*"))
    back = {r["path"].rsplit("/", 1)[1]: r for r in snapshot.read(rows).drop("raw_tags").collect()}
    assert back["a.flac"]["snapshot"]["tags"]["artist"] == ["One", "Two"] and back["a.flac"]["error"] is None
    odd = spark.createDataFrame([("{",), ("{}",), ('{"format": "X", "stream_info": {"length_secs": -1}, "tags": {}, "raw_tags": {"a": [1]}}',), ('{"format": "X", "tags": {' + ",".join(f'"k{i}": []' for i in range(10_001)) + "}}",)], "json string")
    got = snapshot.read(odd).withColumn("raw_tags", F.to_json("raw_tags")).collect()
    assert [r["error"] for r in got] == ["not a snapshot", "not a snapshot", None, "too many entries"]
    assert got[2]["snapshot"]["stream_info"]["length_secs"] is None and got[2]["raw_tags"] == '{"a":[1]}'


def test_pictures(spark, folder):
    rows = audio.read_audio(spark, folder, "a.m4a")
    assert [(r.mime_type, r.picture_type, bytes(r.data)) for r in artwork.covers(rows).collect()] == [("image/jpeg", 3, b"\xff\xd8\xff\xe0")]
    items = spark.createDataFrame([("f", 0, "TITLE", ["t"])], "file_id string, ordinal int, key string, values array<string>")
    new = spark.createDataFrame([("f", "image/png", 3, "dé", bytearray(b"\x89PNG"))], "file_id string, mime_type string, picture_type int, description string, data binary")
    added = {r.key: r["values"] for r in artwork.add_pictures(items, new).collect()}
    block = vorbis.picture(base64.b64decode(added["metadata_block_picture"][0]))
    assert (block["mime_type"], block["description"], base64.b64decode(block["data"])) == ("image/png", "dé", b"\x89PNG")
    assert artwork.clear_pictures(artwork.add_pictures(items, new)).count() == 1


def test_stream_text_and_unified(spark, folder):
    rows = audio.read_audio(spark, folder, "a.wav").select(render.stream_text("stream_info").alias("t")).collect()
    assert rows[0].t == "1.00 seconds, 1411 kbps, 44100 Hz, 2 channels, 16 bit"
    d = spark.createDataFrame([("f", "k", "changed", ["a"], ["b"]), ("g", "k", "unchanged", ["a"], ["a"])], "file_id string, key string, status string, left array<string>, right array<string>")
    assert {r.file_id: r.text for r in render.unified(d).collect()} == {"f": '--- left\n+++ right\n~ k: ["a"] → ["b"]\n', "g": "No differences"}


def test_ingestion(spark, folder, tmp_path):
    for _ in range(2):
        query = ingest.ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "a.*", per_trigger=7)
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("path").distinct().count() == len([n for n in FILES if n.startswith("a.")])
    assert ingest.arrivals(audio.scan(spark, folder)).agg(F.sum("files")).first()[0] >= len(FILES)


def test_probe_reads_both_ends_only(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in probe.probe(spark, folder).collect()}
    for name, (data, fmt, _) in FILES.items():
        assert (rows[name].format, rows[name].length, bytes(rows[name].header), bytes(rows[name].tail)) == (fmt, len(data), data[:128], data[-128:])
    assert rows["empty.flac"].format == "FLAC" and rows["note.txt"].format is None


def test_chunk_lookups(spark, folder):
    rows = chunks.chunks(audio.read_audio(spark, folder, "a.*"))
    assert chunks.find(rows, "fmt ").first().size == 16
    assert {r.path for r in chunks.findall(rows, "hdlr", recursive=True).collect()} == {"moov.trak.mdia.hdlr", "moov.udta.meta.hdlr"}
    assert {r.path for r in chunks.children(rows, "moov.udta").collect()} == {"moov.udta.meta", "moov.udta.chpl"}
    assert chunks.has(rows, "moov").where("found").count() == 1 and chunks.findall(rows, "moov").count() == 1


def test_mp4_with_many_atoms():
    many = b"\0\0\0\x08free" * (mp4.CHILDREN + 1)
    assert len(list(mp4.atoms(many))) == mp4.CHILDREN + 1
    assert mp4.parse(many + FILES["a.m4a"][0]).items == mp4.parse(FILES["a.m4a"][0]).items
    assert len(list(mp4.atoms((len(many)).to_bytes(4, "big") + b"moov" + many[8:]))) == mp4.CHILDREN + 1
    with pytest.raises(base.ParseError) as e:
        list(mp4.atoms((len(many) + 8).to_bytes(4, "big") + b"moov" + many))
    assert e.value.kind == "limit"
