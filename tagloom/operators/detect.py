"""Format detection: every format's score of the first 128 bytes and the name, as one expression; the greatest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = 128


def _has(text: Column, mark: str) -> Column:
    return F.contains(text, F.lit(mark)).cast("int")


def _starts(text: Column, *marks: str) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def _ext(extension: Column, scores: dict[str, int]) -> Column:
    out = F.lit(0)
    for names, score in scores.items():
        out = F.when(extension.isin(*names.split()), score).otherwise(out)
    return out


def scores(header: Column, path: Column) -> list[tuple[str, Column]]:
    """(format, score) in order of rank. The header is compared as Latin-1 text, one character a byte."""
    h = F.decode(F.substr(header, F.lit(1), F.lit(HEADER)), "iso-8859-1")
    ext = F.coalesce(F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1), F.lit(""))
    at = lambda i, n: F.substr(h, F.lit(i + 1), F.lit(n))
    flag = lambda c: c.cast("int")
    ogg = flag(_starts(h, "OggS"))
    brand = at(8, 4)
    ftyp = at(4, 4) == "ftyp"
    brands = ("M4A ", "M4B ", "M4P ", "mp41", "mp42", "isom", "3g2a", "3g2b", "3g2c")
    theora = ogg + 2 * ogg * _has(h, "\u0080theora") + 2 * ogg * _has(h, "\u0081theora")
    asf = "\x30\x26\xb2\x75\x8e\x66\xcf\x11\xa6\xd9\x00\xaa\x00\x62\xce\x6c"
    id3 = flag(_starts(h, "ID3"))
    mthd, midi = _starts(h, "MThd"), ext.isin("mid", "midi", "kar")
    return [
        ("MP4", F.when(ftyp, 10 + 5 * flag(brand.isin(*brands))).otherwise(0) + _ext(ext, {"m4a mp4 m4b m4p 3g2 3gp": 3})),
        ("ASF", 2 * flag(_starts(h, asf)) + _ext(ext, {"wma asf wmv": 1})),
        ("OggVorbis", ogg * _has(h, "\x01vorbis")),
        ("OggFlac", ogg * (_has(h, "FLAC") + _has(h, "fLaC"))),
        ("OggOpus", _has(h, "OpusHead") + _has(h, "OggS")),
        ("OggSpeex", ogg * _has(h, "Speex   ") + 2 * flag(ext == "spx") * ogg),
        ("OggTheora", F.when(ogg == 1, theora + F.when(ext == "ogv", 2).when((ext == "ogg") & (theora > 1), 1).otherwise(0)).otherwise(flag(ext == "ogv"))),
        ("FLAC", 10 * flag(_starts(h, "fLaC") | (_starts(h, "ID3") & F.contains(h, F.lit("fLaC")))) + _ext(ext, {"flac": 3})),
        ("AIFF", 10 * flag(_starts(h, "FORM") & at(8, 4).isin("AIFF", "AIFC")) + _ext(ext, {"aiff": 3, "aif": 2, "aifc": 1})),
        ("WAVE", 10 * flag(_starts(h, "RIFF") & (at(8, 4) == "WAVE")) + _ext(ext, {"wav": 3, "wave": 2})),
        ("DSDIFF", 2 * flag(_starts(h, "FRM8")) + _ext(ext, {"dff": 1})),
        ("DSF", 2 * flag(_starts(h, "DSD ")) + _ext(ext, {"dsf": 1})),
        ("MonkeysAudio", flag(_starts(h, "MAC ")) + _ext(ext, {"ape": 11})),
        ("WavPack", 2 * flag(_starts(h, "wvpk")) + _ext(ext, {"wv": 1})),
        ("TAK", flag(_starts(h, "tBaK")) + _ext(ext, {"tak": 1})),
        ("TrueAudio", flag(_starts(h, "TTA")) + id3 + _ext(ext, {"tta": 2})),
        ("OptimFROG", flag(_starts(h, "OFR")) + _ext(ext, {"ofr ofs": 1})),
        ("MP3", 2 * flag(_starts(h, "\xff\xf2", "\xff\xf3", "\xff\xfa", "\xff\xfb")) + 2 * id3 + _ext(ext, {"mp3 mp2 mpg mpeg": 1})),
        ("Musepack", 2 * flag(_starts(h, "MP+")) + 2 * flag(_starts(h, "MPCK")) + _ext(ext, {"mpc": 1})),
        ("APEv2", 10 * flag(_starts(h, "APETAGEX"))),
        ("ID3", id3),
        ("AAC", flag(_starts(h, "ADIF")) + _ext(ext, {"aac aacp adts adif": 1})),
        ("AC3", 2 * flag(_starts(h, "\x0b\x77")) + _ext(ext, {"ac3 eac3": 1})),
        ("SMF", F.when(mthd & midi, 100).when(mthd, 50).when(midi, 10).otherwise(0)),
    ]


def detect_format(header: Column | str, path: Column | str) -> Column:
    """The format with the greatest score, the first of equals; null if every score is 0."""
    h, p = (F.col(x) if isinstance(x, str) else x for x in (header, path))
    rated = [F.struct(score.cast("int").alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("name")) for rank, (name, score) in enumerate(scores(h, p))]
    best = F.array_max(F.array(*rated))
    return F.when(best["score"] > 0, best["name"])


def with_format(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Files with a format column. The content is cut to its header first, so the rest of the plan need not carry it."""
    return files.withColumn("format", detect_format(F.substr(F.col(content), F.lit(1), F.lit(HEADER)), F.col(path)))


#: Marks at a file's start and the formats they speak for, in the order in which they are tried.
MAGIC = [("ID3", "MP3"), ("fLaC", "FLAC"), ("ftyp", "MP4"), ("OggS", None), ("RIFF", "WAVE"), ("FORM", "AIFF"), ("0&\u00b2u", "ASF"), ("DSD ", "DSF"), ("FRM8", "DSDIFF"), ("MAC ", "MonkeysAudio"), ("wvpk", "WavPack"), ("MThd", "SMF")]


def magic_first(header: Column | str, path: Column | str) -> Column:
    """The format by the first mark that fits, else an MPEG frame, else the name: quicker than scores, and it may differ from them."""
    raw = F.col(header) if isinstance(header, str) else header
    h = F.decode(F.substr(raw, F.lit(1), F.lit(HEADER)), "iso-8859-1")
    out = None
    for mark, fmt in MAGIC:
        fits = F.substr(h, F.lit(5), F.lit(4)) == mark if mark == "ftyp" else h.startswith(mark)
        value = F.lit(fmt) if fmt else F.when(F.octet_length(raw) >= 36, ogg_codec(raw)).otherwise("Ogg")
        out = F.when(fits, value) if out is None else out.when(fits, value)
    second = F.conv(F.hex(F.substr(raw, F.lit(2), F.lit(1))), 16, 10).cast("int")
    frame = (F.hex(F.substr(raw, F.lit(1), F.lit(1))) == "FF") & (second >= 0xE0) & (second.bitwiseAND(0x06) > 0)
    return F.when(F.octet_length(raw) >= 4, out.when(frame, "MP3").otherwise(by_extension(path))).otherwise(by_extension(path))


def by_extension(path: Column | str) -> Column:
    """The format that a name alone speaks for."""
    p = F.col(path) if isinstance(path, str) else path
    names = {"MP3": "mp3 mp2 mpg mpeg", "FLAC": "flac", "MP4": "m4a m4b m4p mp4 3g2 3gp", "ASF": "wma asf wmv", "OggVorbis": "ogg oga", "OggOpus": "opus", "OggSpeex": "spx", "OggTheora": "ogv", "OggFlac": "oggflac", "WAVE": "wav wave", "AIFF": "aiff aif aifc", "MonkeysAudio": "ape", "WavPack": "wv", "Musepack": "mpc mp+ mpp", "TAK": "tak", "TrueAudio": "tta", "OptimFROG": "ofr ofs", "DSF": "dsf", "DSDIFF": "dff", "AAC": "aac aacp adts adif", "AC3": "ac3 eac3", "SMF": "mid midi kar"}
    pairs = [F.lit(x) for f, exts in names.items() for e in exts.split() for x in (e, f)]
    return F.try_element_at(F.create_map(*pairs), F.regexp_extract(F.lower(p), r"\.([a-z0-9+]+)$", 1))


def ogg_codec(header: Column | str) -> Column:
    """The codec that the first page of an Ogg stream names, else 'Ogg'."""
    h = F.decode(F.col(header) if isinstance(header, str) else header, "iso-8859-1")
    head = lambda i, n: F.substr(h, F.lit(i + 1), F.lit(n))
    return F.when(head(28, 7) == "\x01vorbis", "OggVorbis").when(head(28, 8) == "OpusHead", "OggOpus").when(head(28, 8) == "Speex   ", "OggSpeex").when(head(28, 7) == "\x80theora", "OggTheora").when(head(29, 4) == "FLAC", "OggFlac").otherwise("Ogg")
