"""Small audio files made from their formats' rules."""

from __future__ import annotations

import struct
import uuid

from tagloom.sources.parsers import ape, asf, frames, id3, ogg, vorbis

ITEMS = [("TALB", ["An album"]), ("TCON", ["(17)"]), ("TIT2", ["Títle"]), ("TPE1", ["One", "Two"]), ("TRCK", ["3/12"]), ("TXXX:BARCODE", ["123"])]
COMMENTS = [("ARTIST", ["One", "Two"]), ("TITLE", ["Títle"]), ("TRACKNUMBER", ["3"])]
APE_ITEMS = [("Artist", ["One", "Two"]), ("Title", ["Títle"]), ("Track", ["3/12"])]


def riff(tag=b""):
    fmt = struct.pack("<HHIIHH", 1, 2, 44100, 176400, 4, 16)
    body = b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", 176400) + bytes(176400)
    if tag:
        body += b"id3 " + struct.pack("<I", len(tag)) + tag + b"\0" * (len(tag) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def aiff(tag=b""):
    rate = struct.pack(">HQ", 16383 + 15, 44100 << 48)
    comm = struct.pack(">HIH", 1, 88200, 16) + rate
    body = b"COMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">I", 8) + bytes(8)
    if tag:
        body += b"ID3 " + struct.pack(">I", len(tag)) + tag + b"\0" * (len(tag) & 1)
    return b"FORM" + struct.pack(">I", len(body) + 4) + b"AIFF" + body


def stream_info(samples=88200):
    n = 4096 << 240 | 4096 << 224 | 44100 << 156 - 24 + 24 - 12 - 8
    n = (4096 << (272 - 16)) | (4096 << (272 - 32)) | (44100 << (272 - 100)) | (1 << (272 - 103)) | (15 << (272 - 108)) | (samples << (272 - 144))
    return n.to_bytes(34, "big")


def flac(items=COMMENTS, pad=100):
    blocks = [(0, stream_info()), (4, vorbis.encode(items)), (1, bytes(pad))]
    out = b"fLaC"
    for i, (k, b) in enumerate(blocks):
        out += bytes((k | (0x80 if i == len(blocks) - 1 else 0),)) + len(b).to_bytes(3, "big") + b
    return out + b"\xff\xf8" + bytes(50)


def ogg_pages(packets, granule, serial=7):
    out = b""
    for i, p in enumerate(packets):
        lacing = bytes([255] * (len(p) // 255) + [len(p) % 255])
        last = i == len(packets) - 1
        head = struct.pack("<4sBBqIIIB", b"OggS", 0, (2 if i == 0 else 0) | (4 if last else 0), granule if last else 0, serial, i, 0, len(lacing)) + lacing
        check = ogg.crc(head + p)
        out += head[:22] + struct.pack("<I", check) + head[26:] + p
    return out


def ogg_vorbis():
    return ogg_pages([b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 44100, 0, 128000, 0) + b"\xb8\x01", b"\x03vorbis" + vorbis.encode(COMMENTS) + b"\x01", b"\x05vorbis" + bytes(40), bytes(100)], 88200)


def opus():
    return ogg_pages([b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0), b"OpusTags" + vorbis.encode(COMMENTS), bytes(10)], 96312)


def speex():
    return ogg_pages([b"Speex   " + bytes(20) + struct.pack("<IIIIIIi", 1, 80, 16000, 1, 4, 1, 27800) + bytes(24), vorbis.encode(COMMENTS), bytes(10)], 32000)


def ogg_flac():
    return ogg_pages([b"\x7fFLAC\x01\x00\x00\x01fLaC\x00\x00\x00\x22" + stream_info(0), b"\x84\x00\x00\x00" + vorbis.encode(COMMENTS), bytes(10)], 44100)


def theora():
    bits = 0
    for value, n in ((3, 8), (2, 8), (1, 8), (20, 16), (15, 16), (320, 24), (240, 24), (0, 8), (0, 8), (25, 32), (1, 32), (1, 24), (1, 24), (0, 8), (200000, 24), (32, 6), (6, 5), (0, 2), (0, 3)):
        bits = bits << n | value
    return ogg_pages([b"\x80theora" + bits.to_bytes(35, "big"), b"\x81theora" + vorbis.encode(COMMENTS), b"\x82theora", bytes(10)], (2 << 6) | 48)


def mp3(frames=20, tag=b"", xing=False, end=b""):
    frame = b"\xff\xfb\x90\x44" + bytes(417 - 4)
    first = frame
    if xing:
        first = frame[:4] + bytes(32) + b"Xing" + struct.pack(">III", 3, 1000, 417 * 20) + bytes(417 - 48 - 4)
        first = first[:417].ljust(417, b"\0")
    return tag + first + frame * (frames - 1) + end


def m4a():
    def atom(name, body):
        return struct.pack(">I", len(body) + 8) + name.encode("latin-1") + body

    def data(kind, value):
        return atom("data", struct.pack(">II", kind, 0) + value)

    free = atom("----", atom("mean", bytes(4) + b"com.apple.iTunes") + atom("name", bytes(4) + b"ISRC") + data(1, b"US1"))
    ilst = atom("ilst", atom("©nam", data(1, "Títle".encode())) + atom("©ART", data(1, b"One") + data(1, b"Two")) + atom("trkn", data(0, struct.pack(">HHHH", 0, 3, 12, 0))) + atom("cpil", data(21, b"\x01")) + atom("tmpo", data(21, b"\x00\x78")) + atom("covr", data(13, b"\xff\xd8\xff\xe0")) + free)
    meta = atom("meta", bytes(4) + atom("hdlr", bytes(4) + b"\0\0\0\0mdirappl" + bytes(9)) + ilst)
    esds = atom("esds", bytes(4) + b"\x03\x19\x00\x00\x00" + b"\x04\x11\x40\x15" + bytes(3) + struct.pack(">II", 200000, 128000) + b"\x05\x02\x12\x10")
    entry = atom("mp4a", bytes(6) + struct.pack(">H", 1) + bytes(8) + struct.pack(">HHI", 2, 16, 0) + struct.pack(">I", 44100 << 16) + esds)
    stbl = atom("stbl", atom("stsd", bytes(4) + struct.pack(">I", 1) + entry))
    mdia = atom("mdia", atom("mdhd", bytes(4) + struct.pack(">IIII", 0, 0, 44100, 88200) + bytes(4)) + atom("hdlr", bytes(8) + b"soun" + bytes(13)) + atom("minf", stbl))
    chpl = atom("chpl", bytes(8) + b"\x01" + struct.pack(">QB", 10_000_000, 3) + b"One")
    return atom("ftyp", b"M4A \0\0\0\0") + atom("moov", atom("trak", mdia) + atom("udta", meta + chpl))


def tagged(body, at_end=b""):
    return body + ape.encode(APE_ITEMS) + at_end


def monkeys():
    return tagged(b"MAC " + struct.pack("<HH", 3990, 0) + struct.pack("<I", 52) + bytes(40) + struct.pack("<HHIIIHHI", 2000, 0, 73728, 1000, 2, 16, 2, 44100) + bytes(30))


def wavpack():
    return tagged(struct.pack("<4sIHBBIIII", b"wvpk", 24, 0x410, 0, 0, 88200, 0, 88200, 1 | 9 << 23) + struct.pack("<I", 0))


def musepack():
    return tagged(b"MP+\x07" + struct.pack("<II", 77, 0) + struct.pack("<HhHh", 16384, -300, 0, 0) + bytes(60))


def musepack8():
    def packet(key, body):
        return key + bytes((len(body) + 3,)) + body

    return tagged(b"MPCK" + packet(b"SH", bytes(4) + b"\x08" + b"\x85\xb1\x08" + b"\x00" + b"\x00\x10") + packet(b"RG", struct.pack(">BhHhH", 1, 256 * 60, 0, 0, 0)) + b"SE\x03")


def tak():
    bits, at = 0, 0
    for value, n in ((0, 6), (0, 4), (0, 4), (88200, 35), (0, 3), (44100 - 6000, 18), (8, 5), (1, 4), (0, 1)):
        bits |= value << at
        at += n
    body = bits.to_bytes(10, "little")
    return tagged(b"tBaK" + b"\x01" + len(body).to_bytes(3, "little") + body + b"\x00\x00\x00\x00" + bytes(20))


def tta():
    return b"TTA1" + struct.pack("<HHHII", 1, 2, 16, 44100, 88200) + struct.pack("<I", 0) + id3.encode_v1(ITEMS)


def ofr():
    return tagged(b"OFR " + struct.pack("<I", 15) + struct.pack("<IHBBI", 176400, 0, 3, 1, 44100) + struct.pack("<H", 0x1000) + bytes(60))


def dsf(tag=b""):
    fmt = struct.pack("<IIIIIIQII", 1, 0, 2, 2, 2822400, 1, 5644800, 4096, 0)
    head = 28 + 12 + len(fmt) + 12
    return b"DSD " + struct.pack("<QQQ", 28, head + len(tag), head if tag else 0) + b"fmt " + struct.pack("<Q", 52) + fmt + b"data" + struct.pack("<Q", 12) + tag


def dff():
    def chunk(name, body):
        return name + struct.pack(">Q", len(body)) + body + b"\0" * (len(body) & 1)

    prop = chunk(b"PROP", b"SND " + chunk(b"FS  ", struct.pack(">I", 2822400)) + chunk(b"CHNL", struct.pack(">H", 2) + b"SLFTSRGT") + chunk(b"CMPR", b"DSD \x0enot compressed\0"))
    body = b"DSD " + prop + chunk(b"DSD ", bytes(705600)) + chunk(b"ID3 ", id3.encode(ITEMS))
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def wma():
    def obj(guid, body):
        return guid + struct.pack("<Q", len(body) + 24) + body

    def text(s):
        return (s + "\0").encode("utf-16-le")

    t, a = text("Títle"), text("One")
    content = struct.pack("<5H", len(t), len(a), 0, 0, 0) + t + a
    key, val = text("WM/AlbumTitle"), text("An album")
    num = text("WM/TrackNumber")
    extended = struct.pack("<H", 2) + struct.pack("<H", len(key)) + key + struct.pack("<HH", 0, len(val)) + val + struct.pack("<H", len(num)) + num + struct.pack("<HHI", 3, 4, 3)
    props = uuid.UUID(int=1).bytes_le + struct.pack("<QQQQQQ", 0, 0, 0, 30_000_000, 0, 1000) + bytes(16)
    props = uuid.UUID(int=1).bytes_le + struct.pack("<QQQ", 0, 0, 0) + struct.pack("<QQQ", 30_000_000, 0, 1000) + bytes(16)
    stream = asf.AUDIO + bytes(38) + struct.pack("<HHIIHH", 0x161, 2, 44100, 16000, 1, 16)
    body = obj(asf.FILE, props) + obj(asf.STREAM, stream) + obj(asf.CONTENT, content) + obj(asf.EXTENDED, extended)
    return asf.HEADER + struct.pack("<QIBB", len(body) + 30, 4, 1, 2) + body


def aac(frames=10):
    word = 0xFFF << 44 | 1 << 40 | 1 << 38 | 4 << 34 | 2 << 30 | 371 << 13 | 0x7FF << 2
    return (word.to_bytes(7, "big") + bytes(364)) * frames


def ac3():
    return b"\x0b\x77\x00\x00" + bytes((0 << 6 | 20, 8 << 3, 2 << 5, 0)) + bytes(24000 - 8)


def _track(events):
    return b"MTrk" + struct.pack(">I", len(events)) + events


def smf_ties():
    """Two tempos at one tick, of which the last holds: 960 ticks of 480 a beat in one second."""
    events = b"\x00\xff\x51\x03\x0f\x42\x40" + b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x87\x40\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + _track(events)


def lame():
    """A constant bitrate file whose encoder tag names the preset 1003."""
    tag = b"LAME3.97 " + bytes((0x01, 195)) + bytes(8) + bytes((0x23, 255)) + bytes(5) + struct.pack(">H", 1003)
    head = b"\xff\xfb\x90\x44" + bytes(32) + b"Info" + struct.pack(">III", 11, 1000, 417 * 20) + struct.pack(">I", 78) + tag
    return head.ljust(417, b"\0") + (b"\xff\xfb\x90\x44" + bytes(413)) * 19


#: ID3v2 frames that are no items, with their fields; bytes are in base64.
FRAMES = [
    ("APIC", {"encoding": 3, "mime": "image/png", "type": 3, "desc": "front", "data": "iVBORw0KGgo="}), ("PRIV", {"owner": "me", "data": "AAEC"}), ("GEOB", {"encoding": 1, "mime": "text/plain", "filename": "a.txt", "desc": "ü", "data": "aGk="}),
    ("SYLT", {"encoding": 3, "lang": "eng", "format": 2, "type": 1, "desc": "d", "lines": [{"text": "One", "time": 0}, {"text": "Two", "time": 1500}]}), ("USER", {"encoding": 3, "lang": "eng", "text": "free"}), ("OWNE", {"encoding": 0, "price": "EUR1", "date": "20200102", "seller": "S"}),
    ("ETCO", {"format": 2, "events": [{"type": 3, "time": 500}]}), ("EQU2", {"method": 1, "identification": "eq", "adjustments": [{"frequency": 100.5, "gain": -1.5}]}), ("SEEK", {"offset": 77}), ("SIGN", {"group": 129, "data": "c2ln"}), ("ENCR", {"owner": "o", "method": 130, "data": ""}), ("GRID", {"owner": "g", "group": 131, "data": "eA=="}), ("AENC", {"owner": "a", "preview_start": 1, "preview_length": 2, "data": ""}),
    ("RBUF", {"size": 4096, "info": 1, "offset": 9}), ("RVRB", {"left": 1, "right": 2, "bounce_left": 3, "bounce_right": 4, "feedback_ltl": 5, "feedback_ltr": 6, "feedback_rtr": 7, "feedback_rtl": 8, "premix_ltr": 9, "premix_rtl": 10}), ("POSS", {"format": 2, "position": 1234}), ("LINK", {"frame_id": "TIT2", "url": "http://x", "data": ""}), ("MCDI", {"data": "AQID"}), ("SYTC", {"format": 2, "data": "eAA="}),
    ("MLLT", {"frames": 1, "bytes": 417, "milliseconds": 26, "bits_for_bytes": 8, "bits_for_milliseconds": 8, "data": "AAA="}), ("COMR", {"encoding": 3, "price": "EUR2", "valid_until": "20300101", "contact": "http://s", "format": 0, "seller": "Shop", "desc": "file", "mime": "image/png", "data": ""}), ("ASPI", {"start": 0, "length": 100, "points": 1, "bits": 8, "data": "AA=="}),
    ("CHAP", {"element_id": "c1", "start_time": 0, "end_time": 1000, "start_offset": 4294967295, "end_offset": 4294967295, "sub_frames": [{"id": "TIT2", "value": ["Chapter ü"]}]}), ("CTOC", {"element_id": "toc", "flags": 3, "child_ids": ["c1"], "sub_frames": [{"id": "CHAP", "value": {"element_id": "c2", "start_time": 1, "end_time": 2, "start_offset": 0, "end_offset": 0, "sub_frames": []}}]}),
]


def id3_frames(only=None):
    """A version 2.4 tag of a title and of FRAMES."""
    body = b"TIT2" + bytes((0, 0, 0, 2, 0, 0)) + b"\x03T"
    for name, fields in FRAMES:
        if only is None or name in only:
            raw = frames.encode(name, fields)
            body += name.encode() + bytes((len(raw) >> s) & 0x7F for s in (21, 14, 7, 0)) + b"\0\0" + raw
    return b"ID3\x04\0\0" + bytes((len(body) >> s) & 0x7F for s in (21, 14, 7, 0)) + body


def smf(kind=1):
    def track(events):
        return b"MTrk" + struct.pack(">I", len(events)) + events

    tempo = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x83\x60\xff\x51\x03\x0f\x42\x40" + b"\x00\xff\x2f\x00"
    notes = b"\x00\x90\x40\x40" + b"\x87\x40\x40\x00" + b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, kind, 2, 480) + track(tempo) + track(notes)


FILES = {
    "a.wav": (riff(id3.encode(ITEMS)), "WAVE", 1.0), "a.aif": (aiff(id3.encode(ITEMS)), "AIFF", 2.0), "a.flac": (flac(), "FLAC", 2.0), "a.ogg": (ogg_vorbis(), "OggVorbis", 2.0), "a.opus": (opus(), "OggOpus", 2.0), "a.spx": (speex(), "OggSpeex", 2.0), "a.oga": (ogg_flac(), "OggFlac", 1.0), "a.ogv": (theora(), "OggTheora", 2.0), "a.mp3": (mp3(tag=id3.encode(ITEMS)), "MP3", 20 * 417 * 8 / 128000), "x.mp3": (mp3(xing=True), "MP3", 1000 * 1152 / 44100), "v1.mp3": (mp3(end=id3.encode_v1(ITEMS)), "MP3", 20 * 417 * 8 / 128000),
    "a.m4a": (m4a(), "MP4", 2.0), "a.ape": (monkeys(), "MonkeysAudio", (73728 + 1000) / 44100), "a.wv": (wavpack(), "WavPack", 2.0), "a.mpc": (musepack(), "Musepack", (77 * 1152 - 576) / 44100), "8.mpc": (musepack8(), "Musepack", 88200 / 44100), "a.tak": (tak(), "TAK", 2.0), "a.tta": (tta(), "TrueAudio", 2.0), "a.ofr": (ofr(), "OptimFROG", 2.0), "a.dsf": (dsf(id3.encode(ITEMS)), "DSF", 2.0), "a.dff": (dff(), "DSDIFF", 1.0), "a.wma": (wma(), "ASF", 2.0), "a.aac": (aac(), "AAC", 10 * 1024 / 44100), "a.ac3": (ac3(), "AC3", 1.0), "a.mid": (smf(), "SMF", 1.5), "ties.mid": (smf_ties(), "SMF", 1.0), "lame.mp3": (lame(), "MP3", 1000 * 1152 / 44100),
}
