"""Payloads of the ID3v2 frames that aren't text or links: fields by a specification per frame, both ways."""

from __future__ import annotations

import base64
from collections.abc import Callable

from tagloom.sources.parsers.base import ParseError, take

CODECS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
#: Fixed value: how deep chapters may hold chapters.
DEPTH = 4

# The fields of each frame, in order. Kinds: u1 to u4 numbers of bytes; latin and text end at a zero (text in
# the frame's encoding, which u1 "encoding" sets); lang and f8 are 3 and 8 characters; tail is text to the end; rest is
# bytes to the end; rows of (text, time), (type, time) or (frequency, gain); ids and frames as chapters have them.
SPECS: dict[str, list[tuple[str, str]]] = {
    "AENC": [("owner", "latin"), ("preview_start", "u2"), ("preview_length", "u2"), ("data", "rest")],
    "APIC": [("encoding", "u1"), ("mime", "latin"), ("type", "u1"), ("desc", "text"), ("data", "rest")],
    "ASPI": [("start", "u4"), ("length", "u4"), ("points", "u2"), ("bits", "u1"), ("data", "rest")],
    "CHAP": [("element_id", "latin"), ("start_time", "u4"), ("end_time", "u4"), ("start_offset", "u4"), ("end_offset", "u4"), ("sub_frames", "frames")],
    "COMR": [("encoding", "u1"), ("price", "latin"), ("valid_until", "f8"), ("contact", "latin"), ("format", "u1"), ("seller", "text"), ("desc", "text"), ("mime", "latin"), ("data", "rest")],
    "CTOC": [("element_id", "latin"), ("flags", "u1"), ("child_ids", "ids"), ("sub_frames", "frames")],
    "ENCR": [("owner", "latin"), ("method", "u1"), ("data", "rest")],
    "EQU2": [("method", "u1"), ("identification", "latin"), ("adjustments", "gains")],
    "ETCO": [("format", "u1"), ("events", "events")],
    "GEOB": [("encoding", "u1"), ("mime", "latin"), ("filename", "text"), ("desc", "text"), ("data", "rest")],
    "GRID": [("owner", "latin"), ("group", "u1"), ("data", "rest")],
    "LINK": [("frame_id", "f4"), ("url", "latin"), ("data", "rest")],
    "MCDI": [("data", "rest")],
    "MLLT": [("frames", "u2"), ("bytes", "u3"), ("milliseconds", "u3"), ("bits_for_bytes", "u1"), ("bits_for_milliseconds", "u1"), ("data", "rest")],
    "OWNE": [("encoding", "u1"), ("price", "latin"), ("date", "f8"), ("seller", "tail")],
    "POSS": [("format", "u1"), ("position", "number")],
    "PRIV": [("owner", "latin"), ("data", "rest")],
    "RBUF": [("size", "u3"), ("info", "u1"), ("offset", "number")],
    "RVRB": [("left", "u2"), ("right", "u2"), ("bounce_left", "u1"), ("bounce_right", "u1"), ("feedback_ltl", "u1"), ("feedback_ltr", "u1"), ("feedback_rtr", "u1"), ("feedback_rtl", "u1"), ("premix_ltr", "u1"), ("premix_rtl", "u1")],
    "SEEK": [("offset", "u4")],
    "SIGN": [("group", "u1"), ("data", "rest")],
    "SYLT": [("encoding", "u1"), ("lang", "lang"), ("format", "u1"), ("type", "u1"), ("desc", "text"), ("lines", "lines")],
    "SYTC": [("format", "u1"), ("data", "rest")],
    "USER": [("encoding", "u1"), ("lang", "lang"), ("text", "tail")],
}
#: The fields that, behind the frame's id, tell frames of one kind apart.
_KEYS = {"APIC": ["desc"], "GEOB": ["desc"], "CHAP": ["element_id"], "CTOC": ["element_id"], "EQU2": ["identification"], "USER": ["lang"], "SYLT": ["desc", "lang"], "ENCR": ["owner"], "AENC": ["owner"], "GRID": ["group"], "PRIV": ["owner"], "LINK": ["frame_id", "url"], "SIGN": ["group"]}

Split = Callable[[bytes], list[tuple[str, bytes]]]


def text(codec: int, data: bytes) -> str:
    name = CODECS[codec] if codec < 4 else "latin-1"
    if name == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        name = "utf-16-le"
    return data.decode(name, "replace")


def split(codec: int, data: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the first terminator of a codec."""
    if codec in (1, 2):
        for i in range(0, len(data) - 1, 2):
            if data[i : i + 2] == b"\0\0":
                return data[:i], data[i + 2 :]
        return data, b""
    head, _, rest = data.partition(b"\0")
    return head, rest


def _ended(codec: int, value: str) -> bytes:
    return _bytes(codec, value) + (b"\0\0" if codec in (1, 2) else b"\0")


def _bytes(codec: int, value: str) -> bytes:
    return (b"\xff\xfe" + value.encode("utf-16-le")) if codec == 1 else value.encode(CODECS[codec] if codec < 4 else "latin-1", "replace")


def key(frame: str, fields: dict) -> str:
    return ":".join([frame, *(str(fields.get(k, "")) for k in _KEYS.get(frame, []))])


def decode(frame: str, data: bytes, subframes: Split, depth: int = 0) -> dict:
    """The fields of a frame's payload; bytes are in base64. Frames without a specification are bytes alone."""
    out: dict = {}
    codec = 0
    for name, kind in SPECS.get(frame, [("data", "rest")]):
        if kind[0] == "u":
            n = int(kind[1:])
            out[name], data = int.from_bytes(take(data, 0, n), "big"), data[n:]
            codec = out[name] if name == "encoding" else codec
        elif kind in ("lang", "f8", "f4"):
            n = {"lang": 3, "f8": 8, "f4": 4}[kind]
            out[name], data = take(data, 0, n).decode("latin-1"), data[n:]
        elif kind == "latin":
            head, data = split(0, data)
            out[name] = head.decode("latin-1")
        elif kind == "text":
            head, data = split(codec, data)
            out[name] = text(codec, head)
        elif kind == "tail":
            out[name], data = text(codec, split(codec, data)[0]), b""
        elif kind == "rest":
            out[name] = base64.b64encode(data).decode()
        elif kind == "number":
            out[name] = int.from_bytes(data, "big")
        elif kind == "events":
            out[name] = [{"type": data[i], "time": int.from_bytes(data[i + 1 : i + 5], "big")} for i in range(0, len(data) - 4, 5)]
        elif kind == "gains":
            out[name] = [{"frequency": int.from_bytes(data[i : i + 2], "big") / 2, "gain": int.from_bytes(data[i + 2 : i + 4], "big", signed=True) / 512} for i in range(0, len(data) - 3, 4)]
        elif kind == "lines":
            out[name] = []
            while data:
                head, data = split(codec, data)
                out[name].append({"text": text(codec, head), "time": int.from_bytes(take(data, 0, 4), "big")})
                data = data[4:]
        elif kind == "ids":
            count, data = take(data, 0, 1)[0], data[1:]
            out[name] = []
            for _ in range(count):
                if not data:
                    break
                head, data = split(0, data)
                out[name].append(head.decode("latin-1"))
        elif kind == "frames":
            if depth >= DEPTH and data:
                raise ParseError("limit", "chapters too deep")
            out[name] = [{"id": f, "value": _inner(f, d, subframes, depth + 1)} for f, d in subframes(data)]
    return out


def _inner(frame: str, data: bytes, subframes: Split, depth: int) -> object:
    if frame in SPECS or frame[0] not in "TW":
        return decode(frame, data, subframes, depth)
    if frame[0] == "W" and frame != "WXXX":
        return data.split(b"\0")[0].decode("latin-1")
    codec, rest, out = data[0] if data else 0, data[1:], []
    while rest:
        head, rest = split(codec, rest)
        out.append(text(codec, head))
    return out


def encode(frame: str, fields: dict) -> bytes:
    """A frame's payload from its fields, as decode() gives them; sub-frames are text frames of version 2.4."""
    out, codec = b"", fields.get("encoding", 0)
    for name, kind in SPECS.get(frame, [("data", "rest")]):
        value = fields.get(name, 0 if kind[0] == "u" or kind == "number" else [] if kind in ("events", "gains", "lines", "ids", "frames") else "")
        if kind[0] == "u":
            out += int(value).to_bytes(int(kind[1:]), "big")
        elif kind in ("lang", "f8", "f4"):
            n = {"lang": 3, "f8": 8, "f4": 4}[kind]
            out += value.encode("latin-1", "replace")[:n].ljust(n, b"\0")
        elif kind == "latin":
            out += value.encode("latin-1", "replace") + b"\0"
        elif kind == "text":
            out += _ended(codec, value)
        elif kind == "tail":
            out += _bytes(codec, value)
        elif kind == "rest":
            out += base64.b64decode(value)
        elif kind == "number":
            out += int(value).to_bytes(4, "big")
        elif kind == "events":
            out += b"".join(bytes((e["type"],)) + e["time"].to_bytes(4, "big") for e in value)
        elif kind == "gains":
            out += b"".join(round(e["frequency"] * 2).to_bytes(2, "big") + round(e["gain"] * 512).to_bytes(2, "big", signed=True) for e in value)
        elif kind == "lines":
            out += b"".join(_ended(codec, e["text"]) + e["time"].to_bytes(4, "big") for e in value)
        elif kind == "ids":
            out += bytes((len(value),)) + b"".join(v.encode("latin-1", "replace") + b"\0" for v in value)
        elif kind == "frames":
            for sub in value:
                own = sub["value"]
                body = encode(sub["id"], own) if isinstance(own, dict) else b"\x03" + "\0".join(own).encode() if isinstance(own, list) else own.encode("latin-1", "replace")
                out += sub["id"].encode() + bytes((len(body) >> s) & 0x7F for s in (21, 14, 7, 0)) + b"\0\0" + body
    return out
