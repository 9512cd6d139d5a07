"""FLAC: stream properties, comments, pictures, seek points and cue sheets; and rewriting of the comments."""

from __future__ import annotations

import base64
from collections.abc import Iterator

from tagloom.sources.parsers import id3, vorbis
from tagloom.sources.parsers.base import Bits, Padding, ParseError, Parsed, padding, take, unpack


def stream_info(data: bytes, out: Parsed) -> Parsed:
    bits = Bits(take(data, 0, 34))
    low, high, small, large = bits.read(16), bits.read(16), bits.read(24), bits.read(24)
    out.sample_rate, out.channels, out.bits_per_sample = bits.read(20), bits.read(3) + 1, bits.read(5) + 1
    total = bits.read(36)
    if not out.sample_rate:
        raise ParseError("flac", "sample rate 0")
    out.length_secs = total / out.sample_rate
    out.bitrate = out.sample_rate * out.channels * out.bits_per_sample if total else 0
    out.extra |= {"total_samples": total, "min_block": low, "max_block": high, "min_frame": small, "max_frame": large, "md5": f"{bits.read(128):032x}"}
    return out


def blocks(data: bytes) -> Iterator[tuple[int, int, int, bool]]:
    """(type, start of the body, size, last) of each metadata block."""
    at = 0
    while size := id3.tag_size(data, at):
        at += size
    if take(data, at, 4) != b"fLaC":
        raise ParseError("flac", "no fLaC marker")
    at += 4
    while True:
        head = take(data, at, 4)
        size = int.from_bytes(head[1:], "big")
        yield head[0] & 0x7F, at + 4, size, bool(head[0] & 0x80)
        at += 4 + size
        if head[0] & 0x80:
            return


def parse(data: bytes) -> Parsed:
    out = Parsed()
    for k, (kind, at, size, _) in enumerate(blocks(data)):
        if k == 0 and kind != 0:
            raise ParseError("flac", "stream info isn't first")
        body = data[at : at + size]
        if kind == 0:
            stream_info(body, out)
        elif kind == 2:
            out.extra.setdefault("applications", []).append({"id": body[:4].decode("latin-1"), "size": max(0, size - 4), "data": base64.b64encode(body[4:]).decode()})
        elif kind == 3:
            out.extra["seek_points"] = [dict(zip(("sample", "offset", "samples"), unpack(">QQH", body, i), strict=True)) for i in range(0, size - size % 18, 18)]
        elif kind == 4:
            vorbis.decode(body, out)
        elif kind == 5:
            out.extra["cue_sheet"] = cue_sheet(body)
        elif kind == 6:
            out.extra.setdefault("pictures", []).append(vorbis.picture(body))
    return out


def cue_sheet(body: bytes) -> dict:
    catalog, lead, flags = unpack(">128sQB", body)
    count, at, tracks = unpack(">B", body, 395)[0], 396, []
    for _ in range(count):
        start, number, isrc, kind = unpack(">QB12sB", body, at)
        points = unpack(">B", body, at + 35)[0]
        at += 36
        tracks.append({"start": start, "number": number, "isrc": isrc.rstrip(b"\0").decode("latin-1"), "audio": not kind & 0x80, "pre_emphasis": bool(kind & 0x40), "indexes": [dict(zip(("offset", "number"), unpack(">QB", body, at + 12 * i), strict=True)) for i in range(points)]})
        at += 12 * points
    return {"catalog": catalog.rstrip(b"\0").decode("latin-1"), "lead_in": lead, "compact_disc": bool(flags & 0x80), "tracks": tracks}


def write(data: bytes, items: list[tuple[str, list[str]]], pictures: list[dict] | None = None, policy: Padding = padding) -> bytes:
    """The file with these comments instead of its own, these pictures if any are given, and one padding block, as policy tells, at the end of the blocks."""
    kept = [(k, data[a : a + s]) for k, a, s, _ in blocks(data) if k not in (1, 4) and (k != 6 or pictures is None)]
    _, at, size, _ = list(blocks(data))[-1]
    new = [kept[0], (4, vorbis.encode(items)), *kept[1:], *((6, vorbis.encode_picture(p)) for p in pictures or [])]
    left = at + size - 4 - sum(4 + len(b) for _, b in new) - 4
    new.append((1, bytes(min(max(0, policy(left, len(data) - at - size)), (1 << 24) - 1))))
    out = b"fLaC"
    for i, (kind, body) in enumerate(new):
        if len(body) >= 1 << 24:
            raise ParseError("limit", "block too large")
        out += bytes((kind | (0x80 if i == len(new) - 1 else 0),)) + len(body).to_bytes(3, "big") + body
    return out + data[at + size :]
