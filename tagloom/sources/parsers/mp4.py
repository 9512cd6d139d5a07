"""MP4: atoms, sound track properties, ilst tags and chapters."""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

from tagloom.plans.dims import GENRES
from tagloom.sources.parsers.base import LIMITS, Bits, ParseError, Parsed, take, unpack
from tagloom.sources.parsers.streams import AC3_CHANNELS, AC3_RATES

#: Atoms that hold atoms, and bytes of their own before them.
_BOXES = {"moov": 0, "udta": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "ilst": 0, "meta": 4, "moof": 0, "traf": 0}
#: Caps on the depth of atoms and on children of one.
DEPTH, CHILDREN = 128, 100_000


def atoms(data: bytes, at: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, int]]:
    """(path, start of the body, end) of every atom, parents first."""
    end = len(data) if end is None else min(end, len(data))
    if depth > DEPTH:
        raise ParseError("mp4", "atoms too deep")
    for n in itertools.count():
        if at + 8 > end:
            return
        if path and n == CHILDREN:  # the file itself holds any number, as long fragmented files do
            raise ParseError("limit", f"more than {CHILDREN} atoms in {path}")
        size, head = unpack(">I", data, at)[0], 8
        name = data[at + 4 : at + 8].decode("latin-1")
        if size == 1:
            size, head = unpack(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ParseError("mp4", f"atom {name!r} of {size} bytes at {at}")
        here = f"{path}.{name}" if path else name
        yield here, at + head, at + size
        inside = _BOXES.get(name) if not path.endswith("ilst") else 0
        if inside is not None:
            yield from atoms(data, at + head + inside, at + size, here, depth + 1)
        at += size


def _data(data: bytes, start: int, end: int) -> list[tuple[int, bytes]]:
    """(type, value) of the data atoms of a tag."""
    out = []
    while start + 8 <= end:
        size, name = unpack(">I4s", data, start)
        if size < 8 or start + size > end:
            break
        if name == b"data" and size >= 16:
            out.append((unpack(">I", data, start + 8)[0] & 0xFFFFFF, data[start + 16 : start + size]))
        start += size
    return out


# Atoms of tags that hold text, and those that hold numbers.
TEXTS = ["©nam", "©alb", "©ART", "aART", "©wrt", "©day", "©cmt", "desc", "purd", "©grp", "©gen", "©lyr", "catg", "keyw", "©too", "©pub", "cprt", "soal", "soaa", "soar", "sonm", "soco", "sosn", "tvsh", "©wrk", "©mvn", "purl", "egid"]
NUMBERS = ["plID", "cnID", "geID", "atID", "sfID", "cmID", "tvsn", "tves", "tmpo", "©mvi", "©mvc", "akID", "shwm", "stik", "hdvd", "rtng"]


def known(name: str) -> bool:
    """Whether a tag atom is read as items or pictures; others are set aside as they are."""
    return name in TEXTS or name in NUMBERS or name in ("trkn", "disk", "gnre", "cpil", "pgap", "pcst", "covr", "----")


def _tag(out: Parsed, data: bytes, name: str, start: int, end: int) -> None:
    found = _data(data, start, end)
    if name in ("trkn", "disk"):
        for _, v in found:
            if len(v) >= 6:
                number, total = unpack(">HH", v, 2)
                out.put(name, [f"{number}/{total}" if total else str(number)])
    elif name == "gnre":
        for _, v in found:
            code = int.from_bytes(v, "big") - 1
            if 0 <= code < len(GENRES):
                out.put("©gen", [GENRES[code]])
    elif name in ("cpil", "pgap", "pcst"):
        for _, v in found[:1]:
            out.put(name, ["true" if v[:1] not in (b"", b"\0") else "false"])
    elif name == "covr":
        for kind, v in found:
            if len(v) > LIMITS.image:
                raise ParseError("limit", f"image of {len(v)} bytes")
            mime = "image/png" if v[:8] == b"\x89PNG\r\n\x1a\n" else "image/jpeg" if v[:3] == b"\xff\xd8\xff" else {13: "image/jpeg", 14: "image/png"}.get(kind, "")
            out.extra.setdefault("pictures", []).append({"mime_type": mime, "picture_type": 3, "description": "", "data": base64.b64encode(v).decode()})
    elif name == "----":
        mean = label = ""
        at = start
        while at + 12 <= end:
            size, part = unpack(">I4s", data, at)
            if size < 12 or at + size > end:
                break
            if part == b"mean":
                mean = data[at + 12 : at + size].decode("utf-8", "replace")
            elif part == b"name":
                label = data[at + 12 : at + size].decode("utf-8", "replace")
            at += size
        out.put(f"----:{mean}:{label}", [v.decode("utf-8", "replace") for _, v in found])
    elif name in NUMBERS:
        for _, v in found:
            out.put(name, [str(int.from_bytes(v, "big", signed=True))])
    elif name in TEXTS:
        for kind, v in found:
            out.put(name, [v.decode("utf-16-be" if kind == 2 else "utf-8", "replace")])
    else:
        out.extra.setdefault("unknown_atoms", []).append({"name": name, "data": base64.b64encode(data[start:end]).decode()})


def _entry(out: Parsed, data: bytes, start: int, end: int) -> None:
    """The first sample entry of the sound track's stsd atom."""
    size, codec = unpack(">I4s", data, start + 8)
    out.extra["codec"] = codec.decode("latin-1")
    version = unpack(">H", data, start + 24)[0]
    out.channels, out.bits_per_sample = unpack(">HH", data, start + 32)
    out.sample_rate = unpack(">I", data, start + 40)[0] >> 16
    at = start + 44 + {1: 16, 2: 36}.get(version, 0)
    stop = min(end, start + 8 + size)
    while at + 8 <= stop:
        n, name = unpack(">I4s", data, at)
        if n < 8:
            break
        if name == b"esds":
            _esds(out, data[at + 12 : at + n])
        elif name == b"alac" and n >= 36:
            _, _, bits, _, _, _, channels, _, _, rate, hertz = unpack(">IBBBBBBHIII", data, at + 12)
            out.bits_per_sample, out.channels, out.bitrate, out.sample_rate = bits, channels, rate, hertz
        elif name == b"dac3":
            bits = Bits(take(data, at + 8, 3))
            code, _, _, mode, lfe, rate = bits.read(2), bits.read(5), bits.read(3), bits.read(3), bits.read(1), bits.read(5)
            out.channels = AC3_CHANNELS[mode] + lfe
            out.bitrate = AC3_RATES[rate] * 1000 if rate < len(AC3_RATES) else None
            out.sample_rate = (48000, 44100, 32000)[code] if code < 3 else out.sample_rate
        at += n


def _esds(out: Parsed, body: bytes) -> None:
    at = 0
    while at < len(body):
        kind, size, at = body[at], 0, at + 1
        for _ in range(4):
            b = take(body, at, 1)[0]
            size, at = size << 7 | b & 0x7F, at + 1
            if not b & 0x80:
                break
        if kind == 3:
            flags = take(body, at, 3)[2]
            at += 3 + (2 if flags & 0x80 else 0) + (1 + body[at + 3] if flags & 0x40 else 0) + (2 if flags & 0x20 else 0)
        elif kind == 4:
            out.bitrate = unpack(">I", body, at + 9)[0] or None
            at += 13
        else:
            return


def parse(data: bytes) -> Parsed:
    out = Parsed()
    tree = list(atoms(data))
    if not any(p == "moov" for p, _, _ in tree):
        raise ParseError("mp4", "no moov atom")
    out.extra["chunks"] = [{"path": p, "offset": a, "size": b - a} for p, a, b in tree if "ilst." not in p]
    sound = None
    for k, (path, start, _) in enumerate(tree):
        if path == "moov.trak":
            inner = []
            for p, a, b in tree[k + 1 :]:
                if not p.startswith("moov.trak."):
                    break
                inner.append((p, a, b))
            kind = next((a for p, a, _ in inner if p == "moov.trak.mdia.hdlr"), None)
            if kind is not None and take(data, kind + 8, 4) == b"soun":
                sound = inner
                break
    if sound is None:
        raise ParseError("mp4", "no sound track")
    for path, start, end in sound:
        if path.endswith("mdia.mdhd"):
            scale, length = unpack(">IQ", data, start + 20) if data[start] == 1 else unpack(">II", data, start + 12)
            out.length_secs = length / scale if scale else None
        elif path.endswith("stbl.stsd") and unpack(">I", data, start + 4)[0]:
            _entry(out, data, start, end)
    for path, start, end in tree:
        if path.startswith("moov.udta.meta.ilst.") and path.count(".") == 4:
            _tag(out, data, path.rsplit(".", 1)[1], start, end)
        elif path == "moov.udta.chpl":
            out.extra["chapters"] = _chapters(data, start, end)
    out.items.sort()
    return out


def _chapters(data: bytes, start: int, end: int) -> list[dict]:
    count, at, out = take(data, start + 8, 1)[0], start + 9, []
    for _ in range(count):
        if at + 9 > end:
            break
        when, size = unpack(">QB", data, at)
        out.append({"start": when / 1e7, "title": take(data, at + 9, size).decode("utf-8", "replace")})
        at += 9 + size
    return out
