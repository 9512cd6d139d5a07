"""New bytes of Ogg, MP4 and ASF files with other tags."""

from __future__ import annotations

import base64
import struct

from tagloom.sources.parsers import asf, mp4, ogg, vorbis
from tagloom.sources.parsers.base import Padding, ParseError, padding, unpack

Items = list[tuple[str, list[str]]]


def _paged(packets: list[bytes], serial: int, first: int) -> list[bytes]:
    """Pages of whole packets, numbered from first."""
    lacing: list[tuple[int, bytes]] = []
    for p in packets:
        sizes = [255] * (len(p) // 255) + [len(p) % 255]
        at = 0
        for n in sizes:
            lacing.append((n, p[at : at + n]))
            at += n
    out, broken = [], False
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        whole = any(n < 255 for n, _ in part)
        out.append(_page(1 if broken else 0, 0 if whole else -1, serial, first + len(out), bytes(n for n, _ in part), b"".join(b for _, b in part)))
        broken = part[-1][0] == 255
    return out


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", ogg.crc(head + body)) + head[26:] + body


def ogg_tags(data: bytes, items: Items, pictures: list[dict] | None = None) -> bytes:
    """The comment packet replaced; header pages made anew, later pages of the stream numbered anew. Pictures are comments."""
    if pictures is not None:
        blocks = [base64.b64encode(vorbis.encode_picture(p)).decode() for p in pictures]
        items = [x for x in items if x[0].lower() != "metadata_block_picture"] + ([("metadata_block_picture", blocks)] if blocks else [])
    serial, found = ogg.packets(data, 1)
    head = found[0]
    marks = {b"\x01vorbis": (b"\x03vorbis", b"\x01", 3), b"OpusHead": (b"OpusTags", b"", 2), b"Speex   ": (b"", b"", 2), b"\x80theora": (b"\x81theora", b"", 3)}
    flac = head[:5] == b"\x7fFLAC"
    mark = next((v for k, v in marks.items() if head.startswith(k)), None)
    if not mark and not flac:
        raise ParseError("ogg", "unknown codec")
    at, pages, headers, part, done = 0, [], [], b"", False
    while not done:
        p = ogg.page(data, at)
        at = p.end
        if p.serial != serial:
            pages.append(p)
            continue
        i = 0
        for k, size in enumerate(p.lacing):
            part += p.body[i : i + size]
            i += size
            if size < 255:
                headers.append(part)
                part = b""
                done = (headers[-1][0] & 0x80 or False) if flac and len(headers) > 1 else not flac and len(headers) == mark[2]
                if done and k + 1 < len(p.lacing):
                    raise ParseError("ogg", "audio in a header page")
    vendor = "tagloom"
    if flac:
        body = vorbis.encode(items, vendor)
        headers[1] = bytes((headers[1][0] & 0x80 | 4,)) + len(body).to_bytes(3, "big") + body
    else:
        headers[1] = mark[0] + vorbis.encode(items, vendor) + mark[1]
    out = [_page(2, 0, serial, 0, bytes([255] * (len(head) // 255) + [len(head) % 255]), head)]
    out += [_page(p.flags, p.granule, p.serial, i, p.lacing, p.body) for i, p in enumerate(pages)]
    new = _paged(headers[1:], serial, 1)
    out += new
    number = len(new) + 1
    while at < len(data):
        p = ogg.page(data, at)
        if p.serial == serial:
            out.append(_page(p.flags, p.granule, serial, number, p.lacing, p.body))
            number += 1
        else:
            out.append(data[at : p.end])
        at = p.end
    return b"".join(out)


def _atom(name: str, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name.encode("latin-1") + body


def _data(kind: int, value: bytes) -> bytes:
    return _atom("data", struct.pack(">II", kind, 0) + value)


_NUMBERS = {"tmpo": 2, "stik": 1, "rtng": 1, "plID": 8, "cnID": 4, "geID": 4, "atID": 4, "sfID": 4, "cmID": 4, "akID": 1, "tvsn": 4, "tves": 4, "hdvd": 1, "shwm": 1, "©mvc": 2, "©mvi": 2}


def _ilst(items: Items) -> bytes:
    out = b""
    for key, values in items:
        if key.startswith("----:"):
            _, mean, name = (key.split(":", 2) + ["", ""])[:3]
            out += _atom("----", _atom("mean", bytes(4) + mean.encode()) + _atom("name", bytes(4) + name.encode()) + b"".join(_data(1, v.encode()) for v in values))
        elif len(key.encode("latin-1", "replace")) != 4:
            raise ParseError("mp4", f"key {key!r}")
        elif key in ("trkn", "disk"):
            pairs = [[int(x) if x.strip().isdigit() else 0 for x in (v.split("/") + ["0"])[:2]] for v in values]
            out += _atom(key, b"".join(_data(0, struct.pack(">HHH", 0, min(n, 65535), min(t, 65535)) + (bytes(2) if key == "trkn" else b"")) for n, t in pairs))
        elif key in ("cpil", "pgap", "pcst"):
            out += _atom(key, _data(21, b"\x01" if values and values[0].lower() in ("1", "true", "yes") else b"\0"))
        elif key in _NUMBERS:
            out += _atom(key, b"".join(_data(21, int(v).to_bytes(_NUMBERS[key], "big", signed=True)) for v in values))
        else:
            out += _atom(key, b"".join(_data(1, v.encode()) for v in values))
    return _atom("ilst", out)


def _room(tree: list[tuple[str, int, int]]) -> int:
    """Bytes that the present tags and the free space behind them have."""
    return sum(b - a + 8 for p, a, b in tree if p in ("moov.udta.meta.ilst", "moov.udta.meta.free")) - 8


def mp4_tags(data: bytes, items: Items, pictures: list[dict] | None = None, policy: Padding = padding) -> bytes:
    """The ilst replaced, pictures and unknown atoms kept; chunk offsets moved by what moov has grown where the sound data stand behind it."""
    tree = list(mp4.atoms(data))
    moov = next(((a, b) for p, a, b in tree if p == "moov"), None)
    if moov is None:
        raise ParseError("mp4", "no moov atom")
    start, end = moov[0] - 8, moov[1]
    if unpack(">I", data, start)[0] == 1:
        start -= 8
    ilst = _ilst(items)
    others, new = b"", {k[:4] for k, _ in items}
    for p, a, b in tree:
        name = p.rsplit(".", 1)[-1]
        if p.startswith("moov.udta.meta.ilst.") and p.count(".") == 4 and (name == "covr" and pictures is None or not mp4.known(name) and name not in new):
            others += data[a - 8 : b]
    if pictures:
        others += _atom("covr", b"".join(_data(14 if p.get("mime_type") == "image/png" else 13, base64.b64decode(p["data"])) for p in pictures))
    ilst = _atom("ilst", ilst[8:] + others)
    meta = _atom("meta", bytes(4) + _atom("hdlr", bytes(8) + b"mdirappl" + bytes(9)) + ilst + _atom("free", bytes(max(0, policy(_room(tree) - len(ilst), len(data) - end)))))
    children, udta = [], b""
    for p, a, b in tree:
        if p.count(".") == 1 and p.startswith("moov.") and p != "moov.udta":
            children.append((a, data[a - 8 : b]))
        elif p.count(".") == 2 and p.startswith("moov.udta.") and p != "moov.udta.meta":
            udta += data[a - 8 : b]
    body = b"".join(c for _, c in children)
    new = _atom("moov", body + _atom("udta", meta + udta))
    shift = len(new) - (end - start)
    out = bytearray(data[:start] + new + data[end:])
    for p, a, b in mp4.atoms(bytes(out)):
        if p.endswith((".stco", ".co64")):
            fmt, size = (">I", 4) if p.endswith(".stco") else (">Q", 8)
            for i in range(unpack(">I", bytes(out[a + 4 : a + 8]))[0]):
                at = a + 8 + size * i
                where = struct.unpack_from(fmt, out, at)[0]
                if where >= end:
                    struct.pack_into(fmt, out, at, where + shift)
    return bytes(out)


_CONTENT = ("Title", "Author", "Copyright", "Description", "Rating")


def _utf16(text: str) -> bytes:
    return (text + "\0").encode("utf-16-le")


def _attribute(old: tuple[int, bytes] | None, text: str) -> tuple[int, bytes]:
    """(type, bytes) of a value: the old ones if they read the same, a number of the old type if it can be one, else text."""
    if old and asf.value(*old, wide_bool=False) == text:
        return old
    if old and old[0] == 2 and text.lower() in ("true", "false", "0", "1"):
        return 2, (1 if text.lower() in ("true", "1") else 0).to_bytes(2, "little")
    if old and old[0] in (3, 4, 5) and text.isdigit() and int(text) < 1 << 8 * (size := {3: 4, 4: 8, 5: 2}[old[0]]):
        return old[0], int(text).to_bytes(size, "little")
    return 0, _utf16(text)


def asf_tags(data: bytes, items: Items, pictures: list[dict] | None = None) -> bytes:
    """Content objects replaced: five fields in their own, others with one value in the extended one, the rest in the library.

    Values keep the types they had, bytes too; pictures are kept unless nothing is to be written.
    """
    if data[:16] != asf.HEADER:
        raise ParseError("asf", "no header object")
    size = unpack("<Q", data, 16)[0]
    kept = [(k, b) for k, b in asf._objects(data, 30, min(size, len(data))) if k not in (asf.CONTENT, asf.EXTENDED)]
    old, have = asf.attributes(data), dict(items)
    fields = [_utf16(have[n][0]) if have.get(n) else b"" for n in _CONTENT]
    single, rest = [], []
    for key, values in items:
        typed = [_attribute(dict(enumerate(old.get(key, []))).get(i), v) for i, v in enumerate(values)]
        if key in _CONTENT:
            rest += [(key, x) for x in typed[1:]]
        elif len(typed) == 1 and len(typed[0][1]) < 65536:
            single.append((key, typed[0]))
        else:
            rest += [(key, x) for x in typed]
    if pictures is not None:
        rest += [("WM/Picture", (1, asf.encode_picture(p))) for p in pictures]
    elif items:
        rest += [("WM/Picture", x) for x in old.get("WM/Picture", []) if x[0] == 1]
    new = []
    if any(fields):
        new.append((asf.CONTENT, struct.pack("<5H", *map(len, fields)) + b"".join(fields)))
    if single:
        wide = [(k, t, v.ljust(4, b"\0") if t == 2 else v) for k, (t, v) in single]
        new.append((asf.EXTENDED, struct.pack("<H", len(wide)) + b"".join(struct.pack("<H", len(_utf16(k))) + _utf16(k) + struct.pack("<HH", t, len(v)) + v for k, t, v in wide)))
    library = struct.pack("<H", len(rest)) + b"".join(struct.pack("<HHHHI", 0, 0, len(_utf16(k)), t, len(v)) + _utf16(k) + v for k, (t, v) in rest)
    pack = lambda guid, body: guid + struct.pack("<Q", len(body) + 24) + body
    out = []
    for k, b in kept:
        if k == asf.EXTENSION:
            inner = b"".join(pack(x, y) for x, y in asf._objects(b, 22, len(b)) if x not in (asf.METADATA, asf.LIBRARY))
            inner += pack(asf.LIBRARY, library) if rest else b""
            b, rest = b[:18] + struct.pack("<I", len(inner)) + inner, []
        out.append((k, b))
    if rest:
        out.append((asf.EXTENSION, asf._guid("ABD3D211-A9BA-11CF-8EE6-00C00C205365") + b"\x06\0" + struct.pack("<I", len(library) + 24) + pack(asf.LIBRARY, library)))
    out = [x for x in out if x[0] != asf.EXTENSION] + new + [x for x in out if x[0] == asf.EXTENSION]  # a field's first value comes first
    body = b"".join(pack(k, b) for k, b in out)
    return asf.HEADER + struct.pack("<QI", len(body) + 30, len(out)) + data[28:30] + body + data[min(size, len(data)) :]
