"""ASF (WMA): header objects, stream properties and typed attributes."""

from __future__ import annotations

import base64
import uuid

from tagloom.sources.parsers.base import ParseError, Parsed, take, unpack


def _guid(text: str) -> bytes:
    return uuid.UUID(text).bytes_le


# Object ids.
HEADER = _guid("75B22630-668E-11CF-A6D9-00AA0062CE6C")
FILE = _guid("8CABDCA1-A947-11CF-8EE4-00C00C205365")
STREAM = _guid("B7DC0791-A9B7-11CF-8EE6-00C00C205365")
AUDIO = _guid("F8699E40-5B4D-11CF-A8FD-00805F5C442B")
CONTENT = _guid("75B22633-668E-11CF-A6D9-00AA0062CE6C")
EXTENDED = _guid("D2D0A440-E307-11D2-97F0-00A0C95EA850")
EXTENSION = _guid("5FBF03B5-A92E-11CF-8EE3-00C00C205365")
METADATA = _guid("C5F8CBEA-5BAF-4877-8467-AA8C44FA4CCA")
LIBRARY = _guid("44231C94-9498-49D1-A141-1D134E457054")


def _text(raw: bytes) -> str:
    return raw.decode("utf-16-le", "replace").split("\0")[0]


def value(kind: int, raw: bytes, wide_bool: bool) -> str:
    """An attribute's value as text; types are text, bytes, bool, 32, 64 and 16 bits, and GUID."""
    if kind == 0:
        return _text(raw)
    if kind == 2:
        return "True" if int.from_bytes(raw[: 4 if wide_bool else 2], "little") else "False"
    if kind in (3, 4, 5):
        return str(int.from_bytes(raw[: {3: 4, 4: 8, 5: 2}[kind]], "little"))
    if kind == 6 and len(raw) == 16:
        return str(uuid.UUID(bytes_le=raw)).upper()
    return f"[{len(raw)} bytes]"


def _objects(data: bytes, at: int, end: int):
    while at + 24 <= end:
        size = unpack("<Q", data, at + 16)[0]
        if size < 24 or at + size > end:
            raise ParseError("asf", f"object of {size} bytes at {at}")
        yield data[at : at + 16], data[at + 24 : at + size]
        at += size


def _picture(raw: bytes) -> dict:
    size, at = unpack("<I", raw, 1)[0], 5
    texts = []
    for _ in range(2):
        end = at
        while raw[end : end + 2] != b"\0\0":
            take(raw, end, 2)
            end += 2
        texts.append(raw[at:end].decode("utf-16-le", "replace"))
        at = end + 2
    return {"mime_type": texts[0], "picture_type": raw[0], "description": texts[1], "data": base64.b64encode(take(raw, at, size)).decode()}


def _add(out: Parsed, name: str, kind: int, raw: bytes, wide: bool) -> None:
    if name == "WM/Picture" and kind == 1:
        out.extra.setdefault("pictures", []).append(_picture(raw))
    else:
        out.put(name, [value(kind, raw, wide)])
        out.extra.setdefault("types", {})[name] = kind


def _object(out: Parsed, kind: bytes, body: bytes) -> None:
    if kind == FILE:
        play, preroll = unpack("<Q", body, 40)[0], unpack("<Q", body, 56)[0]
        out.length_secs = max(0.0, play / 1e7 - preroll / 1e3)
    elif kind == STREAM and body[:16] == AUDIO and out.sample_rate is None:
        codec, out.channels, out.sample_rate, rate, _, out.bits_per_sample = unpack("<HHIIHH", body, 54)
        out.bitrate = rate * 8
        out.extra["codec"] = codec
    elif kind == CONTENT:
        sizes, at = unpack("<5H", body), 10
        for name, size in zip(("Title", "Author", "Copyright", "Description", "Rating"), sizes, strict=True):
            text = _text(take(body, at, size))
            at += size
            if text:
                out.put(name, [text])
    elif kind == EXTENDED:
        count, at = unpack("<H", body)[0], 2
        for _ in range(count):
            n = unpack("<H", body, at)[0]
            name = _text(take(body, at + 2, n))
            sort, size = unpack("<HH", body, at + 2 + n)
            _add(out, name, sort, take(body, at + 6 + n, size), True)
            at += 6 + n + size
    elif kind in (METADATA, LIBRARY):
        count, at = unpack("<H", body)[0], 2
        for _ in range(count):
            _, _, n, sort, size = unpack("<HHHHI", body, at)
            name = _text(take(body, at + 12, n))
            _add(out, name, sort, take(body, at + 12 + n, size), False)
            at += 12 + n + size
    elif kind == EXTENSION:
        for k, b in _objects(body, 22, len(body)):
            _object(out, k, b)


def attributes(data: bytes) -> dict[str, list[tuple[int, bytes]]]:
    """(type, bytes) of the typed attributes by name, in order; bools have two bytes."""
    out: dict[str, list[tuple[int, bytes]]] = {}

    def read(objects) -> None:
        for kind, body in objects:
            if kind in (EXTENDED, METADATA, LIBRARY):
                count, at = unpack("<H", body)[0], 2
                for _ in range(count):
                    if kind == EXTENDED:
                        n = unpack("<H", body, at)[0]
                        name = _text(take(body, at + 2, n))
                        sort, size = unpack("<HH", body, at + 2 + n)
                        at += 6 + n
                    else:
                        _, _, n, sort, size = unpack("<HHHHI", body, at)
                        name = _text(take(body, at + 12, n))
                        at += 12 + n
                    raw = take(body, at, size)
                    out.setdefault(name, []).append((sort, raw[:2] if sort == 2 else raw))
                    at += size
            elif kind == EXTENSION:
                read(_objects(body, 22, len(body)))

    read(_objects(data, 30, min(unpack("<Q", data, 16)[0], len(data))))
    return out


def encode_picture(p: dict) -> bytes:
    image = base64.b64decode(p["data"])
    texts = b"".join((p.get(k) or "").encode("utf-16-le") + b"\0\0" for k in ("mime_type", "description"))
    return bytes((p.get("picture_type", 3),)) + len(image).to_bytes(4, "little") + texts + image


def parse(data: bytes) -> Parsed:
    if take(data, 0, 16) != HEADER:
        raise ParseError("asf", "no header object")
    size = min(unpack("<Q", data, 16)[0], len(data))
    out = Parsed()
    for kind, body in _objects(data, 30, size):
        _object(out, kind, body)
    if out.sample_rate is None:
        raise ParseError("asf", "no audio stream")
    out.items.sort()
    return out
