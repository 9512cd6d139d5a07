"""Vorbis comments and FLAC pictures: decoding and encoding."""

from __future__ import annotations

import base64
import struct

from tagloom.sources.parsers.base import LIMITS, MAX_ITEMS, ParseError, Parsed, take, unpack


def valid_key(key: str) -> bool:
    return bool(key) and all(" " <= c <= "}" and c != "=" for c in key)


def _string(raw: bytes, errors: str) -> str:
    try:
        return raw.decode("utf-8", "replace" if errors == "replace" else "ignore" if errors == "ignore" else "strict")
    except UnicodeDecodeError as e:
        raise ParseError("vorbis", f"text: {e}") from e


def decode(data: bytes, out: Parsed | None = None, errors: str = "replace") -> tuple[Parsed, int]:
    """Items by lower-case key, sorted, and the bytes read.

    errors is what becomes of text that isn't UTF-8, of bad keys and of comments without '=': with replace they get U+FFFD,
    '?' for bad characters, and the keys unknown0, unknown1 and so on; with ignore they go; with strict they are an error.
    """
    if errors not in ("strict", "replace", "ignore"):
        raise ValueError(f"errors={errors!r}")
    out = out or Parsed()
    size = unpack("<I", data)[0]
    if size > 1_000_000:
        raise ParseError("limit", "vendor string too long")
    out.extra["vendor"] = _string(take(data, 4, size), errors)
    at = 4 + size
    count = unpack("<I", data, at)[0]
    if count > MAX_ITEMS:
        raise ParseError("limit", f"{count} comments")
    at += 4
    found: dict[str, list[str]] = {}
    total = unknown = 0
    for _ in range(count):
        size = unpack("<I", data, at)[0]
        total += size
        if total > LIMITS.tag:
            raise ParseError("limit", "comments too long")
        text = _string(take(data, at + 4, size), errors)
        at += 4 + size
        key, eq, value = text.partition("=")
        if not eq and errors == "replace":
            key, value, unknown = f"unknown{unknown}", text, unknown + 1
        if (not eq or not valid_key(key)) and errors == "strict":
            raise ParseError("vorbis", f"comment {text[:80]!r}")
        if eq and not valid_key(key) and key and errors == "replace":
            key = "".join(c if " " <= c <= "}" else "?" for c in key)
        if valid_key(key) and (eq or errors == "replace"):
            found.setdefault(key.lower(), []).append(value)
    for raw in found.get("metadata_block_picture", []):
        try:
            out.extra.setdefault("pictures", []).append(picture(base64.b64decode(raw, validate=False)))
        except (ValueError, struct.error):
            continue
    out.items = sorted(found.items())
    return out, at


def encode(items: list[tuple[str, list[str]]], vendor: str = "tagloom") -> bytes:
    lines = [f"{k}={v}".encode() for k, values in items if valid_key(k) for v in values]
    name = vendor.encode()
    return struct.pack("<I", len(name)) + name + struct.pack("<I", len(lines)) + b"".join(struct.pack("<I", len(x)) + x for x in lines)


def picture(data: bytes) -> dict:
    kind, size = unpack(">II", data)
    mime = take(data, 8, size).decode("latin-1")
    at = 8 + size
    size = unpack(">I", data, at)[0]
    desc = take(data, at + 4, size).decode("utf-8", "replace")
    at += 4 + size
    width, height, depth, colors, size = unpack(">IIIII", data, at)
    if size > LIMITS.image:
        raise ParseError("limit", f"image of {size} bytes")
    return {"mime_type": mime, "picture_type": kind, "description": desc, "width": width, "height": height, "depth": depth, "colors": colors, "data": base64.b64encode(take(data, at + 20, size)).decode()}


def encode_picture(p: dict) -> bytes:
    mime, desc, image = p["mime_type"].encode("latin-1"), p.get("description", "").encode(), base64.b64decode(p["data"])
    return struct.pack(">II", p.get("picture_type", 3), len(mime)) + mime + struct.pack(">I", len(desc)) + desc + struct.pack(">IIIII", *(p.get(k, 0) for k in ("width", "height", "depth", "colors")), len(image)) + image
