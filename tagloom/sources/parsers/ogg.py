"""Ogg streams: pages and packets, and the codecs in them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from tagloom.sources.parsers import flac, vorbis
from tagloom.sources.parsers.base import Bits, ParseError, Parsed, take, unpack


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    lacing: bytes
    body: bytes
    end: int


def page(data: bytes, at: int) -> Page:
    mark, version, flags, granule, serial, _, _, count = unpack("<4sBBqIIIB", data, at)
    if mark != b"OggS" or version:
        raise ParseError("ogg", f"no page at {at}")
    lacing = take(data, at + 27, count)
    size = sum(lacing)
    return Page(flags, granule, serial, lacing, take(data, at + 27 + count, size), at + 27 + count + size)


def packets(data: bytes, most: int = 3) -> tuple[int, list[bytes]]:
    """The first stream's serial number and its first packets."""
    at, serial, out, part = 0, None, [], b""
    while at < len(data) and len(out) < most:
        p = page(data, at)
        at = p.end
        serial = p.serial if serial is None else serial
        if p.serial != serial:
            continue
        i = 0
        for size in p.lacing:
            part += p.body[i : i + size]
            i += size
            if size < 255:
                out.append(part)
                part = b""
    if serial is None:
        raise ParseError("ogg", "no pages")
    return serial, out[:most]


def last_granule(data: bytes, serial: int) -> int | None:
    """The granule position of the stream's last page that ends a packet: searched from the end, then page by page."""
    at = data.rfind(b"OggS", max(0, len(data) - 65536))
    while at >= 0:
        try:
            p = page(data, at)
            if p.serial == serial and p.granule >= 0:
                return p.granule
        except ParseError:
            pass
        at = data.rfind(b"OggS", max(0, len(data) - 65536), at)
    at, found = 0, None
    for _ in range(50_000):
        try:
            p = page(data, at)
        except ParseError:
            break
        at = p.end
        if p.serial == serial and p.granule >= 0:
            found = p.granule
    return found


def _streams(data: bytes, mark: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    serial, found = packets(data)
    if not found or found[0][at : at + len(mark)] != mark:
        raise ParseError("ogg", f"no {mark!r} packet")
    yield serial, found


def vorbis_stream(data: bytes) -> Parsed:
    for serial, found in _streams(data, b"\x01vorbis"):
        version, channels, rate, high, nominal, low = unpack("<IBIiii", found[0], 7)
        if not rate:
            raise ParseError("ogg", "sample rate 0")
        out = Parsed(sample_rate=rate, channels=channels)
        high, nominal, low = (max(0, x) for x in (high, nominal, low))
        out.bitrate = (high + low) // 2 if not nominal else high if high and high < nominal else low if low > nominal else nominal
        if len(found) > 1 and found[1][:7] == b"\x03vorbis":
            vorbis.decode(found[1][7:], out)
        end = last_granule(data, serial)
        if end is None:
            raise ParseError("ogg", "no last page")
        out.length_secs = end / rate
        out.extra["codec_version"] = version
        return out


def opus(data: bytes) -> Parsed:
    for serial, found in _streams(data, b"OpusHead"):
        version, channels, skip, rate, gain, _ = unpack("<BBHIhB", found[0], 8)
        if version >> 4:
            raise ParseError("ogg", f"Opus version {version}")
        out = Parsed(sample_rate=48000, channels=channels)
        if len(found) > 1 and found[1][:8] == b"OpusTags":
            vorbis.decode(found[1][8:], out)
        end = last_granule(data, serial)
        out.length_secs = max(0, end - skip) / 48000 if end is not None else None
        out.extra |= {"pre_skip": skip, "input_rate": rate, "output_gain": gain}
        return out


def speex(data: bytes) -> Parsed:
    for serial, found in _streams(data, b"Speex   "):
        rate, _, _, channels, bitrate = unpack("<IIIIi", found[0], 36)
        if not rate:
            raise ParseError("ogg", "sample rate 0")
        out = Parsed(sample_rate=rate, channels=channels, bitrate=max(0, bitrate))
        if len(found) > 1:
            vorbis.decode(found[1], out)
        end = last_granule(data, serial)
        out.length_secs = end / rate if end is not None else None
        return out


def ogg_flac(data: bytes) -> Parsed:
    for serial, found in _streams(data, b"\x7fFLAC"):
        out = flac.stream_info(found[0][17:], Parsed())
        if len(found) > 1 and found[1] and found[1][0] & 0x7F == 4:
            vorbis.decode(found[1][4:], out)
        end = last_granule(data, serial)
        if not out.extra["total_samples"] and end is not None:
            out.length_secs = end / out.sample_rate
        return out


def theora(data: bytes) -> Parsed:
    for serial, found in _streams(data, b"\x80theora"):
        bits = Bits(take(found[0], 7, 35))
        version = [bits.read(8) for _ in range(3)]
        bits.read(16 + 16 + 24 + 24 + 8 + 8)
        top, bottom = bits.read(32), bits.read(32)
        bits.read(24 + 24 + 8)
        rate = bits.read(24)
        bits.read(6)
        shift = bits.read(5)
        if not bottom or not top:
            raise ParseError("ogg", "frame rate 0")
        out = Parsed(bitrate=rate)
        if len(found) > 1 and found[1][:7] == b"\x81theora":
            vorbis.decode(found[1][7:], out)
        end = last_granule(data, serial)
        if end is not None:
            out.length_secs = ((end >> shift) + (end & (1 << shift) - 1)) * bottom / top
        out.extra |= {"fps": top / bottom, "codec_version": ".".join(map(str, version))}
        return out


def crc(data: bytes) -> int:
    """The checksum of Ogg pages: polynomial 04C11DB7, not reflected, from 0."""
    value = 0
    for b in data:
        value = (value << 8) & 0xFFFFFFFF ^ _TABLE[value >> 24 ^ b]
    return value


def _table() -> list[int]:
    out = []
    for i in range(256):
        v = i << 24
        for _ in range(8):
            v = (v << 1 ^ 0x04C11DB7 if v & 0x80000000 else v << 1) & 0xFFFFFFFF
        out.append(v)
    return out


_TABLE = _table()
