"""Files of chunks: WAVE, AIFF, DSDIFF and DSF."""

from __future__ import annotations

from collections.abc import Iterator

from tagloom.sources.parsers import id3
from tagloom.sources.parsers.base import ParseError, Parsed, take, unpack


def walk(data: bytes, at: int, end: int, order: str, wide: bool = False) -> Iterator[tuple[str, int, int]]:
    """(id, start of the body, size) of each chunk; bodies are padded to even sizes."""
    end, head, zeros = min(end, len(data)), 12 if wide else 8, 0
    while at + head <= end:
        name = data[at : at + 4]
        size = int.from_bytes(data[at + 4 : at + head], order)
        yield name.decode("latin-1"), at + head, size
        zeros = zeros + 1 if size == 0 else 0
        if zeros > 64:
            return
        at += head + size + (size & 1)


def _tagged(out: Parsed, data: bytes, chunks: list[tuple[str, int, int]]) -> Parsed:
    for name, at, size in chunks:
        if name.strip().lower() == "id3":
            tag = id3.chunk_tag(data, at, size)
            out.items, out.extra = tag.items, out.extra | tag.extra
            break
    out.extra["chunks"] = [{"id": n, "offset": a, "size": s} for n, a, s in chunks]
    return out


def wave(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"RIFF" or take(data, 8, 4) != b"WAVE":
        raise ParseError("wave", "no RIFF/WAVE header")
    chunks = list(walk(data, 12, len(data), "little"))
    fmt = next(((a, s) for n, a, s in chunks if n == "fmt "), None)
    if fmt is None or fmt[1] < 16:
        raise ParseError("wave", "no usable fmt chunk")
    kind, channels, rate, _, align, bits = unpack("<HHIIHH", data, fmt[0])
    if not align:
        raise ParseError("wave", "block size 0")
    body = next((s for n, _, s in chunks if n == "data"), None)
    samples = body // align if body is not None and rate else 0
    out = Parsed(samples / rate if body is not None and rate else None, channels * bits * rate or None, rate, channels, bits)
    out.extra |= {"audio_format": kind, "samples": samples}
    return _tagged(out, data, chunks)


def _float80(raw: bytes) -> float:
    sign, exponent, mantissa = raw[0] >> 7, (raw[0] & 0x7F) << 8 | raw[1], int.from_bytes(raw[2:], "big")
    if exponent == 0x7FFF or not mantissa and exponent:
        raise ParseError("aiff", "sample rate isn't a number")
    return (-1.0 if sign else 1.0) * mantissa * 2.0 ** (exponent - 16383 - 63) if mantissa else 0.0


def aiff(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"FORM" or take(data, 8, 4) not in (b"AIFF", b"AIFC"):
        raise ParseError("aiff", "no FORM/AIFF header")
    chunks = list(walk(data, 12, len(data), "big"))
    comm = next(((a, s) for n, a, s in chunks if n == "COMM"), None)
    if comm is None or comm[1] < 18:
        raise ParseError("aiff", "no usable COMM chunk")
    channels, frames, bits = unpack(">HIH", data, comm[0])
    rate = int(_float80(take(data, comm[0] + 8, 10)))
    if rate <= 0:
        raise ParseError("aiff", "sample rate 0")
    out = Parsed(frames / rate, channels * bits * rate, rate, channels, bits)
    return _tagged(out, data, chunks)


def dsdiff(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"FRM8" or take(data, 12, 4) != b"DSD ":
        raise ParseError("dsdiff", "no FRM8 header")
    chunks = list(walk(data, 16, len(data), "big", wide=True))
    out, kind = Parsed(bits_per_sample=1), "DSD "
    for name, at, size in chunks:
        if name == "PROP" and take(data, at, 4) == b"SND ":
            for sub, a, _ in walk(data, at + 4, at + size, "big", wide=True):
                if sub == "FS  ":
                    out.sample_rate = unpack(">I", data, a)[0]
                elif sub == "CHNL":
                    out.channels = unpack(">H", data, a)[0]
                elif sub == "CMPR":
                    kind = take(data, a, 4).decode("latin-1")
    rate, channels = out.sample_rate or 0, out.channels or 0
    for name, at, size in chunks:
        if name == "DSD " and rate and channels:
            out.length_secs, out.bitrate = size * 8 / channels / rate, channels * rate
        elif name == "DST ":
            frte = next((a for n, a, _ in walk(data, at, at + size, "big", wide=True) if n == "FRTE"), None)
            if frte is not None:
                frames, per = unpack(">IH", data, frte)
                if frames and per:
                    out.length_secs = frames / per
                    out.bitrate = int(size / frames * 8 * per)
    out.extra["compression"] = kind.strip()
    return _tagged(out, data, chunks)


def dsf(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"DSD " or take(data, 28, 4) != b"fmt ":
        raise ParseError("dsf", "no DSD header")
    tag = unpack("<Q", data, 20)[0]
    channels, rate, bits, samples = unpack("<IIIQ", data, 52)
    out = Parsed(samples / rate if rate else None, rate * bits * channels, rate, channels, bits)
    if tag:
        found = id3.decode(data, tag)
        out.items, out.extra = found.items, found.extra
    return out
