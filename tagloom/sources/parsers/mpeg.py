"""MPEG audio: frame headers, and the Xing, LAME and VBRI headers in the first frame."""

from __future__ import annotations

import re

from typing import NamedTuple

from tagloom.sources.parsers import ape, id3
from tagloom.sources.parsers.base import ParseError, Parsed

# kbit/s by (is version 1, layer) and index, samples a second by version.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
#: Bytes searched for a frame, syncs tried, frames that follow each other for certainty.
SEARCH, TRIES, SURE = 1 << 20, 1500, 4


class Frame(NamedTuple):
    version: float
    layer: int
    bitrate: int
    sample_rate: int
    channels: int
    size: int
    samples: int
    mode: int


def frame(data: bytes, at: int) -> Frame | None:
    """The frame header at a place, or None."""
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word >> 19 & 3)
    layer, rate, hertz = 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    bitrate, sample_rate = _RATES[version == 1.0, layer][rate] * 1000, _HERTZ[version][hertz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1.0 else 576
    pad, mode = word >> 9 & 1, word >> 6 & 3
    size = (12 * bitrate // sample_rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // sample_rate + pad
    return Frame(version, layer, bitrate, sample_rate, 1 if mode == 3 else 2, max(size, 24), samples, mode)


def _xing(data: bytes, at: int, f: Frame, out: Parsed, whole: int) -> bool:
    side = (17 if f.mode == 3 else 32) if f.version == 1.0 else (9 if f.mode == 3 else 17)
    p = at + 4 + side
    mark = data[p : p + 4]
    if mark not in (b"Xing", b"Info") or len(data) < p + 8:
        return False
    flags, p = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
    frames = size = -1
    if flags & 1:
        frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
    if flags & 2:
        size, p = int.from_bytes(data[p : p + 4], "big"), p + 4
    p += 100 if flags & 4 else 0
    scale = int.from_bytes(data[p : p + 4], "big") if flags & 8 else -1
    p += 4 if flags & 8 else 0
    lame = data[p : p + 36]
    out.extra["bitrate_mode"] = "VBR" if mark == b"Xing" else "CBR"
    skipped = 0
    if lame[:4] in (b"LAME", b"Lavf", b"Lavc", b"GOGO"):
        out.extra["encoder"] = lame[:9].rstrip(b"\0").decode("latin-1")
        if len(lame) >= 24 and lame[:4] == b"LAME":
            skipped = int.from_bytes(lame[21:24], "big")
            skipped = (skipped >> 12) + (skipped & 0xFFF)
            out.extra["vbr_method"] = lame[9] & 15
        if len(lame) >= 28 and lame[:4] == b"LAME" and (settings := _settings(lame, scale)):
            out.extra["encoder_settings"] = settings
    if frames > 0:
        samples = max(0, frames * f.samples - skipped)
        out.length_secs = samples / f.sample_rate
        size = size if size > 0 else whole
        if out.length_secs:
            out.bitrate = int(size * 8 / out.length_secs)
    return True


# Numbers under which presets are stored, for versions 3.93 to 3.97.
_PRESETS = {1001: "standard", 1002: "extreme", 1004: "fast standard", 1005: "fast extreme", 1006: "medium", 1007: "fast medium"}
# Fixed values: (quality, noise quality, method, lowpass, hearing threshold) that presets of 3.90 to 3.92 leave.
_OLD_PRESETS = {(1, 2, 4, 19500, 3): "--preset r3mix", (2, 2, 3, 19000, 4): "--alt-preset standard", (2, 2, 3, 19500, 2): "--alt-preset extreme"}
# Fixed values: (quality, bitrate, lowpass) of version 3.99 on that stand for another quality.
_QUALITIES = {(5, 32, 0): 7, (5, 8, 0): 8, (6, 8, 0): 9}


def _settings(lame: bytes, scale: int) -> str:
    """The encoder's options that its tag speaks for; empty if they can't be told. scale is the quality that the header gives, -1 if none."""
    number = re.match(rb"LAME(\d+)\.(\d+)", lame)
    if not number:
        return ""
    version, method = (int(number[1]), int(number[2])), lame[9] & 15
    quality, noise = ((100 - scale) // 10, (100 - scale) % 10) if 0 <= scale <= 100 else (-1, -1)
    lowpass, flags, threshold, rate = lame[10] * 100, lame[19] >> 4, lame[19] & 15, lame[20]
    preset = int.from_bytes(lame[26:28], "big") & 0x7FF
    early, middle = (3, 90) <= version <= (3, 92), (3, 93) <= version <= (3, 97)
    if method == 2:
        if early and flags:
            name = "--alt-preset"
        else:
            name = "--preset" if preset else "--abr"
        return f"--preset {preset}" if preset and name == "--preset" else f"{name} {rate}{'+' if rate == 255 else ''}"
    if method == 1:
        named = {0: f"-b {rate}" if rate < 255 else "-b 255+", 1003: "--preset insane"}
        return named.get(preset, f"-b {preset}")
    if early and (known := _OLD_PRESETS.get((quality, noise, method, lowpass, threshold))):
        return known
    if middle and preset in _PRESETS:
        return f"--preset {_PRESETS[preset]}"
    slow, fast = ("", " --vbr-new") if early or middle else (" --vbr-old", "")
    if version < (3, 90):
        return ""
    if method == 3:
        return f"-V {quality}{slow}"
    if method in (4, 5):
        return f"-V {_QUALITIES.get((quality, rate, lowpass), quality) if version >= (3, 99) else quality}{fast}"
    return f"-V {quality}" if middle and method >= 8 and quality >= 0 else ""


def _vbri(data: bytes, at: int, f: Frame, out: Parsed) -> bool:
    head = data[at + 36 : at + 62]
    if head[:4] != b"VBRI" or len(head) < 18:
        return False
    size, frames = int.from_bytes(head[10:14], "big"), int.from_bytes(head[14:18], "big")
    out.extra["bitrate_mode"] = "VBR"
    out.length_secs = frames * f.samples / f.sample_rate
    if out.length_secs:
        out.bitrate = int(size * 8 / out.length_secs)
    return True


def parse(data: bytes) -> Parsed:
    start, out = id3.before_audio(data)
    if not out.items and not out.extra:
        out = id3.decode_v1(data)
    if not out.items:
        out.items = ape.tag(data).items
    best, tries, at = None, 0, start
    while tries < TRIES and at < min(len(data), start + SEARCH):
        at = data.find(b"\xff", at, start + SEARCH)
        if at < 0:
            break
        first = frame(data, at)
        if first:
            tries += 1
            places, p = [at], at + first.size
            while len(places) < SURE and (f := frame(data, p)) and (f.layer, f.version, f.sample_rate) == (first.layer, first.version, first.sample_rate):
                places.append(p)
                p += f.size
            if best is None or len(places) > best[1]:
                best = (at, len(places), first)
            if len(places) >= SURE or p >= len(data) and len(places) >= 2:
                break
        at += 1
    if best is None or best[1] < 2 and best[0] + best[2].size < len(data):
        raise ParseError("mp3", "no frames that follow each other")
    at, sure, f = best
    out.sample_rate, out.channels, out.bitrate = f.sample_rate, f.channels, f.bitrate
    out.extra |= {"version": f.version, "layer": f.layer, "sketchy": sure < SURE, "mode": f.mode}
    whole = len(data) - at - (128 if data[-128:-125] == b"TAG" else 0)
    if not (f.layer == 3 and (_xing(data, at, f, out, whole) or _vbri(data, at, f, out))):
        out.extra["bitrate_mode"] = "unknown"
        out.length_secs = 8 * whole / f.bitrate
    elif out.length_secs is None:
        out.length_secs = 8 * whole / f.bitrate
    out.items = [*out.items, *_gains(out)]
    return out


def _gains(out: Parsed) -> list[tuple[str, list[str]]]:
    """ReplayGain items of RVA2 frames, where the tag has none of its own."""
    have = {k.upper() for k, _ in out.items}
    rows = [(f"TXXX:REPLAYGAIN_{r['desc'].upper()}_{kind}", text) for r in out.extra.get("rva2", []) if r["desc"].lower() in ("track", "album") for kind, text in (("GAIN", f"{r['gain']:+.2f} dB"), ("PEAK", f"{r['peak']:.6f}"))]
    return [(k, [v]) for k, v in rows if k not in have]
