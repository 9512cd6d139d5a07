"""Formats of properties only: AAC, AC-3 and MIDI."""

from __future__ import annotations

from tagloom.sources.parsers import id3
from tagloom.sources.parsers.base import Bits, ParseError, Parsed, take, unpack

# Sample rates of AAC by number.
_AAC = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


def aac(data: bytes) -> Parsed:
    at, _ = id3.before_audio(data)
    return _adif(data, at) if data[at : at + 4] == b"ADIF" else _adts(data, at)


def _adif(data: bytes, at: int) -> Parsed:
    bits = Bits(take(data, at + 4, min(200, len(data) - at - 4)))
    if bits.read(1):
        bits.read(72)
    bits.read(2)
    kind, rate = bits.read(1), bits.read(23)
    bits.read(4)
    if not kind:
        bits.read(20)
    bits.read(4 + 2)
    code = bits.read(4)
    front, side, back, lfe, assoc, cc = (bits.read(n) for n in (4, 4, 4, 2, 3, 4))
    for n in (4, 4):
        if bits.read(1):
            bits.read(n)
    if bits.read(1):
        bits.read(3)
    channels = lfe
    for count in (front, side, back):
        for _ in range(count):
            channels += 1 + bits.read(1)
            bits.read(4)
    out = Parsed(bitrate=rate, channels=channels, sample_rate=_AAC[code] if code < len(_AAC) else None)
    out.length_secs = 8 * (len(data) - at) / rate if rate else None
    out.extra["kind"] = "ADIF"
    return out


def _adts(data: bytes, start: int) -> Parsed:
    """Three frames of one kind in a row make the stream; its length is that of the whole at their rate."""
    at = start
    while (at := data.find(b"\xff", at)) >= 0:
        first, frames, size, p = None, 0, 0, at
        while p + 7 <= len(data) and frames < 100:
            word = int.from_bytes(data[p : p + 7], "big")
            key = (word >> 42, word >> 34 & 0xF, word >> 30 & 7)
            n = word >> 13 & 0x1FFF
            if word >> 44 != 0xFFF or word >> 41 & 3 or n < 7 or first not in (None, key):
                break
            first, frames, size, p = key, frames + 1, size + n, p + n
        if frames >= 3:
            rate = _AAC[first[1]] if first[1] < len(_AAC) else 0
            if not rate:
                raise ParseError("aac", "sample rate 0")
            out = Parsed(sample_rate=rate, channels=8 if first[2] == 7 else first[2], bitrate=8 * size * rate // (frames * 1024))
            out.length_secs = frames * 1024 / rate * (len(data) - at) / size
            out.extra["kind"] = "ADTS"
            return out
        at += 1
    raise ParseError("aac", "no frames that follow each other")


# Bitrates of AC-3 in thousands, and channels of its modes, by number.
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_CHANNELS = (2, 1, 2, 3, 3, 4, 4, 5)


def ac3(data: bytes) -> Parsed:
    if take(data, 0, 2) != b"\x0b\x77":
        raise ParseError("ac3", "no sync word")
    bits = Bits(take(data, 0, 16))
    version = data[5] >> 3
    if version > 16:
        raise ParseError("ac3", f"version {version}")
    bits.read(16)
    if version <= 10:
        bits.read(16)
        code, size = bits.read(2), bits.read(6)
        bits.read(5 + 3)
        mode = bits.read(3)
        if code == 3 or size >= 2 * len(AC3_RATES):
            raise ParseError("ac3", "reserved rate")
        if mode & 1 and mode != 1:
            bits.read(2)
        if mode & 4:
            bits.read(2)
        if mode == 2:
            bits.read(2)
        shift = max(version, 8) - 8
        out = Parsed(sample_rate=(48000, 44100, 32000)[code] >> shift, bitrate=AC3_RATES[size >> 1] * 1000 >> shift, channels=AC3_CHANNELS[mode] + bits.read(1))
        out.extra["codec"] = "ac-3"
    else:
        bits.read(2 + 3)
        words = bits.read(11) + 1
        code = bits.read(2)
        if code == 3:
            low = bits.read(2)
            if low == 3:
                raise ParseError("ac3", "reserved rate")
            rate, blocks = (24000, 22050, 16000)[low], 6
        else:
            rate, blocks = (48000, 44100, 32000)[code], (1, 2, 3, 6)[bits.read(2)]
        mode = bits.read(3)
        out = Parsed(sample_rate=rate, bitrate=8 * words * 2 * rate // (blocks * 256), channels=AC3_CHANNELS[mode] + bits.read(1))
        out.extra["codec"] = "ec-3"
    out.length_secs = 8 * len(data) / out.bitrate if out.bitrate else None
    return out


#: Caps on events and bytes of a MIDI track.
EVENTS, TRACK = 1_000_000, 128 << 20


def _number(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = 0
    for i in range(4):
        if at + i >= end:
            break
        value = value << 7 | data[at + i] & 0x7F
        if not data[at + i] & 0x80:
            return value, at + i + 1
    raise ParseError("smf", "number too long")


def midi_track(data: bytes, at: int, end: int) -> tuple[int, list[tuple[int, int]]]:
    """(last tick, tempo changes as (tick, microseconds a beat)) of a track."""
    tick, status, tempos = 0, 0, []
    for _ in range(EVENTS):
        if at >= end:
            break
        step, at = _number(data, at, end)
        tick += step
        lead = take(data, at, 1)[0]
        if lead & 0x80:
            at += 1
        else:
            lead = status
            if not lead:
                raise ParseError("smf", "running status without status")
        if lead == 0xFF:
            kind = take(data, at, 1)[0]
            size, at = _number(data, at + 1, end)
            if kind == 0x51 and size == 3:
                tempos.append((tick, int.from_bytes(take(data, at, 3), "big")))
            at += size
            if kind == 0x2F:
                break
        elif lead in (0xF0, 0xF7):
            size, at = _number(data, at, end)
            at += size
        else:
            status = lead
            at += 1 if lead >> 4 in (0xC, 0xD) else 2
    else:
        raise ParseError("limit", "too many MIDI events")
    return tick, tempos


def smf(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"MThd":
        raise ParseError("smf", "no MThd header")
    size, kind, count, division = unpack(">IHHH", data, 4)
    if kind > 1 or division & 0x8000 or not division:
        raise ParseError("smf", f"format {kind}, division {division}")
    at, tracks = 8 + size, []
    for _ in range(count):
        if at + 8 > len(data):
            break
        n = unpack(">I", data, at + 4)[0]
        if n > TRACK:
            raise ParseError("limit", "track too long")
        if data[at : at + 4] == b"MTrk":
            tracks.append(midi_track(data, at + 8, min(len(data), at + 8 + n)))
        at += 8 + n
    longest = 0.0
    for end, own in tracks:
        tempos = tracks[0][1] if kind == 1 else own
        marks = [(0, 500_000), *sorted((t for t in tempos if t[0] < end), key=lambda t: t[0])]  # of one tick the last one holds
        spans = zip(marks, [*(t for t, _ in marks[1:]), end], strict=True)
        longest = max(longest, sum((stop - tick) * tempo / division / 1e6 for (tick, tempo), stop in spans))
    out = Parsed(length_secs=longest)
    out.extra |= {"format": kind, "tracks": len(tracks)}
    return out
