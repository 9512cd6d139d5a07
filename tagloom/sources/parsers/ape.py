"""APEv2 tags, and the formats that carry them: Monkey's Audio, WavPack, Musepack, TAK, TrueAudio and OptimFROG."""

from __future__ import annotations

import base64
import struct

from tagloom.sources.parsers import id3
from tagloom.sources.parsers.base import LIMITS, MAX_ITEMS, Bits, ParseError, Parsed, take, unpack


def valid_key(key: str) -> bool:
    return 2 <= len(key) <= 255 and all(" " <= c <= "~" for c in key) and key.upper() not in ("OGGS", "TAG", "ID3", "MP+")


def locate(data: bytes) -> tuple[int, int, int] | None:
    """(start of the items, their end, count) of a tag at the end, before ID3v1, before Lyrics3, or at the start."""
    ends = [len(data)]
    if data[-128:-125] == b"TAG":
        ends.append(len(data) - 128)
        if data[-137:-128] == b"LYRICS200" and data[-143:-137].isdigit():
            ends.append(len(data) - 143 - int(data[-143:-137]))
    for end in ends:
        foot = data[end - 32 : end] if end >= 32 else b""
        if foot[:8] == b"APETAGEX":
            version, size, count, flags = struct.unpack("<IIII", foot[8:24])
            if not flags & 1 << 29 and 32 <= size <= end:
                return end - size, end - 32, count
    if data[:8] == b"APETAGEX":
        version, size, count, _ = struct.unpack("<IIII", take(data, 8, 16))
        return 32, min(len(data), size), count
    return None


def tag(data: bytes) -> Parsed:
    """Text items, sorted by key, the last of a key; binary and external ones are in extra. Nothing if there is no tag."""
    out, place = Parsed(), locate(data)
    if place is None:
        return out
    at, end, count = place
    if end - at > LIMITS.tag:
        raise ParseError("limit", "tag too large")
    if count > MAX_ITEMS:
        raise ParseError("limit", f"{count} items")
    found: dict[str, tuple[str, list[str]]] = {}
    for _ in range(count):
        if at + 8 >= end:
            break
        size, flags = struct.unpack("<II", take(data, at, 8))
        stop = data.find(b"\0", at + 8, end)
        if stop < 0 or stop + 1 + size > end:
            break
        key, value = data[at + 8 : stop].decode("latin-1"), data[stop + 1 : stop + 1 + size]
        at = stop + 1 + size
        kind = flags >> 1 & 3
        if kind == 0:
            found[key.lower()] = (key, value.decode("utf-8", "replace").split("\0"))
        elif kind == 1:
            name, _, image = value.partition(b"\0")
            out.extra.setdefault("binary", []).append({"key": key, "name": name.decode("utf-8", "replace"), "data": base64.b64encode(image).decode()})
            if key.lower().startswith("cover art"):
                out.extra.setdefault("pictures", []).append({"mime_type": "", "picture_type": picture_type(key), "description": name.decode("utf-8", "replace"), "data": base64.b64encode(image).decode()})
        elif kind == 2:
            out.extra.setdefault("external", []).append({"key": key, "value": value.decode("utf-8", "replace")})
    out.items = sorted(found.values())
    return out


def picture_type(key: str) -> int:
    """The type that a picture's key names: front, back, and else other."""
    return {"(front)": 3, "(back)": 4}.get(key.lower().rpartition(" ")[2], 0)


def picture_items(pictures: list[dict]) -> list[bytes]:
    """Binary items of pictures: one for the front, one for the back, one for others."""
    out: dict[str, bytes] = {}
    for p in pictures:
        key = "Cover Art " + {3: "(Front)", 4: "(Back)"}.get(p.get("picture_type", 3), "(Other)")
        value = (p.get("description") or "cover").encode() + b"\0" + base64.b64decode(p["data"])
        out[key] = struct.pack("<II", len(value), 2) + key.encode() + b"\0" + value
    return list(out.values())


def kept(data: bytes) -> list[bytes]:
    """The binary and external items of the tag, as they are: those that aren't text."""
    place, out = locate(data), []
    if place is None:
        return out
    at, end, count = place
    for _ in range(min(count, MAX_ITEMS)):
        if at + 8 >= end:
            break
        size, flags = struct.unpack("<II", take(data, at, 8))
        stop = data.find(b"\0", at + 8, end)
        if stop < 0 or stop + 1 + size > end:
            break
        if flags >> 1 & 3:
            out.append(data[at : stop + 1 + size])
        at = stop + 1 + size
    return out


def encode(items: list[tuple[str, list[str]]], others: list[bytes] | None = None) -> bytes:
    """A tag with header and footer of text items and of others as kept() gives them; by size, as short ones are to come first."""
    new = {k.lower() for k, _ in items}
    parts = [x for x in others or [] if x[8 : x.index(b"\0", 8)].decode("latin-1").lower() not in new]
    for key, values in items:
        if not valid_key(key):
            raise ParseError("apev2", f"key {key!r}")
        text = "\0".join(values).encode()
        parts.append(struct.pack("<II", len(text), 0) + key.encode("latin-1") + b"\0" + text)
    body = b"".join(sorted(parts, key=lambda p: (len(p), p)))
    frame = lambda flag: b"APETAGEX" + struct.pack("<IIII", 2000, len(body) + 32, len(parts), flag) + bytes(8)
    return frame(1 << 31 | 1 << 29) + body + frame(1 << 31)


def without(data: bytes) -> bytes:
    """The file without the tag at its end and its header."""
    place = locate(data)
    if place is None or place[1] + 32 > len(data):
        return data
    start, end, _ = place
    if data[max(0, start - 32) : max(0, start - 24)] == b"APETAGEX":
        start -= 32
    return data[:start] + data[end + 32 :]


def _tagged(out: Parsed, data: bytes) -> Parsed:
    found = tag(data)
    if not found.items and not found.extra:
        found = id3.both(data)
    out.items, out.extra = found.items, out.extra | found.extra
    return out


def monkeys_audio(data: bytes) -> Parsed:
    at, _ = id3.before_audio(data)
    if take(data, at, 4) != b"MAC ":
        raise ParseError("ape", "no MAC header")
    version = unpack("<H", data, at + 4)[0]
    out = Parsed()
    if version >= 3980:
        base = at + unpack("<I", data, at + 8)[0]
        blocks, final, frames, out.bits_per_sample, out.channels, out.sample_rate = unpack("<IIIHHI", data, base + 4)
    else:
        level, _, out.channels, out.sample_rate, _, _, frames, final = unpack("<HHHIIIII", data, at + 6)
        blocks = 73728 * 4 if version >= 3950 else 73728 if version >= 3900 or version >= 3800 and level == 4000 else 9216
        bits = unpack("<H", data, at + 74)[0] if take(data, at + 48, 4) == b"WAVE" else 16
        out.bits_per_sample = bits
    if out.sample_rate and frames:
        out.length_secs = ((frames - 1) * blocks + final) / out.sample_rate
    out.extra["version"] = version / 1000
    return _tagged(out, data)


_WV_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)


def wavpack(data: bytes) -> Parsed:
    mark, size, version, _, _, total, index, samples, flags = unpack("<4sIHBBIIII", data)
    if mark != b"wvpk":
        raise ParseError("wavpack", "no wvpk header")
    code = flags >> 23 & 15
    out = Parsed(channels=1 if flags & 4 else 2, bits_per_sample=((flags & 3) + 1) * 8, sample_rate=_WV_RATES[code] if code < 15 else 0)
    if total == 0xFFFFFFFF or total == -1:
        total, at = 0, 0
        while at + 32 <= len(data) and data[at : at + 4] == b"wvpk":
            size, first, count = unpack("<I", data, at + 4)[0], *unpack("<II", data, at + 16)
            total = max(total, first + count)
            at += 8 + size
    if flags >> 31:
        out.sample_rate, out.bits_per_sample = (out.sample_rate or 0) * 4, 1
        total *= 4
    if out.sample_rate:
        out.length_secs = total / out.sample_rate
    out.extra["version"] = version
    return _tagged(out, data)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for i in range(9):
        b = take(data, at + i, 1)[0]
        value = value << 7 | b & 0x7F
        if not b & 0x80:
            return value, at + i + 1
    raise ParseError("musepack", "number too long")


def musepack(data: bytes) -> Parsed:
    at, _ = id3.before_audio(data)
    rates, out = (44100, 48000, 37800, 32000), Parsed()
    mark = take(data, at, 4)
    if mark == b"MPCK":
        p, seen, samples, skip = at + 4, set(), 0, 0
        while seen != {b"SH", b"RG"}:
            key = take(data, p, 2)
            size, body = _varint(data, p + 2)
            if key in (b"AP", b"SE") or size < 3:
                break
            if key == b"SH":
                samples, q = _varint(data, body + 5)
                skip, q = _varint(data, q)
                head = take(data, q, 2)
                out.sample_rate, out.channels = rates[head[0] >> 5 & 3], (head[1] >> 4) + 1
                seen.add(key)
            elif key == b"RG":
                _, title, peak, album, album_peak = unpack(">BhHhH", data, body)
                for name, g, k in (("title", title, peak), ("album", album, album_peak)):
                    if g:
                        out.extra[f"{name}_gain"] = 64.82 - g / 256
                    if k:
                        out.extra[f"{name}_peak"] = 10 ** (k / (256 * 20)) / 65535
                seen.add(key)
            p += size
        if seen != {b"SH", b"RG"}:
            raise ParseError("musepack", "SH or RG packet missing")
        out.extra["version"] = 8
        samples -= skip
    elif mark[:3] == b"MP+":
        head = take(data, at, 32)
        version = head[3] & 15
        if version < 7:
            raise ParseError("musepack", f"stream version {version}")
        frames, flags = unpack("<II", data, at + 4)
        out.sample_rate, out.channels = rates[flags >> 16 & 3], 2
        title_peak, title, album_peak, album = struct.unpack("<HhHh", head[12:20])
        out.extra |= {"version": version, "title_gain": title / 100, "title_peak": title_peak / 32768, "album_gain": album / 100, "album_peak": album_peak / 32768}
        samples = frames * 1152 - 576
    elif len(data) - at >= 32:
        word, second = unpack("<II", data, at)
        version = word >> 11 & 0x3FF
        if version not in (4, 5, 6):
            raise ParseError("musepack", "no header")
        frames = second if version >= 5 else second & 0xFFFF
        out.bitrate, out.sample_rate, out.channels = (word >> 23) * 1000, 44100, 2
        out.extra["version"] = version
        samples = (frames - (1 if version < 6 else 0)) * 1152 - 576
    else:
        raise ParseError("musepack", "no header")
    out.length_secs = max(0, samples) / out.sample_rate
    if not out.bitrate and out.length_secs:
        out.bitrate = round((len(data) - at) * 8 / out.length_secs)
    return _tagged(out, data)


def tak(data: bytes) -> Parsed:
    at, _ = id3.before_audio(data)
    if take(data, at, 4) != b"tBaK":
        raise ParseError("tak", "no tBaK marker")
    out, p = Parsed(), at + 4
    while True:
        kind = take(data, p, 4)
        size = int.from_bytes(kind[1:], "little")
        kind = kind[0] & 0x7F
        if kind == 0:
            break
        if kind == 1:
            bits = Bits(take(data, p + 4, size), low=True)
            bits.read(6)
            bits.read(4)
            bits.read(4)
            samples = bits.read(35)
            bits.read(3)
            out.sample_rate = bits.read(18) + 6000
            out.bits_per_sample = bits.read(5) + 8
            out.channels = bits.read(4) + 1
            out.length_secs = samples / out.sample_rate
        elif kind == 4 and size >= 4:
            version = take(data, p + 4, 4)
            out.extra["encoder"] = f"TAK {version[2]}.{version[1]}.{version[0]}"
        p += 4 + size
    if out.sample_rate is None:
        raise ParseError("tak", "no stream info")
    return _tagged(out, data)


def true_audio(data: bytes) -> Parsed:
    at, found = id3.before_audio(data)
    if take(data, at, 4) != b"TTA1":
        raise ParseError("tta", "no TTA1 header")
    _, channels, bits, rate, samples = unpack("<HHHII", data, at + 4)
    out = Parsed(samples / rate if rate else None, None, rate, channels, bits)
    if found.items:
        out.items, out.extra = found.items, found.extra
        return out
    return _tagged(out, data)


def optimfrog(data: bytes) -> Parsed:
    if take(data, 0, 4) != b"OFR ":
        raise ParseError("optimfrog", "no OFR header")
    size = unpack("<I", data, 4)[0]
    if size not in (12, 15) and size < 15:
        raise ParseError("optimfrog", f"header of {size} bytes")
    low, high, kind, channels, rate = unpack("<IHBBI", data, 8)
    out = Parsed(channels=channels + 1, sample_rate=rate, bits_per_sample={0: 8, 1: 8, 2: 16, 3: 16, 4: 24, 5: 24, 6: 32, 7: 32}.get(kind))
    if rate and channels + 1:
        out.length_secs = (low | high << 32) / (channels + 1) / rate
    if size >= 15:
        encoder = str((unpack("<H", data, 20)[0] >> 4) + 4500)
        out.extra["encoder"] = f"{encoder[0]}.{encoder[1:]}"
    return _tagged(out, data)


def bare(data: bytes) -> Parsed:
    """A file that is an APEv2 tag only."""
    if locate(data) is None:
        raise ParseError("apev2", "no tag")
    return tag(data)
