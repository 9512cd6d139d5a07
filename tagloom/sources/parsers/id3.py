"""ID3v1 and ID3v2.2 to 2.4 tags: decoding to items, and encoding of items and of the frames that are none."""

from __future__ import annotations

import base64
import re
import zlib

from tagloom.plans.dims import GENRES
from tagloom.sources.parsers import frames
from tagloom.sources.parsers.base import LIMITS, Padding, ParseError, Parsed, padding, take
from tagloom.sources.parsers.frames import split as _split
from tagloom.sources.parsers.frames import text as _text

# Three-letter frame ids of version 2.2 and what they became.
UPGRADE = {
    "BUF": "RBUF", "CNT": "PCNT", "COM": "COMM", "CRA": "AENC", "ETC": "ETCO", "EQU": "EQUA", "GEO": "GEOB", "IPL": "IPLS", "LNK": "LINK", "MCI": "MCDI", "MLL": "MLLT", "PIC": "APIC", "POP": "POPM",
    "REV": "RVRB", "RVA": "RVAD", "SLT": "SYLT", "STC": "SYTC", "TAL": "TALB", "TBP": "TBPM", "TCM": "TCOM", "TCO": "TCON", "TCP": "TCMP", "TCR": "TCOP", "TDA": "TDAT", "TDY": "TDLY", "TEN": "TENC",
    "TFT": "TFLT", "TIM": "TIME", "TKE": "TKEY", "TLA": "TLAN", "TLE": "TLEN", "TMT": "TMED", "TOA": "TOPE", "TOF": "TOFN", "TOL": "TOLY", "TOR": "TORY", "TOT": "TOAL", "TP1": "TPE1", "TP2": "TPE2",
    "TP3": "TPE3", "TP4": "TPE4", "TPA": "TPOS", "TPB": "TPUB", "TRC": "TSRC", "TRD": "TRDA", "TRK": "TRCK", "TS2": "TSO2", "TSA": "TSOA", "TSC": "TSOC", "TSI": "TSIZ", "TSP": "TSOP", "TSS": "TSSE",
    "TST": "TSOT", "TT1": "TIT1", "TT2": "TIT2", "TT3": "TIT3", "TXT": "TEXT", "TXX": "TXXX", "TYE": "TYER", "UFI": "UFID", "ULT": "USLT", "WAF": "WOAF", "WAR": "WOAR", "WAS": "WOAS", "WCM": "WCOM",
    "WCP": "WCOP", "WPB": "WPUB", "WXX": "WXXX",
}


def synchsafe(data: bytes) -> int:
    out = 0
    for b in data:
        out = out << 7 | b & 0x7F
    return out


def tag_size(data: bytes, at: int = 0) -> int:
    """Bytes of the ID3v2 tag that starts at a place, 0 if none does."""
    head = data[at : at + 10]
    if len(head) < 10 or head[:3] != b"ID3" or max(head[6:10]) > 127 or head[3] == 255:
        return 0
    return 10 + synchsafe(head[6:10]) + (10 if head[5] & 0x10 else 0)


def _values(codec: int, data: bytes) -> list[str]:
    out = []
    while data:
        head, data = _split(codec, data)
        out.append(_text(codec, head))
    while out and not out[-1]:
        out.pop()
    return out


def _frame(out: Parsed, frame: str, data: bytes, major: int = 4) -> None:
    """Adds a frame's item under its hash key."""
    if not data:
        return
    codec = data[0]
    if frame == "TXXX" or frame == "WXXX":
        desc, rest = _split(codec, data[1:])
        out.put(f"{frame}:{_text(codec, desc)}", _values(codec, rest) if frame == "TXXX" else [rest.split(b"\0")[0].decode("latin-1")])
    elif frame in ("COMM", "USLT"):
        desc, rest = _split(codec, data[4:])
        values = _values(codec, rest) or [""]
        out.put(f"{frame}:{_text(codec, desc)}:{data[1:4].decode('latin-1')}", values if frame == "COMM" else values[:1])
    elif frame.startswith("T"):
        out.put(frame, _values(codec, data[1:]))
    elif frame.startswith("W"):
        out.put(frame, [data.split(b"\0")[0].decode("latin-1")])
    elif frame == "APIC":
        mime, rest = _split(0, data[1:])
        desc, image = _split(codec, rest[1:])
        out.extra.setdefault("pictures", []).append({"mime_type": mime.decode("latin-1"), "picture_type": rest[0] if rest else 0, "description": _text(codec, desc), "data": base64.b64encode(image).decode()})
    elif frame == "UFID":
        owner, rest = _split(0, data)
        out.put(f"UFID:{owner.decode('latin-1')}", [rest.decode("latin-1")])
    elif frame == "PCNT":
        out.put(frame, [str(int.from_bytes(data, "big"))])
    elif frame == "POPM":
        mail, rest = _split(0, data)
        out.put(f"POPM:{mail.decode('latin-1')}", [str(rest[0]) if rest else "0", *([str(int.from_bytes(rest[1:], "big"))] if rest[1:] else [])])
    elif frame == "RVA2":
        desc, rest = _split(0, data)
        if len(rest) >= 4 and rest[0] == 1:
            gain = int.from_bytes(rest[1:3], "big", signed=True) / 512
            size = (rest[3] + 7) // 8
            peak = int.from_bytes(rest[4 : 4 + size], "big") / (1 << max(rest[3] - 1, 0)) if rest[3] else 0.0
            out.extra.setdefault("rva2", []).append({"desc": desc.decode("latin-1"), "gain": gain, "peak": peak})
    else:
        entry = {"id": frame, "data": base64.b64encode(data).decode()}
        if frame in frames.SPECS:
            try:
                fields = frames.decode(frame, data, lambda body: [(f, d) for f, d, _ in _frames(body, 4 if major == 2 else major, False)])
                entry |= {"key": frames.key(frame, fields), "fields": fields}
            except (ParseError, ValueError, IndexError):
                entry["key"] = frame  # bytes alone
        out.extra.setdefault("frames", []).append(entry)


def is_item(frame: str) -> bool:
    """Whether a frame's content is an item, not kept beside the items."""
    return frame[0] in "TW" or frame in ("COMM", "USLT", "UFID", "PCNT", "POPM")


def _frames(body: bytes, major: int, plain: bool) -> list[tuple[str, bytes, bool]]:
    """(id, payload, encrypted) of each frame; an encrypted one's payload is as version 2.4 has it, behind its two bytes of flags."""
    out, at, width = [], 0, 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at] != 0:
        name = body[at : at + width]
        if not re.fullmatch(rb"[A-Z][A-Z0-9]{2,3}", name):
            break
        raw = body[at + width : at + 2 * width]
        size = int.from_bytes(raw, "big") if major < 4 or plain else synchsafe(raw)
        flags = b"\0\0" if major == 2 else body[at + 8 : at + 10]
        data = body[at + head : at + head + size]
        if len(data) < size:
            break
        at += head + size
        if major == 3 and flags[1] & 0x40:
            grouped, packed = data[5:6] if flags[1] & 0x20 else b"", flags[1] & 0x80
            if packed:  # the size goes behind the method
                data = grouped + data[4:5] + _size(int.from_bytes(data[:4], "big")) + data[5 + len(grouped) :]
            out.append((name.decode(), bytes((0, 0x04 | (0x40 if grouped else 0) | (0x09 if packed else 0))) + data, True))
            continue
        if major == 4 and flags[1] & 0x04:
            out.append((name.decode(), flags + data, True))
            continue
        if major == 3:
            if flags[1] & 0x80:
                data = data[:4] + _inflated(data[4:])
                data = data[4:]
            if flags[1] & 0x20:
                data = data[1:]
        if major == 4:
            if flags[1] & 0x40:
                data = data[1:]
            if flags[1] & 0x01 or flags[1] & 0x08:
                data = data[4:]
            if flags[1] & 0x02:
                data = data.replace(b"\xff\0", b"\xff")
            if flags[1] & 0x08:
                data = _inflated(data)
        out.append((name.decode(), data, False))
    return out


def _inflated(data: bytes) -> bytes:
    try:
        packed = zlib.decompressobj()
        out = packed.decompress(data, LIMITS.tag)
        if packed.unconsumed_tail:
            raise ParseError("limit", f"compressed frame of over {LIMITS.tag} bytes")
        return out
    except zlib.error as e:
        raise ParseError("id3", f"compressed frame: {e}") from e


def _body(data: bytes, at: int) -> tuple[int, bytes]:
    """Version and frames of the ID3v2 tag at a place."""
    major, flags = data[at + 3], data[at + 5]
    if major not in (2, 3, 4):
        raise ParseError("id3", f"version 2.{major}")
    body = data[at + 10 : at + 10 + synchsafe(data[at + 6 : at + 10])]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and major > 2 and len(body) >= 4:
        body = body[synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big") :]
    return major, body


def _read(body: bytes, major: int) -> list[tuple[str, bytes, bool]]:
    """Frames with ids and layouts of version 2.4."""
    found = _frames(body, major, False)
    if major == 4:
        plain = _frames(body, major, True)  # some writers store plain sizes; the reading that finds more frames is right
        found = plain if len(plain) > len(found) else found
    out = []
    for frame, content, encrypted in found:
        frame = UPGRADE.get(frame, frame) if major == 2 else frame
        if frame == "APIC" and major == 2 and len(content) > 5:
            content = content[:1] + {b"JPG": b"image/jpeg", b"PNG": b"image/png"}.get(content[1:4], content[1:4]) + b"\0" + content[4:]
        if frame == "IPLS" and major < 4:
            frame = "TIPL"
        out.append((frame, content, encrypted))
    return out


#: Frames that version 2.4 has no more.
_GONE = {"RVAD", "EQUA", "TRDA", "TSIZ", "TDAT", "TIME"}


def picture_frames(pictures: list[dict]) -> bytes:
    """APIC frames of pictures."""
    out = b""
    for p in pictures:
        body = frames.encode("APIC", {"encoding": 3, "mime": p.get("mime_type") or "", "type": p.get("picture_type", 3), "desc": p.get("description") or "", "data": p["data"]})
        out += b"APIC" + _size(len(body)) + b"\0\0" + body
    return out


def kept(data: bytes, at: int = 0, pictures: bool = True) -> bytes:
    """The frames, in version 2.4, of the tag at a place that are no items: pictures, private data, chapters, unknown ones. Nothing if there is no tag."""
    if not tag_size(data, at):
        return b""
    major, body = _body(data, at)
    out = b""
    for frame, content, encrypted in _read(body, major):
        if len(frame) == 4 and (encrypted or not is_item(frame)) and not (major < 4 and frame in _GONE) and (pictures or frame != "APIC"):
            flags, content = (content[:2], content[2:]) if encrypted else (b"\0\0", content)
            out += frame.encode() + _size(len(content)) + flags + content
    return out


def decode(data: bytes, at: int = 0, out: Parsed | None = None, upgrade: bool = True) -> Parsed:
    """Items of the ID3v2 tag at a place; nothing if there is none."""
    out = out or Parsed()
    size = tag_size(data, at)
    if not size:
        return out
    if size > LIMITS.tag + 20:
        raise ParseError("limit", f"tag of {size} bytes")
    major, body = _body(data, at)
    for frame, content, encrypted in _read(body, major):
        if encrypted:
            out.extra.setdefault("frames", []).append({"id": frame, "encrypted": True, "data": base64.b64encode(content).decode()})
        else:
            _frame(out, frame, content, major)
    out.extra["id3_version"] = f"2.{major}"
    return migrate(out) if upgrade and major < 4 else out


def migrate(out: Parsed) -> Parsed:
    """Older frames as version 2.4 has them: TYER, TDAT and TIME become TDRC, TORY becomes TDOR; obsolete ones go."""
    have = dict(out.items)
    text = lambda k: (have.get(k) or [""])[0]
    if "TDRC" not in have and re.fullmatch(r"\d{4}", text("TYER")):
        when = text("TYER")
        if re.fullmatch(r"\d{4}", text("TDAT")):
            when += f"-{text('TDAT')[2:]}-{text('TDAT')[:2]}"
            if re.fullmatch(r"\d{4}", text("TIME")):
                when += f"T{text('TIME')[:2]}:{text('TIME')[2:]}:00"
        have["TDRC"] = [when]
        have.pop("TYER")
        have.pop("TDAT", None)
        have.pop("TIME", None)
    if "TDOR" not in have and text("TORY"):
        have["TDOR"] = have.pop("TORY")
    for gone in ("RVAD", "EQUA", "TRDA", "TSIZ", "TDAT", "TIME"):
        have.pop(gone, None)
    out.items = list(have.items())
    return out


def decode_v1(data: bytes) -> Parsed:
    """Items of the 128-byte tag at the end; nothing if there is none."""
    out, tail = Parsed(), data[-128:]
    if len(tail) < 128 or tail[:3] != b"TAG":
        return out
    field = lambda a, n: tail[a : a + n].split(b"\0")[0].decode("latin-1").strip()
    track = tail[126] if tail[125] == 0 and tail[126] else 0
    for key, value in (("TIT2", field(3, 30)), ("TPE1", field(33, 30)), ("TALB", field(63, 30)), ("TDRC", field(93, 4)), ("COMM:ID3v1 Comment:eng", field(97, 28 if track else 30)), ("TRCK", str(track or "")), ("TCON", str(tail[127]) if tail[127] < len(GENRES) else "")):
        if value:
            out.items.append((key, [value]))
    return out


def _size(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def encode(items: list[tuple[str, list[str]]], others: bytes = b"", place: tuple[int, int] = (0, 0), policy: Padding = padding) -> bytes:
    """A version 2.4 tag, in UTF-8, of text, comment, lyrics, link, identifier, counter and rating items, and of other frames as kept() gives them.

    place is the size of the old tag and of what stands behind it, from which policy tells the padding.
    """
    made = []
    for key, values in sorted(items):
        frame, _, rest = key.partition(":")
        if not values or not re.fullmatch(r"[A-Z][A-Z0-9]{3}", frame):
            continue
        text = "\0".join(values).encode()
        if frame == "TXXX":
            body = b"\x03" + rest.encode() + b"\0" + text
        elif frame in ("COMM", "USLT"):
            desc, _, lang = rest.rpartition(":")
            body = b"\x03" + (lang or "XXX").encode("latin-1", "replace")[:3].ljust(3, b"X") + desc.encode() + b"\0" + text
        elif frame == "WXXX":
            body = b"\x03" + rest.encode() + b"\0" + values[0].encode("latin-1", "replace")
        elif frame.startswith("T"):
            body = b"\x03" + text
        elif frame.startswith("W"):
            body = values[0].encode("latin-1", "replace")
        elif frame == "UFID":
            body = rest.encode("latin-1", "replace") + b"\0" + values[0].encode("latin-1", "replace")
        elif frame == "PCNT" and values[0].isdigit():
            body = _count(values[0])
        elif frame == "POPM" and values[0].isdigit():
            body = rest.encode("latin-1", "replace") + b"\0" + bytes((min(int(values[0]), 255),)) + (_count(values[1]) if len(values) > 1 and values[1].isdigit() else b"")
        else:
            continue
        made.append(frame.encode() + _size(len(body)) + b"\0\0" + body)
    body = b"".join(made) + others
    body += bytes(max(0, policy(place[0] - 10 - len(body), place[1])))
    if len(body) >= 1 << 28:
        raise ParseError("limit", "tag too large")
    return b"ID3\x04\0\0" + _size(len(body)) + body if made or others else b""


def _count(text: str) -> bytes:
    n = int(text)
    return n.to_bytes(max(4, (n.bit_length() + 7) // 8), "big")


def encode_v1(items: list[tuple[str, list[str]]]) -> bytes:
    have = {k.split(":")[0]: v[0] for k, v in reversed(items) if v}
    put = lambda k, n: have.get(k, "").encode("latin-1", "replace")[:n].ljust(n, b"\0")
    track = re.match(r"\d+", have.get("TRCK", ""))
    number = int(track[0]) if track and int(track[0]) < 256 else 0
    genre = have.get("TCON", "")
    code = int(genre) if genre.isdigit() and int(genre) < len(GENRES) else GENRES.index(genre) if genre in GENRES else 255
    comment = put("COMM", 28) + bytes((0, number)) if number else put("COMM", 30)
    return b"TAG" + put("TIT2", 30) + put("TPE1", 30) + put("TALB", 30) + put("TDRC", 4) + comment + bytes((code,))


def before_audio(data: bytes) -> tuple[int, Parsed]:
    """Where the audio starts behind ID3v2 tags at the start, and their items."""
    at, out = 0, Parsed()
    while size := tag_size(data, at):
        decode(data, at, out)
        at += size
    return at, out


def both(data: bytes) -> Parsed:
    """Items of the tag at the start, or of the one at the end if there are none."""
    _, out = before_audio(data)
    return out if out.items or out.extra else decode_v1(data)


def chunk_tag(data: bytes, at: int, size: int) -> Parsed:
    return decode(take(data, at, min(size, len(data) - at)))
