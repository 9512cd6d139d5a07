"""What every parser gives, and reading helpers that turn short input into a ParseError."""

from __future__ import annotations

import contextlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Fixed value: cap on items of a tag.
MAX_ITEMS = 10_000


@dataclass
class Limits:
    """Caps on bytes of a tag and of an image. The default ones and the permissive ones."""

    tag: int = 8 << 20
    image: int = 16 << 20


PERMISSIVE = Limits(256 << 20, 128 << 20)
#: The caps in force; using() sets others for a while.
LIMITS = Limits()


@contextlib.contextmanager
def using(limits: Limits | None) -> Iterator[None]:
    """Other caps for the parsing done inside."""
    old = Limits(LIMITS.tag, LIMITS.image)
    if limits:
        LIMITS.tag, LIMITS.image = limits.tag, limits.image
    try:
        yield
    finally:
        LIMITS.tag, LIMITS.image = old.tag, old.image


#: Bytes of padding for a tag: from what the old tag's place would leave (negative if it is too small) and the bytes behind it.
Padding = Callable[[int, int], int]


def padding(left: int, content: int) -> int:
    """What is left, if it is from 0 to 10 KiB and 1 % of the content, else 1 KiB and 0.1 %."""
    return left if 0 <= left <= 10 * 1024 + content // 100 else 1024 + content // 1000


class ParseError(ValueError):
    """Input that isn't what its format promises; kind is a short class of the fault."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


@dataclass
class Parsed:
    length_secs: float | None = None
    bitrate: int | None = None
    sample_rate: int | None = None
    channels: int | None = None
    bits_per_sample: int | None = None
    items: list[tuple[str, list[str]]] = field(default_factory=list)
    extra: dict = field(default_factory=dict)

    def put(self, key: str, values: list[str]) -> None:
        """Adds values to a key, behind those it has."""
        for k, have in self.items:
            if k == key:
                have.extend(values)
                return
        self.items.append((key, list(values)))


def take(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise ParseError("truncated", f"{size} bytes at {at} of {len(data)}")
    return data[at : at + size]


def unpack(fmt: str, data: bytes, at: int = 0) -> tuple:
    return struct.unpack(fmt, take(data, at, struct.calcsize(fmt)))


class Bits:
    """Reads numbers of any count of bits, the highest bit first, or the lowest with low=True."""

    def __init__(self, data: bytes, low: bool = False) -> None:
        self.value, self.size, self.at, self.low = int.from_bytes(data, "little" if low else "big"), len(data) * 8, 0, low

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ParseError("truncated", f"{n} bits at {self.at} of {self.size}")
        shift = self.at if self.low else self.size - self.at - n
        self.at += n
        return self.value >> shift & (1 << n) - 1
