"""Reading numbers, strings and boxes from untrusted bytes: past the end, numbers are zero and slices short."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta


def be(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n].ljust(n, b"\0"), "big") if at >= 0 else 0


def le(b: bytes, at: int, n: int) -> int:
    return int.from_bytes(b[at : at + n].ljust(n, b"\0"), "little") if at >= 0 else 0


def signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) & 1 else value


def synchsafe(b: bytes, at: int) -> int:
    """28 bits in four bytes of seven."""
    n = 0
    for x in b[at : at + 4].ljust(4, b"\0"):
        n = n << 7 | x & 127
    return n


def latin(b: bytes) -> str:
    return bytes(b).decode("latin-1")


def text(b: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return bytes(b).decode("utf-8")
    except UnicodeDecodeError:
        return latin(b)


def until_nul(b: bytes) -> str:
    return text(bytes(b).split(b"\0", 1)[0])


def windows(b: bytes) -> str:
    return bytes(b).decode("cp1252", "replace")


def inflated(b: bytes, most: int = 64 << 20) -> bytes:
    """zlib data as far as it can be read: truncated or damaged tails are left out."""
    d, out = zlib.decompressobj(), b""
    try:
        out = d.decompress(bytes(b), most)
    except zlib.error:
        d, parts = zlib.decompressobj(), []
        try:
            for i in range(0, len(b), 64):
                parts.append(d.decompress(bytes(b[i : i + 64]), most))
        except zlib.error:
            pass
        out = b"".join(parts)
    return out


def entities(s: str) -> str:
    import html

    return html.unescape(s)


def boxes(b: bytes, start: int, end: int) -> Iterator[tuple[str, int, int, int]]:
    """ISO base media boxes: type, start of the body, end, start of the box."""
    at = start
    while at + 8 <= end:
        size, head = be(b, at, 4), 8
        kind = latin(b[at + 4 : at + 8])
        if size == 1:
            size, head = be(b, at + 8, 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            if at + head > end or size < head:
                return
            size = end - at
        yield kind, at + head, at + size, at
        at += size


def counted(names: list[str]) -> str:
    """Histogram in the order of first occurrence: a×2, b."""
    seen: dict[str, int] = {}
    for x in names:
        seen[x] = seen.get(x, 0) + 1
    return ", ".join(f"{k}×{n}" if n > 1 else k for k, n in seen.items())


# --- formats of values


def size_text(n: int | float | None) -> str:
    if n is None:
        return ""
    if n < 1024:
        return f"{int(n)} B"
    for unit in ("KB", "MB", "GB", "TB"):
        n /= 1024
        if n < 1024 or unit == "TB":
            return f"{int(n * 10 + 0.5) / 10:.1f} {unit}"
    return ""


def number(x: float) -> str:
    """Up to six decimals, without trailing zeros."""
    return f"{x:.6f}".rstrip("0").rstrip(".") if x == x and abs(x) != float("inf") else str(x)


def duration_text(seconds: float) -> str:
    """0:02, 2:05, 1:33.50, 1:02:03; hundredths only where they aren't zero."""
    hundredths = int(seconds * 100 + 0.5)
    whole, part = divmod(hundredths, 100)
    hours, rest = divmod(whole, 3600)
    minutes, secs = divmod(rest, 60)
    out = f"{hours}:{minutes:02d}:{secs:02d}" if hours else f"{minutes}:{secs:02d}"
    return f"{out}.{part:02d}" if part else out


def date_text(at: datetime) -> str:
    return at.strftime("%Y-%m-%d %H:%M:%S UTC")


def seconds_since(year: int, seconds: float) -> str | None:
    try:
        return date_text(datetime(year, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds))
    except OverflowError:
        return None


#: Seconds from 1904 to 1970. A fixed value.
MAC_EPOCH = 2082844800


def mac_date(t: int) -> str | None:
    return seconds_since(1904, t) if t > MAC_EPOCH else None


def half_up(x: float) -> int:
    import math

    return math.floor(x + 0.5)


POSITION = re.compile(r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?")


def iso6709(s: str) -> tuple[float, float, float | None] | None:
    m = POSITION.match(s.strip())
    return (float(m[1]), float(m[2]), float(m[3]) if m[3] else None) if m else None
