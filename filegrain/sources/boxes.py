"""Top-level boxes of ISO media by expressions: a walk from header to header over the pieces of a file that have been read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BOXES = 2000
BOX = "struct<type:string,s:bigint,e:bigint,head:int>"
#: More than any file has; a size that no long holds.
ENDLESS = 1 << 62


def bytes_at(pieces: Column, at: Column, n: int) -> Column:
    """The n bytes at a place of a file whose pieces (s, bytes) are in order and don't overlap; fewer if they aren't there."""
    def part(p: Column) -> Column:
        skip = F.greatest(at - p["s"], F.lit(0).cast("long"))
        return F.substring(p["bytes"], (skip + 1).cast("int"), (at + n - p["s"] - skip).cast("int"))

    here = F.filter(pieces, lambda p: (p["s"] < at + n) & (p["s"] + F.octet_length(p["bytes"]) > at))
    return F.aggregate(here, F.lit(b"").cast("binary"), lambda got, p: F.concat(got, part(p)))


def _number(data: Column, place: int, n: int) -> Column:
    """Big-endian and unsigned; more than a long holds is ENDLESS."""
    return F.coalesce(F.conv(F.hex(F.substring(data, place + 1, n)), 16, 10).try_cast("long"), F.lit(ENDLESS))


def top_boxes(pieces: Column, size: Column, most: int = MOST_BOXES) -> Column:
    """struct(boxes, next) of a file: its boxes (type, s, e, head) as far as their headers are in pieces (null: none), and where the walk needs 16 more bytes (null: it's over).

    A size of 1 says that 64 bits follow, 0 that the box goes to the end. The walk ends where fewer than 8 bytes are left, at a
    size below the header's own, and after so many boxes. A file without a size has no boxes. It's one expression for each row, without a
    shuffle; where next is given, reading (next, next + 16) and asking again goes on.
    """
    size, none = size.cast("long"), F.lit(None).cast("long")
    given = F.coalesce(pieces, F.array().cast("array<struct<s:bigint,bytes:binary>>"))
    state = lambda at, boxes, lost: F.struct(at.alias("at"), boxes.alias("boxes"), lost.alias("next"))
    over = lambda s: state(none, s["boxes"], none)

    def hop(s: Column, _: Column) -> Column:
        at = s["at"]

        def told(h: Column) -> Column:
            short = _number(h, 0, 4)
            head = F.when(short == 1, 16).otherwise(8)
            n = F.when(short == 1, _number(h, 8, 8)).when(short == 0, size - at).otherwise(short)
            known = F.octet_length(h) >= F.when(F.octet_length(h) < 8, 16).when(short == 1, F.least(size - at, F.lit(16))).otherwise(8)
            box = F.struct(F.decode(F.substring(h, 5, 4), "ISO-8859-1").alias("type"), at.alias("s"), F.least(size, at + n).alias("e"), head.cast("int").alias("head"))
            on = F.when(n > size - at - 8, none).otherwise(at + n)
            return F.when(~known, state(none, s["boxes"], at)).when(n < head, over(s)).otherwise(state(on, F.concat(s["boxes"], F.array(box)), none))

        header = F.element_at(F.transform(F.array(bytes_at(given, at, 16)), told), 1)
        return F.when(at.isNull(), s).when(at + 8 > size, over(s)).otherwise(header)

    # no file has more boxes than its size has room for
    hops = F.sequence(F.lit(1), F.least(F.lit(most), F.coalesce(F.floor(size / 8), F.lit(0)) + 1).cast("int"))
    walked = F.aggregate(hops, state(F.when(size >= 8, F.lit(0).cast("long")), F.array().cast(f"array<{BOX}>"), none), hop)
    return F.transform(F.array(walked), lambda s: F.struct(s["boxes"].alias("boxes"), s["next"].alias("next")))[0]
