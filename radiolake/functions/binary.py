"""Numbers and records inside BINARY columns, as plain Spark SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Offset = int | Column


def _at(i: Offset) -> Column:
    return F.lit(i) if isinstance(i, int) else i


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it and in whichever branch."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def part(b: Column, start: Offset, length: Offset) -> Column:
    """``length`` bytes from the 0-based ``start``; fewer at the end."""
    return F.substring(b, _at(start) + 1, _at(length))


def tail(b: Column, start: Offset) -> Column:
    return part(b, start, F.length(b))


def u8(b: Column, i: Offset) -> Column:
    """The byte at ``i`` as INT; null beyond the end."""
    return F.conv(F.nullif(F.hex(part(b, i, 1)), F.lit("")), 16, 10).cast("int")


def i8(b: Column, i: Offset) -> Column:
    v = u8(b, i)
    return F.when(v > 127, v - 256).otherwise(v)


def le16(b: Column, i: Offset) -> Column:
    return u8(b, i) + u8(b, _at(i) + 1) * 256


def be16(b: Column, i: Offset) -> Column:
    return u8(b, i) * 256 + u8(b, _at(i) + 1)


def le24(b: Column, i: Offset) -> Column:
    return le16(b, i) + u8(b, _at(i) + 2) * 65536


def mac(b: Column, start: Offset) -> Column:
    """Six bytes sent least significant first as ``aa:bb:cc:dd:ee:ff``."""
    digits = F.lower(F.hex(part(b, start, 6)))
    return F.when(F.length(digits) == 12, F.concat_ws(":", *[F.substring(digits, 2 * k + 1, 2) for k in range(5, -1, -1)]))


def to_bytes(text: Column) -> Column:
    """Hex text, with or without colons and blanks, as BINARY; null where it is none."""
    return F.try_to_binary(F.nullif(F.regexp_replace(text, "[: ]", ""), F.lit("")), F.lit("hex"))


def records(b: Column, start: int, item: Callable[[Column, Column], Column], size: Callable[[Column, Column], Column], kind: str) -> Column:
    """Consecutive variable-length records as an array, by one fold over the bytes.

    ``item(b, at)`` is the record at an offset, of SQL type ``kind``; ``size(b, at)`` its whole length, null where no record begins and
    reading stops. A null ``b`` gives null.
    """
    state = F.struct(F.lit(start).alias("at"), F.lit(None).cast(f"array<{kind}>").alias("out"))
    first = F.struct(state["at"].alias("at"), F.coalesce(state["out"], F.array().cast(f"array<{kind}>")).alias("out"))

    def step(s: Column, _: Column) -> Column:
        n = size(b, s["at"])
        return F.when(n.isNull(), s).otherwise(F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(item(b, s["at"]).cast(kind))).alias("out")))

    turns = F.greatest(F.lit(1), F.floor(F.length(b) / 2).cast("int"))
    return F.when(b.isNotNull(), F.aggregate(F.sequence(F.lit(1), turns), first, step, lambda s: s["out"]))
