"""Bit fields of binary columns as Column expressions, and their inverse. Layouts are compiled to fixed places; nothing runs in Python.

A layout is a list of (name, bits, signed, scale); signed is 0, 1 (two's complement) or 2 (sign and magnitude), an empty name is
skipped. A field that the value is too short for is null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Layout = Iterable[tuple[str, int, int, float]]
POLYNOMIAL = 0x1864CFB


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def number(data: Column, first: Column | int, n: int) -> Column:
    """n bytes (7 at most) from place first (from 1) on as an unsigned number; null if they aren't all there."""
    first = F.lit(first) if isinstance(first, int) else first
    whole = F.conv(F.hex(F.substr(data, first, F.lit(n))), 16, 10).cast("long")
    return F.when(F.length(data) >= first + (n - 1), whole)


def bit_field(data: Column, at: int, bits: int, signed: int = 0) -> Column:
    """The number in the bits [at, at + bits) of data, counted from its first; 49 bits at most."""
    first, last = at // 8, (at + bits - 1) // 8
    raw = F.shiftright(number(data, first + 1, last - first + 1), 8 * (last + 1) - at - bits).bitwiseAND(F.lit((1 << bits) - 1))
    if signed == 1:
        return F.shiftright(F.shiftleft(raw, 64 - bits), 64 - bits)
    if signed == 2:
        return once(raw, lambda x: F.when(x >= 1 << bits - 1, F.lit(1 << bits - 1) - x).otherwise(x))
    return raw


def fields(data: Column, layout: Layout, at: int = 0) -> dict[str, Column]:
    """A Column for each named field of a layout that begins at bit at; scaled ones are doubles. data is best a column that is stored."""
    out = {}
    for name, bits, signed, scale in layout:
        if name:
            raw = bit_field(data, at, bits, signed)
            out[name] = raw if scale == 1 else raw * F.lit(float(scale))
        at += bits
    return out


def width(layout: Layout) -> int:
    return sum(bits for _, bits, _, _ in layout)


def packed(values: Iterable[tuple[Column | int, int, int]]) -> Column:
    """The binary of (number, bits, signed) one after another, filled with zeros to whole bytes. Numbers are cut to their bits."""
    text, total = [], 0
    for value, bits, signed in values:
        value = F.lit(value).cast("long") if isinstance(value, int) else value.cast("long")
        if signed == 2:
            value = F.when(value < 0, (1 << bits - 1) - value).otherwise(value)
        text.append(F.lpad(F.bin(value.bitwiseAND(F.lit((1 << bits) - 1))), bits, "0"))
        total += bits
    size = -(-total // 8) * 8
    whole = F.concat(*text, F.lit("0" * (size - total)))
    cuts = [(a, min(48, size - a)) for a in range(0, size, 48)]
    return once(whole, lambda w: F.unhex(F.concat(*[F.lpad(F.conv(F.substring(w, a + 1, n), 2, 16), n // 4, "0") for a, n in cuts])))


def _table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (POLYNOMIAL if crc & 0x800000 else 0)
        out.append(crc & 0xFFFFFF)
    return out


def crc24q(data: Column) -> Column:
    """The check of a binary value, by its bytes through a table."""
    table = F.array(*[F.lit(x) for x in _table()])
    # a character per byte; data is named once, so that it isn't made anew for each of its bytes
    letters = F.split(F.decode(data, "ISO-8859-1"), "")
    step = lambda crc, x: F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFFFF)).bitwiseXOR(F.get(table, F.shiftright(crc, 16).bitwiseXOR(F.ascii(x))))
    return F.aggregate(letters, F.lit(0), step)


def framed(payload: Column) -> Column:
    """A frame around a payload of up to 1,023 bytes: preamble, length and check."""
    head = once(payload, lambda p: F.unhex(F.concat(F.lit("D3"), F.lpad(F.hex(F.length(p)), 4, "0"), F.hex(p))))
    return once(head, lambda h: F.unhex(F.concat(F.hex(h), F.lpad(F.hex(crc24q(h)), 6, "0"))))


def payload(frame: Column) -> Column:
    """The payload of one whole frame; null if its preamble, length or check is wrong."""
    size = number(frame, 2, 2).cast("int")
    body = F.substr(frame, F.lit(1), size + 3)
    good = (number(frame, 1, 1) == 0xD3) & (size < 1024) & (F.length(frame) == size + 6)
    return F.when(good & (crc24q(body) == number(frame, size + 4, 3)), F.substr(frame, F.lit(4), size))
