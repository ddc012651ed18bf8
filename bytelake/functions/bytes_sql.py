"""Catalyst expressions on bytes, words and encoded lengths; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLASH, RAM, RAM_END = 0x08000000, 0x20000000, 0x20080000


def image(text: str | Column) -> Column:
    """A text column as the bytes of an image; null is the empty image."""
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def byte_at(data: Column, at: Column) -> Column:
    """Unsigned byte at a 0-based place, as int; null outside."""
    piece = F.substring(data, at.cast("int") + 1, F.lit(1))
    return F.when(F.octet_length(piece) == 1, F.conv(F.hex(piece), 16, 10).cast("int"))


def word_at(data: Column, at: Column, size: int = 4, endian: str = "le") -> Column:
    """Unsigned word of 2 or 4 bytes as long; -1 where the image is too short."""
    digits = F.hex(F.substring(data, at.cast("int") + 1, F.lit(size)))
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(size)]
    return F.when(F.length(digits) == 2 * size, F.conv(F.concat(*(pairs if endian == "be" else pairs[::-1])), 16, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def uleb_len(n: Column) -> Column:
    """Bytes of an unsigned LEB128 number."""
    steps = [(1 << (7 * k), k) for k in range(1, 9)]
    return reduce(lambda rest, s: F.when(n < s[0], F.lit(s[1])).otherwise(rest), reversed(steps), F.lit(9)).cast("long")


def uleb_hex(n: Column) -> Column:
    """Unsigned LEB128 as upper-case hex digits; null for negative numbers."""
    groups = F.transform(F.sequence(F.lit(0), (uleb_len(n) - 1).cast("int")), lambda k: F.call_function("shiftright", n, k * 7).bitwiseAND(F.lit(127).cast("long")))
    last = F.size(groups) - 1
    return F.when(n >= 0, F.array_join(F.transform(groups, lambda g, i: F.lpad(F.hex(F.when(i < last, g + 128).otherwise(g)), 2, "0")), ""))


def uleb_value(digits: Column) -> Column:
    """The number that uleb_hex() wrote."""
    groups = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(F.reverse(groups), F.lit(0).cast("long"), lambda acc, g: acc * 128 + g % 128)


def copy_cost(old_off: Column, length: Column) -> Column:
    return 1 + uleb_len(old_off) + uleb_len(length)


def add_cost(length: Column) -> Column:
    return 1 + uleb_len(length) + length


def diff_cost(old_off: Column, length: Column) -> Column:
    return copy_cost(old_off, length) + length


def thumb16_branch(h: Column) -> Column:
    conditional = (h.bitwiseAND(0xF000) == 0xD000) & (h.bitwiseAND(0x0F00) != 0x0F00)
    return conditional | (h.bitwiseAND(0xF800) == 0xE000) | h.bitwiseAND(0xFF00).isin(0xB100, 0xB900)


def thumb32_branch(h1: Column, h2: Column) -> Column:
    return h1.bitwiseAND(0xF800).isin(0xF000, 0xF800) & h2.bitwiseAND(0xF800).isin(0xF000, 0xF800)


def arm_branch(w: Column) -> Column:
    return F.shiftrightunsigned(w, 25).bitwiseAND(7) == 5


def arm_branch_register(w: Column) -> Column:
    return w.bitwiseAND(0x0FFFFFF0).isin(0x012FFF10, 0x012FFF30)


def flash_pointer(v: Column, lo: int, hi: int) -> Column:
    return (v >= lo) & (v < hi)
