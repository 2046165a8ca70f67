"""Unsigned numbers out of BINARY columns. A position past the end gives null, never an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(data: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from position at (from 0)."""
    return F.substr(data, _col(at) + 1, _col(n))


def number(data: Column, at: Column | int, n: int) -> Column:
    """A big-endian unsigned number of n bytes as LONG; null unless all of them are there."""
    part = cut(data, at, n)
    return F.when((_col(at) >= 0) & (F.octet_length(part) == n), F.conv(F.hex(part), 16, 10).cast("long"))


def u8(data: Column, at: Column | int) -> Column:
    return number(data, at, 1).cast("int")


def u16(data: Column, at: Column | int) -> Column:
    return number(data, at, 2).cast("int")


def u32(data: Column, at: Column | int) -> Column:
    return number(data, at, 4)
