"""Binary interop form of a series: big-endian words, bytes and comma text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtide.constants import BANDS

WORD_MAX = 65535
BYTE_MAX = 255


def _checked(values: Column, top: int, what: str) -> Column:
    bad = F.exists(values, lambda x: (x < 0) | (x > top))
    return F.when(bad, F.raise_error(F.lit(f"{what} outside 0..{top}"))).otherwise(values)


def _pack(values: Column, width: int, top: int, what: str) -> Column:
    digits = F.transform(_checked(values, top, what), lambda x: F.lpad(F.hex(x), width, "0"))
    return F.unhex(F.array_join(digits, ""))


def pack_words(values: Column, what: str = "value") -> Column:
    """Integers as big-endian 16-bit words; anything outside the range is an error."""
    return _pack(values, 4, WORD_MAX, what)


def pack_bytes(values: Column, what: str = "value") -> Column:
    return _pack(values, 2, BYTE_MAX, what)


def _steps(count: Column) -> Column:
    return F.when(count >= 1, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))


def _number_at(blob: Column, i: Column, size: int) -> Column:
    """Unsigned big-endian number at position i; reads only its own bytes."""
    return F.conv(F.hex(F.substring(blob, i * size + 1, F.lit(size))), 16, 10).cast("int")


def unpack_words(blob: Column) -> Column:
    count = F.floor(F.length(blob) / 2).cast("int")
    return F.transform(_steps(count), lambda i: _number_at(blob, i, 2))


def unpack_bytes(blob: Column) -> Column:
    return F.transform(_steps(F.length(blob)), lambda i: _number_at(blob, i, 1))


def unpack_rows(blob: Column, width: int = len(BANDS)) -> Column:
    """Words cut into rows of `width` (one row of bands per image)."""
    count = F.floor(F.length(blob) / (2 * width)).cast("int")
    columns = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(_steps(count), lambda i: F.transform(
        columns, lambda k: _number_at(blob, i * width + k, 2)))


def epoch_day(date: Column) -> Column:
    return F.unix_date(date)


def encode_text(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def decode_text(blob: Column) -> Column:
    return F.decode(blob, "UTF-8")
