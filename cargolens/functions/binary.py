"""Byte-level expressions on binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_at(content: Column, offset: int, n: int) -> Column:
    return F.substring(content, offset + 1, n)


def starts_with_bytes(content: Column, magic: bytes, offset: int = 0) -> Column:
    return bytes_at(content, offset, len(magic)) == F.lit(bytearray(magic))


def byte_at(content: Column, offset: int) -> Column:
    """One unsigned byte, null beyond the end."""
    return be_uint(bytes_at(content, offset, 1)).cast("int")


def be_uint(chunk: Column) -> Column:
    """Unsigned big-endian integer of up to 8 bytes; null for an empty chunk."""
    digits = F.hex(chunk)
    return F.when(
        F.length(digits) > 0, F.conv(digits, 16, 10).cast("decimal(20,0)")
    )


def le_uint(chunk: Column, width: int) -> Column:
    """Unsigned little-endian integer of exactly ``width`` bytes; null when shorter."""
    digits = F.hex(chunk)
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(
        F.length(digits) == 2 * width, F.conv(turned, 16, 10).cast("decimal(20,0)")
    )


def latin1(content: Column) -> Column:
    """One character per byte, so that regular expressions can match raw bytes."""
    return F.decode(content, "ISO-8859-1")
