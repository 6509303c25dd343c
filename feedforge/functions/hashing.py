"""Seeded hash family and bit helpers that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded(seed: Column, item: Column) -> Column:
    """Unsigned 32 bits of md5 of 'seed:item', as a long."""
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), item).cast("binary")), 1, 8), 16, 10).cast("long")


def trailing_zeros(x: Column) -> Column:
    """Of a 32-bit value; 32 for zero."""
    return F.when(x == 0, F.lit(32)).otherwise(F.bit_count(x.bitwiseAND(-x) - 1)).cast("int")
