"""Integer codings of time-series streams (S-32..S-35, S-38, H-30..H-32)."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def delta(v: Column, order: WindowSpec) -> Column:
    """S-32: difference to the sample before, the first to zero."""
    return v - F.lag(v, 1, 0).over(order)


def undelta(d: Column, order: WindowSpec) -> Column:
    return F.sum(d).over(order.rowsBetween(-(1 << 62), 0))


def zigzag(v: Column) -> Column:
    """S-33: small magnitudes of either sign to small numbers."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1).cast("long"))))


def xor_delta(v: Column, order: WindowSpec) -> Column:
    """S-34 on integers."""
    return v.bitwiseXOR(F.lag(v, 1, 0).over(order))


def vbyte_length(u: Column) -> Column:
    """S-35, H-31: bytes of a 7-bit variable-length code of a non-negative number."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(u)) / 7)).cast("long")
