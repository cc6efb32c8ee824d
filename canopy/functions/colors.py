"""Colours of tracked ids."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash's multiplier, the least saturation and the value of a colour.
MULTIPLIER, SATURATION, VALUE = 0x45D9F3B, 0.7, 0.9

_WORD = 1 << 32


def _folded(x: Column) -> Column:
    return F.shiftright(x, 16).bitwiseXOR(x)


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def jenkins_hash(key: Column) -> Column:
    """The hash as a decimal, for keys from 0 to 2^36. Its last product passes 64 bits and is not cut: it is made of
    two words of 32 bits, of which only the lower is mixed with the whole."""
    x = _folded(_folded(key.cast("bigint")) * MULTIPLIER)
    low = _low(x, 32) * MULTIPLIER
    high = F.shiftright(x, 32) * MULTIPLIER + F.shiftright(low, 32)
    middle = F.shiftleft(_low(high, 16), 16).bitwiseOR(F.shiftright(_low(low, 32), 16))
    top = F.shiftright(high, 16).cast("decimal(20,0)") * F.lit(Decimal(_WORD))
    return top + middle.bitwiseXOR(_low(low, 32)).cast("decimal(20,0)")


def of_id(key: Column) -> Column:
    """(b, g, r), 0 to 255: hue and saturation by the hash; a null id is red."""
    turn = (jenkins_hash(key) % F.lit(Decimal(720))).cast("int")
    sixth = (turn % 360) / 360 * 6
    s = F.when(turn < 360, SATURATION).otherwise(1.0)
    sector, part = F.floor(sixth).cast("int"), sixth - F.floor(sixth)
    v = F.lit(VALUE)
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))

    def channel(*by_sector: Column) -> Column:
        return F.when(key.isNotNull(), (F.element_at(F.array(*by_sector), sector + 1) * 255).cast("int"))

    red, green, blue = channel(v, q, p, p, t, v), channel(t, v, v, q, p, p), channel(p, p, t, v, v, q)
    return F.struct(F.coalesce(blue, F.lit(0)).alias("b"), F.coalesce(green, F.lit(0)).alias("g"), F.coalesce(red, F.lit(255)).alias("r"))
