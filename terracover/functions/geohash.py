"""Geohash encoding as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value


def encode(lat: Column, lon: Column, length: int) -> Column:
    """Base-32 geohash; null outside the valid range.

    Each axis is scaled to an integer of its number of bits; a character takes five interleaved bits.
    """
    lon_bits, lat_bits = (5 * length + 1) // 2, 5 * length // 2
    x = F.least(F.floor((lon + 180) / 360 * F.lit(float(1 << lon_bits))), F.lit((1 << lon_bits) - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * F.lit(float(1 << lat_bits))), F.lit((1 << lat_bits) - 1)).cast("long")
    chars = []
    for k in range(length):
        value = F.lit(0).cast("long")
        for j in range(5):
            at = 5 * k + j
            axis, bits = (x, lon_bits) if at % 2 == 0 else (y, lat_bits)
            value = value * 2 + F.shiftright(axis, bits - 1 - at // 2).bitwiseAND(F.lit(1))
        chars.append(F.substr(F.lit(ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.concat(*chars))
