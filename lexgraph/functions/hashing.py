"""Disjunct hashes: FNV-1a over 64-bit values, with the multiplication in 32-bit halves."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed values of the hash.
FNV_OFFSET, FNV_PRIME_LOW = 0xCBF29CE484222325 - (1 << 64), 435
_MASK = 0xFFFFFFFF


def _times_prime(h: Column) -> Column:
    """h * 0x100000001b3 modulo 2**64, without overflow in ANSI mode."""
    lo, hi = h.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(h, 32)
    t = lo * FNV_PRIME_LOW
    top = (hi * FNV_PRIME_LOW + F.shiftrightunsigned(t, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(_MASK))
    return F.shiftleft(top, 32).bitwiseOR(t.bitwiseAND(F.lit(_MASK)))


def disjunct_hash(connectors: Column) -> Column:
    """Hash of an array of structs (dir, word) with numeric words, in the array's order."""
    def step(h: Column, c: Column) -> Column:
        return _times_prime(h.bitwiseXOR(F.shiftleft(c["word"].cast("long"), 1).bitwiseOR(c["dir"].cast("long"))))

    h = F.aggregate(connectors, F.lit(FNV_OFFSET).cast("long"), step)
    return F.when(h == -1, F.lit(0).cast("long")).otherwise(h)
