"""Sums of doubles that are the same in any order.

A sum of doubles depends on how rows are dealt. Here each value is cut into ``LIMBS`` whole numbers of ``LIMB`` bits below the table's largest exponent; those
are summed as integers, exactly and in any order, and put together once for each group. What a value has below the last limb, 2 ** -120 of the largest, is
left out of every sum alike. Partial aggregation stays as it is: a few integers a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB, LIMBS = 24, 5


def exponent_above(largest: float | None) -> int:
    """The least e for which all magnitudes up to ``largest`` are below 2 ** e; 0 without values."""
    return math.frexp(largest)[1] if largest else 0


def limb_sums(y: str, exponent: int) -> list[Column]:
    """Aggregates s0, s1, ... of the column; its magnitudes are below 2 ** ``exponent``."""
    half = -exponent // 2  # a power of two at a time, so that none overflows
    rest = F.col(y) * F.lit(math.ldexp(1.0, half)) * F.lit(math.ldexp(1.0, -exponent - half))
    out = []
    for k in range(LIMBS):
        scaled = rest * float(1 << LIMB)
        whole = F.floor(scaled)
        out.append(F.sum(whole.cast("long")).alias(f"s{k}"))
        rest = scaled - whole.cast("double")
    return out


def joined_limbs(exponent: int) -> Column:
    """The sum, from s0, s1, ...; limbs carry into the one above first, so each but the first is below 2 ** ``LIMB``."""
    carry, limbs = F.lit(0).cast("long"), []
    for k in reversed(range(LIMBS)):
        s = F.col(f"s{k}") + carry
        limbs.append(s if k == 0 else s.bitwiseAND((1 << LIMB) - 1))
        carry = F.shiftright(s, LIMB)
    total = F.lit(0.0)
    for s in limbs:  # from the least
        total = total / float(1 << LIMB) + s.cast("double")
    half = (exponent - LIMB) // 2
    return total * F.lit(math.ldexp(1.0, half)) * F.lit(math.ldexp(1.0, exponent - LIMB - half))
