"""Bit tests on packed flag words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def excludes_bitmask(flags: Column, mask: int) -> Column:
    """True (keep) unless all bits of ``mask`` are set."""
    return F.coalesce(flags.bitwiseAND(F.lit(mask)) != mask, F.lit(True))


def has_no_bit_group(flags: Column, groups: Sequence[Sequence[int]]) -> Column:
    """True (keep) unless all bits of at least one group are set.

    A fractional word is truncated; a missing word has no bit set.
    """
    word = F.coalesce(flags.try_cast("bigint"), F.lit(0).cast("bigint"))
    keep = F.lit(True)
    for group in groups:
        mask = sum(1 << bit for bit in set(group))
        keep = keep & (word.bitwiseAND(F.lit(mask).cast("bigint")) != mask)
    return keep
