"""Index lists and bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_to_mask(indices: Column) -> Column:
    """Bit mask (long) of an array of indices from 0 to 62."""
    return F.aggregate(F.array_distinct(indices), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def mask_to_list(mask: Column) -> Column:
    """Sorted indices of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("bit_get", mask.cast("long"), i) == 1)
