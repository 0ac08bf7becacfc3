"""Rounding by exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def rounded(value: Column, digits: int) -> Column:
    """Rounded by the exact binary value, ties to even.

    ``round`` and ``bround`` look at the shortest decimal form instead, where a number just beside a tie can seem to be one.
    The product with the power of ten is split into its rounded part and the rounding error, which decides at apparent ties.
    """
    power = float(10**digits)

    def split(x):
        c = x * F.lit(134217729.0)  # 2**27 + 1: halves the digits of a double
        return F.struct((x * F.lit(power)).alias("p"), (c - (c - x)).alias("high"), x.alias("x"))

    def settle(s):
        error = (s["high"] * F.lit(power) - s["p"]) + (s["x"] - s["high"]) * F.lit(power)
        low = F.floor(s["p"]).cast("double")
        whole = F.when((s["p"] - low == 0.5) & (error > 0), low + 1.0).when((s["p"] - low == 0.5) & (error < 0), low).otherwise(F.rint(s["p"]))
        return whole / F.lit(power)

    return let(value.cast("double"), lambda x: let(split(x), settle))
