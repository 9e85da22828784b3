"""Counting inversions without listing a pair.

A pair of points is an inversion if one lies strictly before the other by ``a`` and
strictly behind it by ``b``.  Written with digits, two different values of ``b`` have a
first digit in which they differ: they agree in all digits above it.  So each point goes
to one group per digit place, with the points that agree in the digits above, and within
a group the inversions are, along ``a``, the points of higher digits seen so far.  These
running counts are made in two levels, inside blocks of ``BLOCK`` values of ``a`` and over
the blocks, so no window holds more than a block, and a group of any size is spread.

The work is points x places, places being log(range of b) / log(2^BITS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit; values of ``a`` in a block.
BITS = 4
BLOCK = 1024


def inversions(points: DataFrame, keys: list[str], a: str, b: str, top: str) -> DataFrame:
    """(keys, n): pairs of points of one key with ``a`` smaller and ``b`` larger.

    ``a`` and ``b`` are non-negative whole numbers, ``top`` (a column of the points) is at least the largest ``b`` of the
    key.  Keys without points give no row; equal points count each for itself.
    """
    digits = range(1 << BITS)
    places = F.greatest(F.lit(1), F.ceil(F.log2(F.col(top) + 1.0) / BITS).cast("int"))
    at = points.select(*keys, F.col(a).cast("long").alias("__a"), F.col(b).cast("long").alias("__b"), F.explode(F.sequence(F.lit(0), places - 1)).alias("__place"))
    at = at.select(*keys, "__place", F.expr(f"shiftright(__b, (__place + 1) * {BITS})").alias("__above"), (F.expr(f"shiftright(__b, __place * {BITS})") % len(digits)).alias("__digit"), (F.col("__a") / BLOCK).cast("long").alias("__block"), "__a")
    group = [*keys, "__place", "__above"]
    held = at.groupBy(*group, "__block", "__a").agg(*[F.count_if(F.col("__digit") == d).alias(f"c{d}") for d in digits])

    def running(df: DataFrame, within: list[str], along: str, name: str) -> DataFrame:
        """Adds the counts of all rows before, digit by digit."""
        before = Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{name}{d}": F.coalesce(F.sum(f"c{d}").over(before), F.lit(0)) for d in digits})

    inner = running(held, [*group, "__block"], "__a", "i")
    outer = running(held.groupBy(*group, "__block").agg(*[F.sum(f"c{d}").alias(f"c{d}") for d in digits]), group, "__block", "o").drop(*[f"c{d}" for d in digits])
    found: Column = F.lit(0)
    higher: Column = F.lit(0)
    for d in reversed(digits):
        found = found + F.col(f"c{d}") * higher
        higher = higher + F.col(f"i{d}") + F.col(f"o{d}")
    return inner.join(outer, [*group, "__block"]).groupBy(*keys).agg(F.sum(found).alias("n"))
