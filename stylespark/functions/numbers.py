"""Rounding as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylespark.functions.text import let

#: Splits a double into halves of 26 bits, whose products with a short number are exact.
SPLIT = float((1 << 27) + 1)


def round_binary(value: Column, digits: int) -> Column:
    """value rounded to so many decimal digits (5 at most), half to even, by the double's exact binary value, as Python rounds.

    The product with the power of ten is taken without error, as a double and what it lacks; where the double lies midway between two whole
    numbers, what it lacks decides, and only where nothing is lacking the even one is taken. Exact below 2 ** 36 in size; from there on, where doubles
    hardly have digits left, by decimal text. Nulls, NaN and infinities stay."""
    if not 0 <= digits <= 5:
        raise ValueError("0 to 5 digits")
    tens = F.lit(float(10**digits))

    def parts(x: Column) -> Column:
        high = x * SPLIT - (x * SPLIT - x)
        return F.struct((high * tens).alias("a"), ((x - high) * tens).alias("b"))  # both exact

    def summed(p: Column) -> Column:
        total = p["a"] + p["b"]
        return F.struct(total.alias("product"), (p["b"] - (total - p["a"])).alias("lacking"), F.rint(total).alias("whole"))  # exact, as a is the larger one

    def near(q: Column) -> Column:
        over, lacking = q["product"] - q["whole"], q["lacking"]
        # rint() took the even neighbour of a tie. Above it (over is -0.5), what is lacking below zero leads back; below it, above zero, on.
        step = F.when((over == 0.5) & (lacking > 0), 1.0).when((over == -0.5) & (lacking < 0), -1.0)
        return F.coalesce(q["whole"] + step, q["whole"]) / tens

    def rounded(x: Column) -> Column:
        return F.when(x == 0, x).when(F.abs(x) < float(1 << 36), let(let(parts(x), summed), near)).when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.bround(x, digits))

    return let(value.cast("double"), rounded)
