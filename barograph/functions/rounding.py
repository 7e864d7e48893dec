"""Rounding of doubles by their exact binary value, ties to the even digit, as Python's round does it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(x: Column, digits: int = 2) -> Column:
    """0.125 and 0.625 are ties and go to 0.12 and 0.62; 0.615 lies below its tie and goes to 0.61.

    The product with 10**digits is kept exactly, as a sum of two doubles: a number is split into halves of 26 bits, and
    each half has room for the factor.
    """
    scale = float(10 ** digits)

    def halves(size: Column) -> Column:
        spread = size * F.lit(134217729.0)
        high = spread - (spread - size)
        return F.struct((high * scale).alias("left"), ((size - high) * scale).alias("right"))

    def ended(h: Column) -> Column:
        whole = F.floor(h["left"] + h["right"]).cast("double")
        beyond = (h["left"] - whole - 0.5) + h["right"]
        return whole + F.when((beyond > 0) | ((beyond == 0) & (whole % 2 == 1)), 1.0).otherwise(0.0)

    # Lambdas bind a value once; written out, each step would repeat the steps before it.
    one = F.transform(F.transform(F.array(x), lambda v: F.struct(v.alias("v"), halves(F.abs(v)).alias("h"))),
                      lambda r: F.signum(r["v"]) * ended(r["h"]) / scale + 0.0)
    return one[0]
