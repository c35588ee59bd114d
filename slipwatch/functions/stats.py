"""Normal tail as a column expression (Spark has no erf)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: power series below 2, continued fraction above."""
    sq = x * x
    # erf(x) = 2/sqrt(pi) * exp(-x^2) * sum x * (2x^2)^n / (1*3*5*...)
    series = F.lit(1.0)
    for n in range(40, 0, -1):
        series = series * sq * (2.0 / (2 * n + 1)) + 1.0
    small = F.lit(1.0) - x * series * F.exp(-sq) * (2.0 / math.sqrt(math.pi))
    fraction = x
    for n in range(60, 0, -1):
        fraction = x + F.lit(n / 2.0) / fraction
    large = F.exp(-sq) / (fraction * math.sqrt(math.pi))
    return F.when(x < 2.0, small).otherwise(large)


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2.0))
