"""Rounding and ratio helpers that give bit-identical results on every engine.

Spark rounds a double through its decimal text (``round(0.145, 2) = 0.15``)
while most engines round the binary value (``0.14``).  The analyses therefore
never call ``F.round`` on doubles:

* a percentage of two counts is computed in exact integer arithmetic and only
  the final division by ``10**dp`` is floating point (:func:`pct`);
* any other double is rounded half away from zero on its binary value
  (:func:`round_half_away`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pct(num, den, dp: int = 1, scale: int = 100) -> Column:
    """``round(scale * num / den, dp)`` half-up, exactly, for counts ``num >= 0``.

    NULL when ``den`` is NULL or not positive (the NULLIF guard of the SQL).
    """
    num, den = _c(num).cast("long"), _c(den).cast("long")
    k = 2 * scale * (10 ** dp)
    a = num * F.lit(k) + den
    b = den * F.lit(2)
    quotient = (a - F.pmod(a, b)) / b          # exact integer, held in a double
    return F.when(den > 0, quotient / F.lit(float(10 ** dp)))


def round_half_away(x, dp: int) -> Column:
    """Round a double half away from zero on its binary value."""
    x = _c(x).cast("double")
    p = float(10 ** dp)
    return F.signum(x) * F.floor(F.abs(x) * F.lit(p) + F.lit(0.5)) / F.lit(p)
