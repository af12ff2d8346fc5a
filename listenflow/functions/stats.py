"""Normal distribution helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed: Abramowitz & Stegun 26.2.17 coefficients (|error| < 7.5e-8)
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 0.3989422804014327
Z_95 = 1.959963984540054


def normal_cdf(z) -> Column:
    """Standard normal CDF Φ(z) (neither Spark nor most SQL engines have erf)."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * x)
    poly = t * (F.lit(AS_B[0]) + t * (F.lit(AS_B[1]) + t * (F.lit(AS_B[2]) + t * (F.lit(AS_B[3]) + t * F.lit(AS_B[4])))))
    upper = F.lit(INV_SQRT_2PI) * F.exp(-x * x / F.lit(2.0)) * poly     # 1 - Φ(|z|)
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def two_sided_p(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))
