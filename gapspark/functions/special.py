"""Special functions as Spark expressions (no UDF): normal, chi-square, Student t, ln n!.

The rational approximation of the normal tail is Hart's (1968) double-precision form; the other
tails are the textbook finite series for integer degrees of freedom.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Hart's approximation, highest power first.
_HART_NUM = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_DEN = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_HART_SWITCH = 7.07106781186547
_SQRT_2PI = 2.506628274631

#: Degrees of freedom that the finite series of Student's t covers.
_LONG_DF = 1000
_REACH = 12.0

Z_975 = 1.959963984540054  # 97.5 % quantile of the standard normal
Z_SHORT = 1.96


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _let(x: Column, formula) -> Column:
    """Evaluates ``x`` once and hands it to ``formula``, instead of copying its expression."""
    return F.get(F.transform(F.array(x), formula), F.lit(0))


def normal_upper_tail(x: Column) -> Column:
    """P(Z > x) for a standard normal Z."""
    return _let(x, _normal_upper_tail)


def _normal_upper_tail(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, _HART_NUM) / _horner(a, _HART_DEN)
    chain = a + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        chain = a + F.lit(k) / chain
    far = e / chain / F.lit(_SQRT_2PI)
    tail = F.when(a > 37, F.lit(0.0)).when(a < _HART_SWITCH, near).otherwise(far)
    return F.when(x >= 0, tail).otherwise(1 - tail)


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * normal_upper_tail(F.abs(z)))


def chi2_upper_tail(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-square X with an integer number of degrees of freedom.

    The finite Poisson-like series, each term as the exponential of its logarithm, so that nothing
    under- or overflows. Only terms within ``_REACH`` standard deviations of the largest one are
    summed; all others together are below 1e-30.
    """
    half = x / 2
    reach = F.lit(_REACH) * F.sqrt(half) + F.lit(100.0)
    shift = F.when(df % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    last = F.floor(df / 2 + shift).cast("bigint") - 1  # terms i = 0 .. last, at i + (0 or 1/2)
    low = F.greatest(F.lit(0).cast("bigint"), F.floor(half - reach).cast("bigint"))
    start = F.when(df % 2 == 0, low).otherwise(F.greatest(F.lit(1).cast("bigint"), low))
    end = F.least(last, F.ceil(half + reach).cast("bigint"))
    series = F.when(end < start, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(start, F.greatest(start, end)), F.lit(0.0),
        lambda total, i: total + F.exp((i - shift) * F.ln(half) - half - ln_gamma(i - shift + 1))))
    tail = series + F.when(df % 2 == 0, F.lit(0.0)).otherwise(2 * normal_upper_tail(F.sqrt(x)))
    return F.when(x <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for Student's t with integer degrees of freedom.

    Up to ``_LONG_DF`` the finite trigonometric series; above it an expansion about the normal
    tail, whose error there is far below 1e-12.
    """
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(theta) * F.cos(theta)
    short = F.least(df, F.lit(_LONG_DF))
    even = F.sin(theta) * F.aggregate(
        F.sequence(F.lit(1), F.greatest((short / 2).cast("int"), F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * c2 * (2 * k - 1) / (2 * k)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    steps = ((short - 1) / 2).cast("int")
    series = F.when(steps < 1, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))),
        F.struct(F.cos(theta).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, k: F.struct(
            (acc["term"] * c2 * (2 * k) / (2 * k + 1)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    ))
    odd = F.lit(2 / math.pi) * (theta + F.sin(theta) * series)
    inside = F.when(df % 2 == 0, even).otherwise(odd)
    a = df - 0.5
    b = 48 * a * a
    y2 = a * F.log1p(t * t / df)
    y = F.sqrt(y2)
    inner = ((((-0.4 * y2 - 3.3) * y2 - 24.0) * y2 - 85.5) / (0.8 * y2 * y2 + 100 + b) + y2 + 3.0) / b + 1.0
    return F.when(df > _LONG_DF, normal_two_sided(inner * y)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def ln_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series, reached by eight steps of recurrence."""
    rising = z
    for k in range(1, 8):
        rising = rising * (z + k)
    x = z + 7
    r = 1 / (x + 1)
    r2 = r * r
    stirling = (x + 0.5) * F.ln(x + 1) - (x + 1) + F.lit(0.5 * math.log(2 * math.pi)) + r * (
        F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * (F.lit(1 / 1680) - r2 * F.lit(1 / 1188)))))
    return F.when(z > 1e6, _stirling(z)).otherwise(stirling - F.ln(rising))


def _stirling(z: Column) -> Column:
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * z)


def ln_factorial(n: Column) -> Column:
    """ln n! in constant time: a short table, then Stirling's series."""
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(16)])
    x = n.cast("double")
    r = 1 / x
    r2 = r * r
    stirling = (x + 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + r * (
        F.lit(1 / 12) - r2 * (F.lit(1 / 360) - r2 * (F.lit(1 / 1260) - r2 * F.lit(1 / 1680)))
    )
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(stirling)


def wilson_bounds(k: Column, n: Column, z: float = Z_975) -> tuple[Column, Column]:
    """Wilson score interval of the proportion k/n, unclipped; NULL for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    z2 = F.lit(z * z)
    denom = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denom
    return centre - half, centre + half


def wilson_clipped(k: Column, n: Column, z: float = Z_SHORT) -> tuple[Column, Column]:
    """Wilson interval clipped to [0, 1]; no trials gives the whole range."""
    lo, hi = wilson_bounds(k, n, z)
    return (
        F.coalesce(F.greatest(F.lit(0.0), lo), F.lit(0.0)),
        F.coalesce(F.least(F.lit(1.0), hi), F.lit(1.0)),
    )
