"""Numbers with defined results at the edges: no division raises, no NaN passes a comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the Chebyshev fit of erfc (public, Numerical Recipes), to 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Fixed value: the constant of the closed-form inverse error function.
_ERF_INV_A = 0.147


def num(c: Column | str | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c))


def or_default(c: Column | str, default: float) -> Column:
    """``c``, or the default where it is null, NaN or zero."""
    x = num(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(float(default))).otherwise(x)


def safe_div(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b, the default where b is zero or the quotient is null or NaN."""
    q = F.try_divide(num(a).cast("double"), num(b).cast("double"))
    q = F.when(F.isnan(q), F.lit(None)).otherwise(q)
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), num(c)))


def erf(x: Column | str) -> Column:
    """The error function to 1.2e-7."""
    x = num(x)
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(poly - x * x)
    return F.when(x >= 0, 1.0 - tail).otherwise(tail - 1.0)


def erf_compat(x: Column | str) -> Column:
    """A coarser variant that mixes constants of two formulas (error up to 0.012), for comparisons only."""
    x = num(x)
    t = 1.0 / (1.0 + 0.47047 * F.abs(x))
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    r = 1.0 - t * F.exp(poly - x * x)
    return F.when(x >= 0, r).otherwise(-r)


def erf_inv(x: Column | str) -> Column:
    x = num(x)
    ln = F.log(1 - x * x)
    part = 2 / (math.pi * _ERF_INV_A) + ln / 2
    return F.signum(x) * F.sqrt(F.sqrt(part * part - ln / _ERF_INV_A) - part)


def normal_cdf(x: Column | str, mean: Column | str | float = 0.0, sd: Column | str | float = 1.0) -> Column:
    return 0.5 * (1 + erf(safe_div(num(x) - num(mean), num(sd) * math.sqrt(2.0))))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = safe_div(x - mean, sd)
    return safe_div(F.exp(-0.5 * z * z), sd * math.sqrt(2 * math.pi))


def half_up(x: Column | str) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(num(x) + 0.5)


def ms(ts: Column | str) -> Column:
    """Epoch milliseconds (double) of a timestamp of either kind, read as UTC."""
    return F.unix_micros(num(ts).cast("timestamp")) / 1000.0


def age_days(ts: Column | str, as_of: Column) -> Column:
    return (ms(as_of) - ms(ts)) / 86_400_000.0
