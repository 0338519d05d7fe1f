"""Numeric column expressions: normal distribution, safe division, shrinkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody, "Rational Chebyshev approximations for the error function" (1969).
# erf on |x| <= 0.46875, erfc on (0.46875, 4], erfc on (4, inf).
_ERF_NUM = (
    1.85777706184603153e-1,
    3.16112374387056560e00,
    1.13864154151050156e02,
    3.77485237685302021e02,
    3.20937758913846947e03,
)
_ERF_DEN = (
    1.0,
    2.36012909523441209e01,
    2.44024637934444173e02,
    1.28261652607737228e03,
    2.84423683343917062e03,
)
_ERFC_NUM = (
    2.15311535474403846e-8,
    5.64188496988670089e-1,
    8.88314979438837594e00,
    6.61191906371416295e01,
    2.98635138197400131e02,
    8.81952221241769090e02,
    1.71204761263407058e03,
    2.05107837782607147e03,
    1.23033935479799725e03,
)
_ERFC_DEN = (
    1.0,
    1.57449261107098347e01,
    1.17693950891312499e02,
    5.37181101862009858e02,
    1.62138957456669019e03,
    3.29079923573345963e03,
    4.36261909014324716e03,
    3.43936767414372164e03,
    1.23033935480374942e03,
)
_TAIL_NUM = (
    1.63153871373020978e-2,
    3.05326634961232344e-1,
    3.60344899949804439e-1,
    1.25781726111229246e-1,
    1.60837851487422766e-2,
    6.58749161529837803e-4,
)
_TAIL_DEN = (
    1.0,
    2.56852019228982242e00,
    1.87295284992346725e00,
    5.27905102951428412e-1,
    6.05183413124413191e-2,
    2.33520497626869185e-3,
)
_INV_SQRT_PI = 5.6418958354775628695e-1

#: Fixed value: the 90th percentile of the standard normal as the interval width uses it.
Z80 = 1.2816


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for coefficient in coefficients[1:]:
        total = total * x + F.lit(coefficient)
    return total


def erf(value: Column) -> Column:
    """Error function as plain arithmetic, so it stays inside whole-stage codegen."""
    x = value.cast("double")
    ax = F.abs(x)
    x2 = x * x
    small = x * _horner(_ERF_NUM, x2) / _horner(_ERF_DEN, x2)
    middle = F.lit(1.0) - F.exp(-x2) * _horner(_ERFC_NUM, ax) / _horner(_ERFC_DEN, ax)
    inv = F.lit(1.0) / x2
    tail = inv * _horner(_TAIL_NUM, inv) / _horner(_TAIL_DEN, inv)
    far = F.lit(1.0) - F.exp(-x2) * (F.lit(_INV_SQRT_PI) - tail) / ax
    magnitude = F.when(ax <= 4.0, middle).when(ax < 26.0, far).otherwise(F.lit(1.0))
    return F.when(ax <= 0.46875, small).otherwise(F.signum(x) * magnitude)


def normal_cdf(value: Column) -> Column:
    """Standard normal distribution function."""
    return F.lit(0.5) * (F.lit(1.0) + erf(value / F.lit(2.0**0.5)))


def safe_divide(numerator: Column, denominator: Column, default: Column | float) -> Column:
    """Quotient, or ``default`` where it is null, not a number or infinite (0/0 and x/0 included)."""
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(F.when(~F.isnan(quotient) & (F.abs(quotient) < float("inf")), quotient), fallback)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def shrunk_mean(total: str, count: str, prior: str | float, weight: float = 2.0) -> Column:
    """``(total + prior*weight) / (count + weight)``; the prior alone where nothing was observed.

    Arguments are SQL expressions: features come by the dozen, and one parsed expression is much
    cheaper to build than ten column objects.
    """
    return F.expr(
        f"(COALESCE({total}, 0D) + ({prior}) * {weight}D) / (COALESCE({count}, 0) + {weight}D)"
    )


def shrunk_volatility(deviation: str, count: str, prior: str | float, weight: float = 2.0) -> Column:
    """Sample deviation pulled toward ``prior``; the prior itself below two observations."""
    return F.expr(
        f"CASE WHEN COALESCE({count}, 0) < 2 THEN CAST({prior} AS DOUBLE)"
        f" ELSE ({deviation} * {count} + ({prior}) * {weight}D) / ({count} + {weight}D) END"
    )


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    result = value
    if low is not None:
        result = F.greatest(result, F.lit(float(low)))
    if high is not None:
        result = F.least(result, F.lit(float(high)))
    return result
