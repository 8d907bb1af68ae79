"""Two-proportion test planning as column expressions, so any number of segments scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdfast.config import AB_Z_ALPHA
from holdfast.functions.columns import clip

# Cody's rational approximations of the error function (1969), lowest step first.
NEAR_UP_TO, MIDDLE_UP_TO = 0.46875, 4.0
NEAR = (
    (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
    (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
MIDDLE = (
    (
        5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02,
        8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03,
        2.15311535474403846e-8,
    ),
    (
        1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
        3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03,
    ),
)
FAR = (
    (
        3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
        6.58749161529837803e-4, 1.63153871373020978e-2,
    ),
    (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(x: Column, table: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """Quotient of two polynomials; the first table's last number leads, the second is monic."""
    *upper, lead = table[0]
    over, under = F.lit(lead) * x, x
    for a, b in zip(upper[:-1], table[1][:-1]):
        over, under = (over + F.lit(a)) * x, (under + F.lit(b)) * x
    return (over + F.lit(upper[-1])) / (under + F.lit(table[1][-1]))


def erf(x: Column) -> Column:
    """Error function to about 1e-15 by three quotients of low degree.

    All three are taken, each at its own end of its range where the number lies outside, and one is let through.
    Without branches the generated code works out ``x`` once, so it stays short whatever ``x`` is.
    """
    size = F.abs(x)
    held = F.least(size, F.lit(8.0))  # from there on it is 1
    low = F.least(held, F.lit(NEAR_UP_TO))
    mid = F.greatest(F.least(held, F.lit(MIDDLE_UP_TO)), F.lit(NEAR_UP_TO))
    high = F.greatest(held, F.lit(MIDDLE_UP_TO))
    inverse = F.lit(1.0) / (high * high)
    near = low * _ratio(low * low, NEAR)
    middle = F.lit(1.0) - F.exp(-(mid * mid)) * _ratio(mid, MIDDLE)
    tail = F.lit(1 / math.sqrt(math.pi)) - inverse * _ratio(inverse, FAR)
    far = F.lit(1.0) - F.exp(-(high * high)) / high * tail
    is_near, is_far = (size <= NEAR_UP_TO).cast("double"), (size > MIDDLE_UP_TO).cast("double")
    return F.signum(x) * (is_near * near + is_far * far + (F.lit(1.0) - is_near - is_far) * middle)


def normal_cdf(x: Column) -> Column:
    return (F.lit(1.0) + erf(x / F.sqrt(F.lit(2.0)))) / 2


def _bounded(p: Column) -> Column:
    return clip(p, 1e-6, 1 - 1e-6)


def _spread(p1: Column, p2: Column) -> tuple[Column, Column]:
    pooled = (p1 + p2) / 2
    return pooled * (1 - pooled) * 2, p1 * (1 - p1) + p2 * (1 - p2)


def sample_size(p_control: Column, p_treatment: Column, z_power: Column) -> Column:
    """Rows per arm for a two-sided 5 % test; null when there is no effect to detect."""
    p1, p2 = _bounded(p_control), _bounded(p_treatment)
    null_var, alt_var = _spread(p1, p2)
    reach = F.lit(AB_Z_ALPHA) * F.sqrt(null_var) + z_power * F.sqrt(alt_var)
    effect = F.abs(p1 - p2)
    return F.when(effect > 0, F.ceil(reach * reach / (effect * effect)))


def power(p_control: Column, p_treatment: Column, rows_per_arm: Column) -> Column:
    """Normal-approximation power of the same test with the given rows per arm."""
    p1, p2 = _bounded(p_control), _bounded(p_treatment)
    n = F.greatest(rows_per_arm.cast("double"), F.lit(1.0))
    null_var, alt_var = _spread(p1, p2)
    null_se, alt_se = F.sqrt(null_var / n), F.sqrt(alt_var / n)
    # Bounded rates and at least one row keep both errors above zero.
    score = (F.abs(p1 - p2) - F.lit(AB_Z_ALPHA) * null_se) / alt_se
    return normal_cdf(score)
