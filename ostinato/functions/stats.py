"""Distribution functions and statistics in closed form, as column expressions.

Every test of the engine that drops or adds one cosine and sine has two numerator degrees of freedom, whose F
distribution is a power; the other cases are finite sums over ``sequence``. So p-values stay in generated code and
keep their precision far below the rounding of one minus a cumulative probability.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | float | int


def col(x: ColumnLike | str) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x within bounds; null and NaN stay as they are."""
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(float(lo))).otherwise(out)
    if hi is not None:
        out = F.when((out > hi) & ~F.isnan(out), F.lit(float(hi))).otherwise(out)
    return out


def sum_over(start: Column, stop: Column, term) -> Column:
    """Sum of term(j) for whole j from start to stop; 0 for an empty range."""
    return F.when(stop < start, F.lit(0.0)).otherwise(F.aggregate(F.sequence(start.cast("int"), stop.cast("int")), F.lit(0.0), lambda a, j: a + term(j)))


def f_sf_2(rss_reduced: Column, rss_full: Column, df2: Column) -> Column:
    """P(F(2, df2) > f) of a nested pair of fits: the ratio of residual sums to the power df2/2.

    Null where df2 <= 0 or a sum is negative; 0 for a perfect fit of the full model; 1 where the reduced model is as good.
    """
    ratio = rss_full / rss_reduced
    p = F.when(rss_full <= 0, F.lit(0.0)).when(rss_full >= rss_reduced, F.lit(1.0)).otherwise(F.pow(ratio, df2 / 2.0))
    return F.when((df2 > 0) & (rss_full >= 0) & (rss_reduced >= 0), p)


def f_stat(rss_reduced: Column, rss_full: Column, df1: ColumnLike, df2: Column) -> Column:
    return F.greatest(F.lit(0.0), ((rss_reduced - rss_full) / col(df1)) / (rss_full / df2))


def f_sf_even(f: Column, df1: Column, df2: Column) -> Column:
    """P(F(df1, df2) > f) for an even df1, as a finite sum."""
    x = df2 / (df2 + df1 * f)
    half = df2 / 2.0
    term = lambda j: F.exp(F.expr("0D") + _lgamma(half + j) - _lgamma(half) - _lgamma(j + F.lit(1.0))) * F.pow(1 - x, j)
    return F.when(f <= 0, F.lit(1.0)).otherwise(F.pow(x, half) * sum_over(F.lit(0), df1 / 2 - 1, term))


def _lgamma(x: Column) -> Column:
    """Log of the gamma function, by Stirling's series beyond a shift by seven: relative error under 1e-13."""
    shift = F.lit(0.0)
    for i in range(7):
        shift = shift + F.log(x + float(i))
    z = x + 7.0
    inv = 1 / (z * z)
    series = (1 / z) * (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv * (1 / 1188)))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def t_sf_two_sided(t: Column, df: Column) -> Column:
    """P(|T(df)| > |t|) for whole df: the finite trigonometric sums for odd and even degrees."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    # products of ratios grow along the sums, so they are carried with them
    state = lambda a, p: F.struct(a.alias("sum"), p.alias("term"))
    even_n, odd_n = (df / 2).cast("int"), ((df - 1) / 2).cast("int")
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(even_n, F.lit(1))), state(F.lit(0.0), F.lit(1.0)), lambda a, j: state(a["sum"] + F.when(j <= even_n, a["term"]).otherwise(0.0), a["term"] * c * c * (2.0 * j - 1.0) / (2.0 * j)), lambda a: a["sum"])
    odd = F.aggregate(F.sequence(F.lit(1), F.greatest(odd_n, F.lit(1))), state(F.lit(0.0), c), lambda a, j: state(a["sum"] + F.when(j <= odd_n, a["term"]).otherwise(0.0), a["term"] * c * c * (2.0 * j) / (2.0 * j + 1.0)), lambda a: a["sum"])
    inside = F.when(df % 2 == 0, s * even).otherwise((theta + s * odd) * (2 / math.pi))
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1 - inside))


def f_sf_1(f: Column, df2: Column) -> Column:
    """P(F(1, df2) > f) for whole df2."""
    return t_sf_two_sided(F.sqrt(F.greatest(f, F.lit(0.0))), df2)


def chi2_sf_4(x: Column) -> Column:
    return F.exp(-x / 2) * (1 + x / 2)


def chi2_sf_2(x: Column) -> Column:
    return F.exp(-x / 2)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: its series below 2.5 and its continued fraction above, to 1e-12."""
    n = 60
    series = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.struct(x.alias("sum"), x.alias("term")), lambda a, j: F.struct((a["sum"] - a["term"] * x * x * (2.0 * j - 1) / (j * (2.0 * j + 1))).alias("sum"), (-a["term"] * x * x * (2.0 * j - 1) / (j * (2.0 * j + 1))).alias("term")), lambda a: a["sum"])
    # erf's term j is (-1)^j x^(2j+1) / (j! (2j+1)): each follows from the last
    small = 1 - 2 / math.sqrt(math.pi) * series
    fraction = F.aggregate(F.sequence(F.lit(n), F.lit(1)), F.lit(0.0), lambda a, k: (k / 2.0) / (x + a))
    large = F.exp(-x * x) / math.sqrt(math.pi) / (x + fraction)
    return F.when(x < 2.5, small).otherwise(large)


def chi2_sf_1(x: Column) -> Column:
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def normal_sf_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def log_factorial(n: Column) -> Column:
    return _lgamma(n.cast("double") + 1.0)


def hypergeometric_sf(k: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) for the marked among the drawn: the one-sided exact test of a 2 x 2 table."""
    pmf = lambda j: F.exp(log_factorial(marked) - log_factorial(j) - log_factorial(marked - j) + log_factorial(total - marked) - log_factorial(drawn - j) - log_factorial(total - marked - drawn + j) - log_factorial(total) + log_factorial(drawn) + log_factorial(total - drawn))
    return F.least(F.lit(1.0), sum_over(F.greatest(k, F.lit(0), drawn + marked - total), F.least(marked, drawn), pmf))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Exact two-sided test of a 2 x 2 table: all tables as unlikely as the given one, or more."""
    total, marked, drawn = a + b + c + d, a + c, a + b
    pmf = lambda j: F.exp(log_factorial(marked) - log_factorial(j) - log_factorial(marked - j) + log_factorial(total - marked) - log_factorial(drawn - j) - log_factorial(total - marked - drawn + j) - log_factorial(total) + log_factorial(drawn) + log_factorial(total - drawn))
    seen = pmf(a) * (1 + 1e-7)
    return F.least(F.lit(1.0), sum_over(F.greatest(F.lit(0), drawn + marked - total), F.least(marked, drawn), lambda j: F.when(pmf(j) <= seen, pmf(j)).otherwise(0.0)))


def cauchy_combine(ps: Column, adaptive: bool = True) -> Column:
    """Cauchy combination of an array of p-values: null and NaN count as 1, values are held within [1e-15, 0.5 or 1 - 1e-15].

    With adaptive, values of 0.5 and more get no weight; where none has any, the result is 0.5.
    """
    p = F.transform(ps, lambda x: clip(F.when(x.isNull() | F.isnan(x), F.lit(1.0)).otherwise(x), 1e-15, 1 - 1e-15))
    if adaptive:
        p = F.filter(p, lambda x: x < 0.5)
    n = F.size(p)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + F.tan((0.5 - x) * math.pi))
    return F.when(n == 0, F.lit(0.5)).otherwise(0.5 - F.atan(total / n) / math.pi)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def phase_of(a: Column, b: Column) -> Column:
    """Acrophase of a*cos + b*sin."""
    return F.atan2(b, a)


def wrap(x: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(x, F.lit(2 * math.pi))


def angle_between(a: Column, b: Column) -> Column:
    """Signed difference of angles in (-pi, pi]."""
    d = F.pmod(a - b, F.lit(2 * math.pi))
    return F.when(d > math.pi, d - 2 * math.pi).otherwise(d)


def log2_fold_change(a: Column, b: Column, pseudo: float = 1e-6) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def dot(values: Column, weights: list[float]) -> Column:
    """Inner product of an array column and fixed weights."""
    return F.aggregate(F.zip_with(values, F.lit([float(w) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def first_argmax(values: Column) -> Column:
    """0-based position of the first maximum of an array."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)
