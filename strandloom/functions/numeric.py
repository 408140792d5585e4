"""Phred scores, log-space sums and discrete distributions as column expressions.

Special functions that Spark lacks (log-gamma and the incomplete beta function) are built from JVM-side
array expressions.  Where a query needs the incomplete beta function for every row (the bias measures), the
Arrow functions :func:`beta_cdfs` and :func:`largest_beta_difference` work out the distinct cells of a batch at once.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LN10_DIV_10 = math.log(10) / 10
#: Lanczos coefficients (g = 7).
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

#: Numerators and denominators of Cody's approximations to erf(x) / x, erfc(x) exp(x x) and the tail, highest power first.
_CODY = (((1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
          (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)),
         ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
           1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
          (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
           3.43936767414372164e3, 1.23033935480374942e3)),
         ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
          (1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)))


def phred_to_probability(q: Column) -> Column:
    """Probability of error."""
    return F.exp(-q * LN10_DIV_10)


def probability_to_phred(p_error: Column) -> Column:
    """-10 log10 of an error probability, at least 0; a non-positive probability counts as the least positive double."""
    p = F.least(F.greatest(p_error, F.lit(2.2250738585072014e-308)), F.lit(1.0))
    return F.greatest(-F.log(p) / LN10_DIV_10, F.lit(0.0))


def probability_true_to_phred(p_true: Column) -> Column:
    return probability_to_phred(1 - p_true)


def phred_to_probability_true(q: Column) -> Column:
    return -F.expm1(-q * LN10_DIV_10)


def log_sum_exp(xs: Column) -> Column:
    """Of an array of logarithms; -infinity for none."""
    m = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - m))
    return F.when(F.size(xs) == 0, F.lit(float("-inf"))).when(m == float("-inf"), m).otherwise(m + F.log(total))


def log_sum_exp_agg(x: Column) -> Column:
    """Group aggregate.  Two algebraic aggregates, so it combines before the shuffle: the values of a group
    must lie within the range of doubles after exp; use :func:`log_sum_exp` over windows otherwise."""
    return F.log(F.sum(F.exp(x)))


def normalise_logs(xs: Column) -> Column:
    z = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - z))


def round_significant(x: Column, digits: int) -> Column:
    e = F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), digits - 1 - e)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def almost_equal(a: Column, b: Column, eps: float = 2.2e-16) -> Column:
    return F.abs(a - b) <= eps * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0 (Lanczos)."""
    y = x - 1
    a = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        a = a + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.log(t) - t + F.log(a)


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1.0)


def log_binomial(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_dirichlet(alphas: Column, xs: Column) -> Column:
    """Log-density of a Dirichlet distribution."""
    z = log_gamma(F.aggregate(alphas, F.lit(0.0), lambda s, a: s + a))
    return z + F.aggregate(F.zip_with(alphas, xs, lambda a, x: (a - 1) * F.log(x) - log_gamma(a)), F.lit(0.0), lambda s, v: s + v)


def log_multinomial(ks: Column) -> Column:
    """Logarithm of the multinomial coefficient of an array of counts."""
    n = F.aggregate(ks, F.lit(0.0), lambda s, k: s + k)
    return log_factorial(n) - F.aggregate(ks, F.lit(0.0), lambda s, k: s + log_factorial(k))


def poisson_pmf(k: Column, mean: Column) -> Column:
    return F.exp(k * F.log(mean) - mean - log_factorial(k))


def poisson_cdf(k: Column, mean: Column) -> Column:
    # each term from the one before it
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), mean.cast("double").alias("mean"))
    plain = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), start, lambda s, i: F.struct(
        (s["term"] * s["mean"] / i).alias("term"), (s["sum"] + s["term"] * s["mean"] / i).alias("sum"), s["mean"].alias("mean")))["sum"]
    return F.when(mean < 700, plain).otherwise(F.aggregate(F.sequence(F.lit(0), k.cast("int")), F.lit(0.0), lambda s, i: s + poisson_pmf(i.cast("double"), mean)))


def poisson_sf(k: Column, mean: Column) -> Column:
    return 1 - poisson_cdf(k, mean)


def normal_cdf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    """Distribution function of a normal variable, by rational approximations of the error function that are exact to double
    precision (W. J. Cody, 1969); beyond 9 deviations it stays at its value there."""
    z = F.least(F.greatest((x - mean) / sd, F.lit(-9.0)), F.lit(9.0))
    y = F.abs(z) / math.sqrt(2)

    def ratio(t: Column, over: tuple[float, ...], under: tuple[float, ...]) -> Column:
        a, b = F.lit(over[0]), F.lit(under[0])
        for p, q in zip(over[1:], under[1:]):
            a, b = a * t + p, b * t + q
        return a / b

    square = 1 / (y * y)
    far = F.exp(-y * y) / y * (1 / math.sqrt(math.pi) - square * ratio(square, *_CODY[2]))
    upper = F.when(y <= 0.46875, 0.5 - 0.5 * y * ratio(y * y, *_CODY[0])).when(y <= 4, 0.5 * F.exp(-y * y) * ratio(y, *_CODY[1])).otherwise(0.5 * far)
    return F.when(z > 0, 1 - upper).otherwise(upper)


def normal_sf(x: Column, mean: Column | float = 0.0, sd: Column | float = 1.0) -> Column:
    return 1 - normal_cdf(x, mean, sd)


def digamma(x: Column) -> Column:
    """Derivative of log-gamma for x > 0: six steps up, then the asymptotic series."""
    y = x + 6
    up = F.lit(0.0)
    for k in range(6):
        up = up + 1 / (x + k)
    f = 1 / (y * y)
    return F.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - up


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, a: s + a)


def dirichlet_expectation(alphas: Column) -> Column:
    return F.transform(alphas, lambda a: a / _total(alphas))


def dirichlet_entropy(alphas: Column) -> Column:
    """Differential entropy in nats."""
    a0, k = _total(alphas), F.size(alphas)
    ln_b = F.aggregate(alphas, F.lit(0.0), lambda s, a: s + log_gamma(a)) - log_gamma(a0)
    return ln_b + (a0 - k) * digamma(a0) - F.aggregate(alphas, F.lit(0.0), lambda s, a: s + (a - 1) * digamma(a))


def beta_binomial_ln(k: Column, n: Column, a: Column, b: Column) -> Column:
    return log_binomial(n, k) + log_beta(k + a, n - k + b) - log_beta(a, b)


def multinomial_ln(ks: Column, ps: Column) -> Column:
    return log_multinomial(ks) + _total(F.zip_with(ks, ps, lambda k, p: F.when(k > 0, k * F.log(p)).otherwise(0.0)))


def dirichlet_multinomial_ln(ks: Column, alphas: Column) -> Column:
    n, a0 = _total(ks), _total(alphas)
    head = log_factorial(n) + log_gamma(a0) - log_gamma(n + a0)
    return head + _total(F.zip_with(ks, alphas, lambda k, a: log_gamma(k + a) - log_gamma(a) - log_factorial(k)))


def beta_hdi(a: np.ndarray, b: np.ndarray, mass: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Shortest interval of a beta distribution with ``mass``, of arrays: the lower tail is found by golden section."""
    a, b = np.asarray(a, float), np.asarray(b, float)

    def quantile(p: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(p), np.ones_like(p)
        for _ in range(60):
            mid = (lo + hi) / 2
            less = incomplete_beta(a, b, mid) < p
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return (lo + hi) / 2

    width = lambda t: quantile(t + mass) - quantile(t)
    lo, hi, g = np.zeros_like(a), np.full_like(a, 1 - mass), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        x, y = hi - g * (hi - lo), lo + g * (hi - lo)
        left = width(x) <= width(y)
        lo, hi = np.where(left, lo, x), np.where(left, y, hi)
    t = (lo + hi) / 2
    return quantile(t), quantile(t + mass)


def entropy2(ps: Column) -> Column:
    """Shannon entropy in bits; zero shares add nothing."""
    return -F.aggregate(ps, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def beta_cdf(a: Column, b: Column, x, steps: int = 60) -> Column:
    """Regularised incomplete beta function by its continued fraction (modified Lentz), folded over a sequence."""
    x = F.lit(float(x)) if isinstance(x, (int, float)) else x
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    start = F.struct(p.cast("double").alias("p"), q.cast("double").alias("q"), y.cast("double").alias("y"), F.lit(1.0).alias("c"),
                     (1 / safe(1 - (p + q) * y / (p + 1))).cast("double").alias("d"), (1 / safe(1 - (p + q) * y / (p + 1))).cast("double").alias("h"))

    def half(s: Column, num: Column) -> Column:
        d = 1 / safe(1 + num * s["d"])
        c = safe(1 + num / s["c"])
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), s["y"].alias("y"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, j: Column) -> Column:
        m = F.ceil(j / 2).cast("double")
        p_, q_, y_ = s["p"], s["q"], s["y"]
        even = m * (q_ - m) * y_ / ((p_ + 2 * m - 1) * (p_ + 2 * m))
        odd = -(p_ + m) * (p_ + q_ + m) * y_ / ((p_ + 2 * m) * (p_ + 2 * m + 1))
        return half(s, F.when(j % 2 == 1, even).otherwise(odd))

    h = F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), start, step)["h"]
    front = F.exp(p * F.log(y) + q * F.log1p(-y) - log_beta(p, q)) / p
    out = F.when(flip, 1 - front * h).otherwise(front * h)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(out)


def _lbeta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    return (gamma(a) + gamma(b) - gamma(a + b)).astype(float)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 400) -> np.ndarray:
    """Regularised incomplete beta function of arrays, by the continued fraction of its smaller tail."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0.0, 1.0)
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(y)
    d = 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / safe(1 + num * d)
            c = safe(1 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - _lbeta(p, q)) / p
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def beta_cdfs(cells: Column) -> Column:
    """For each ``[a, b, low, high]`` of an array: the mass of Beta(a, b) below ``low`` and above ``high``.

    One Arrow batch at a time; each distinct cell of a batch is worked out once.  Counts of reads are small
    integers, so that a batch has few of them.
    """
    return _beta_cdfs()(cells)


@cache
def _beta_cdfs():
    @F.pandas_udf("array<double>")
    def run(cells: pd.Series) -> pd.Series:
        sizes = [0 if c is None else len(c) for c in cells]
        rows = [r for c in cells if c is not None for r in c]
        if not rows:
            return pd.Series([None if c is None else np.empty(0) for c in cells])
        uniq, place = np.unique(np.array([np.asarray(r, float) for r in rows]), axis=0, return_inverse=True)
        a, b, low, high = uniq.T
        mass = (incomplete_beta(a, b, low) + 1 - incomplete_beta(a, b, high))[place.reshape(-1)]
        ends = np.cumsum(sizes)
        return pd.Series([None if c is None else mass[e - n:e] for c, n, e in zip(cells, sizes, ends)])
    return run


#: Cells of the grid on which two beta variables are compared, and the difference that counts.
GRID, LEAST_DIFFERENCE = 200, 0.25


def beta_difference(cells: np.ndarray, grid: int = GRID, least: float = LEAST_DIFFERENCE) -> np.ndarray:
    """P(|X - Y| > least) for rows ``a, b, c, d`` with X ~ Beta(a, b), Y ~ Beta(c, d), both on the midpoints of a grid."""
    x = (np.arange(grid) + 0.5) / grid

    def weights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ln = (a[:, None] - 1) * np.log(x) + (b[:, None] - 1) * np.log1p(-x)
        w = np.exp(ln - ln.max(axis=1, keepdims=True))
        return w / w.sum(axis=1, keepdims=True)

    reach = int(round(least * grid))  # midpoints this far apart differ by exactly ``least``, which does not count
    out = np.empty(len(cells))
    for i in range(0, len(cells), 4096):
        a, b, c, d = cells[i:i + 4096].T
        w, cum = weights(a, b), np.cumsum(weights(c, d), axis=1)
        below = np.zeros_like(cum)
        below[:, reach + 1:] = cum[:, :grid - reach - 1]
        upto = np.ones_like(cum)
        upto[:, :grid - reach] = cum[:, reach:]
        out[i:i + 4096] = (w * (below + 1 - upto)).sum(axis=1)
    return out


def largest_beta_difference(pairs: Column) -> Column:
    """Of an array of ``[a, b]``: the largest :func:`beta_difference` of two of them; 0 for fewer than two."""
    return _largest_beta_difference()(pairs)


@cache
def _largest_beta_difference():
    @F.pandas_udf("double")
    def run(pairs: pd.Series) -> pd.Series:
        cells, owner = [], []
        for i, ps in enumerate(pairs):
            ps = [] if ps is None else sorted(tuple(p) for p in ps)
            for j, p in enumerate(ps):
                cells += [(*p, *q) for q in ps[:j]]
                owner += [i] * j
        out = np.zeros(len(pairs))
        if cells:
            uniq, place = np.unique(np.array(cells, float), axis=0, return_inverse=True)
            np.maximum.at(out, owner, beta_difference(uniq)[place.reshape(-1)])
        return pd.Series(out)
    return run


def beta_sf(a: Column, b: Column, x) -> Column:
    return 1 - beta_cdf(a, b, x)


def beta_tail_probability(a: Column, b: Column, x) -> Column:
    """Mass of a beta distribution in both tails: below ``x`` and above ``1 - x``."""
    x = F.lit(float(x)) if isinstance(x, (int, float)) else x
    return beta_cdf(a, b, x) + beta_sf(a, b, 1 - x)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided Fisher test of a 2x2 table: the mass of all tables no likelier than this one."""
    r1, r2, c1 = a + b, c + d, a + c
    log_p = lambda x: (log_binomial(r1.cast("double"), x.cast("double")) + log_binomial(r2.cast("double"), (c1 - x).cast("double"))
                       - log_binomial((r1 + r2).cast("double"), c1.cast("double")))
    lo, hi = F.greatest(F.lit(0), c1 - r2).cast("int"), F.least(r1, c1).cast("int")
    cut = log_p(a) + 1e-7
    return F.least(F.lit(1.0), F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda s, x: s + F.when(log_p(x) <= cut, F.exp(log_p(x))).otherwise(0.0)))


def rms(x: Column) -> Column:
    """Group aggregate: root mean square."""
    return F.sqrt(F.avg(x.cast("double") * x.cast("double")))
