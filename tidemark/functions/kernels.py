"""Kernels for windows over samples (S-10..S-14, S-22, S-24).

Savitzky-Golay weights come from the rule that defines them, exact least squares over the centred window, so there is no
table of them. A kernel over rows is a sum of products of one window's values: plain arithmetic to the optimizer.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def savitzky_golay(size: int, degree: int, derivative: int = 0) -> list[float]:
    """Weights of the polynomial fit's value (or first derivative, in units a sample) at the window's centre."""
    m = (size - 1) // 2
    at = range(-m, m + 1)
    n = min(degree, size - 1) + 1
    rows = [[Fraction(sum(i ** (p + q) for i in at)) for q in range(n)] + [Fraction(p == derivative)] for p in range(n)]
    for i in range(n):  # Gauss-Jordan on the normal equations
        k = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[k] = rows[k], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [float(sum(rows[p][n] * i**p for p in range(n))) for i in at]


def centred(v: Column, weights: list[float], order: WindowSpec) -> Column:
    """The kernel around each row; null where the window reaches beyond the samples."""
    m = len(weights) // 2
    terms = [F.lit(w) * (F.lag(v, m - i).over(order) if i < m else F.lead(v, i - m).over(order) if i > m else v) for i, w in enumerate(weights) if w]
    edges = F.lag(v, m).over(order).isNotNull() & F.lead(v, m).over(order).isNotNull()
    return F.when(edges, sum(terms[1:], terms[0]))


def causal(v: Column, taps: list[float], order: WindowSpec) -> Column:
    """S-24: finite impulse response; taps[0] meets the newest sample. Null until all taps have one."""
    terms = [F.lit(t) * (F.lag(v, i).over(order) if i else v) for i, t in enumerate(taps)]
    return sum(terms[1:], terms[0])


def convolve(a: Column, kernel: list[float]) -> Column:
    """S-22: full discrete convolution of an array, of length n + k - 1."""
    k = F.array(*[F.lit(float(x)) for x in kernel])
    out = F.sequence(F.lit(0), F.size(a) + len(kernel) - 2)

    def one(i: Column) -> Column:
        js = F.sequence(F.greatest(F.lit(0), i - (len(kernel) - 1)), F.least(i, F.size(a) - 1))
        return F.aggregate(js, F.lit(0.0), lambda s, j: s + F.get(a, j) * F.get(k, i - j))

    return F.when(F.size(a) > 0, F.transform(out, one)).otherwise(F.array().cast("array<double>"))
