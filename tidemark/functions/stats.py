"""One-pass statistics as aggregate expressions, and scalar distributions (A-02..A-14, A-22, A-23)."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def summary(v: Column) -> dict[str, Column]:
    """A-10: count, mean, extremes and unbiased standard deviation; null where a sample of one has none."""
    return {"n": F.count(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "stddev": F.stddev_samp(v)}


def sum_of_squares(v: Column) -> Column:
    """A-05: sum of squared deviations from the mean."""
    return F.var_pop(v) * F.count(v)


def running(by: list[str], order: list[str]) -> WindowSpec:
    """A-12: the frame of all samples up to the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def regression(x: Column, y: Column) -> dict[str, Column]:
    """A-13: least-squares line; the slope is null for fewer than two samples or equal x."""
    slope = F.when((F.count(x) > 1) & (F.var_pop(x) > 0), F.regr_slope(y, x))
    return {"slope": slope, "mean_x": F.avg(x), "mean_y": F.avg(y)}


def gaussian_pdf(x: Column, mean: float = 0.0, sigma: float = 1.0) -> Column:
    """A-23."""
    a = (x - mean) / sigma
    return F.exp(-0.5 * a * a) / (sigma * math.sqrt(2 * math.pi))


def decay_by_half_life(t: Column, half_life: float) -> Column:
    """A-22: what is left after t of a quantity with the given half-life."""
    return F.pow(F.lit(2.0), -t / half_life)


def decay_by_lifetime(t: Column, lifetime: float) -> Column:
    return F.exp(-t / lifetime)
