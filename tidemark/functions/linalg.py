"""Matrices as arrays of rows (M-10..M-12)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))


def matrix(rows: list[list]) -> Column:
    return F.array(*[F.array(*[F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in r]) for r in rows])


def identity(n: int) -> Column:
    return matrix([[float(i == j) for j in range(n)] for i in range(n)])


def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(m[0]) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))


def mat_mul(a: Column, b: Column) -> Column:
    """M-10: the product; columns of b are taken once a row."""
    dot = lambda r, c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    columns = transpose(b)
    return F.transform(a, lambda r: F.transform(columns, lambda c: dot(r, c)))


def submatrix(m: Column, row: int, column: int) -> Column:
    """M-10: without one row and one column."""
    return F.transform(F.filter(m, lambda r, i: i != row), lambda r: F.filter(r, lambda x, j: j != column))


def augment(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.concat(x, y))


def swap_rows(m: Column, i: int, j: int) -> Column:
    return F.transform(m, lambda r, k: F.when(k == i, m[j]).when(k == j, m[i]).otherwise(r))


def _factors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row operations on [U | L] with the order of the rows kept aside; the first largest pivot is taken."""
    n = len(a)
    u, low, order = a.astype(float).copy(), np.zeros((n, n)), np.arange(n)
    for k in range(n):
        top = k + int(np.argmax(np.abs(u[k:, k])))
        for held in (u, low, order):
            held[[k, top]] = held[[top, k]]
        if u[k, k]:
            low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low + np.eye(n), np.triu(u), np.eye(n)[order]


@F.pandas_udf(T.StructType([T.StructField(f, MATRIX) for f in ("lower", "upper", "permuted")]))
def lup(m: pd.Series) -> pd.DataFrame:
    """M-11: P A = L U."""
    parts = [(None, None, None) if x is None else tuple(p.tolist() for p in _factors(np.array([list(r) for r in x]))) for x in m]
    return pd.DataFrame(parts, columns=["lower", "upper", "permuted"])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve(m: pd.Series, b: pd.Series) -> pd.Series:
    """M-11: x of A x = b; null if A is singular. Batches of one size are solved together."""
    out: list = [None] * len(m)
    sizes: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(m, b, strict=True)):
        if x is not None and y is not None and len(x) == len(y):
            sizes.setdefault(len(x), []).append(i)
    for rows in sizes.values():
        a = np.array([[list(r) for r in m[i]] for i in rows], float)
        for i, one in zip(rows, a, strict=True):
            try:
                out[i] = np.linalg.solve(one, np.array(b[i], float)).tolist()
            except np.linalg.LinAlgError:
                out[i] = None
    return pd.Series(out)


def rotate_3d(x: Column, y: Column, z: Column, ax: Column, ay: Column, az: Column) -> tuple[Column, Column, Column]:
    """M-12: a point turned about x, then y, then z; angles in radians."""
    y, z = y * F.cos(ax) - z * F.sin(ax), y * F.sin(ax) + z * F.cos(ax)
    x, z = x * F.cos(ay) + z * F.sin(ay), z * F.cos(ay) - x * F.sin(ay)
    x, y = x * F.cos(az) - y * F.sin(az), x * F.sin(az) + y * F.cos(az)
    return x, y, z
