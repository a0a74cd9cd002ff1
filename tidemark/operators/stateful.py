"""Operators whose next step depends on the last (S-23, S-25..S-28): one pure step function each, wrapped for batch here and
for streams in tidemark.streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alpha_beta_step(state, us: int, v: float, alpha: float, beta: float):
    """S-26: (new state, output or None); a state is (us, value, velocity). Samples that don't move time forward are left
    out (W-07)."""
    if state is None:
        return (us, v, 0.0), None
    t, x, dx = state
    dt = (us - t) / 1e6
    if dt <= 0:
        return state, None
    predicted = x + dx * dt
    residual = v - predicted
    new = (us, predicted + alpha * residual, dx + beta * (residual / dt))
    return new, (us, predicted, new[1], new[2], residual)


AB = "us long, predicted double, estimated double, velocity double, residual double"


def alpha_beta_gamma_step(state, us: int, v: float, alpha: float, beta: float, gamma: float):
    """S-27: (new state, output or None); a state is (us, value, velocity, acceleration)."""
    if state is None:
        return (us, v, 0.0, 0.0), None
    t, x, dx, ddx = state
    dt = (us - t) / 1e6
    if dt <= 0:
        return state, None
    half = dt * dt / 2
    predicted, predicted_velocity = x + dx * dt + ddx * half, dx + ddx * dt
    residual = v - predicted
    new = (us, predicted + alpha * residual, dx + beta * (residual / dt), ddx + gamma * (residual / half))
    return new, (us, predicted, predicted_velocity, *new[1:], residual)


ABG = "us long, predicted double, predicted_velocity double, estimated double, velocity double, acceleration double, residual double"


def _fold(step: Callable, names: list[str], key: str, us: str, value: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, object()
        for p in batches:
            out = []
            for k, t, v in zip(p[key].tolist(), p[us].tolist(), p[value].tolist(), strict=True):
                if k != at:
                    state, at = None, k
                state, o = step(state, t, v)
                if o is not None:
                    out.append((k, *o))
            yield pd.DataFrame(out, columns=[key, *names])

    return run


def folded(df: DataFrame, key: str, us: str, value: str, step: Callable, schema: str) -> DataFrame:
    """Runs a step function over each key's samples in order of time. Partitions are sorted and streamed: a task holds a
    batch and one state, however many samples a key has."""
    names = [x.split()[0] for x in schema.split(", ")]
    d = df.select(key, us, F.col(value).cast("double").alias(value)).repartition(key).sortWithinPartitions(key, us, value)
    return d.mapInPandas(_fold(step, names, key, us, value), f"{key} {dict(df.dtypes)[key]}, {schema}")


def slope_step(state, us: int, v: float, window_us: int):
    """S-25: gathers samples until they span 0.95 of the window, then gives the slope a second at the window's centre."""
    held = [(t, x) for t, x in (state or []) if t != us and t >= us - window_us] + [(us, v)]
    if us - held[0][0] < 0.95 * window_us:
        return held, None
    n = len(held)
    mx, my = sum(t for t, _ in held) / n, sum(x for _, x in held) / n
    sxx = sum((t - mx) ** 2 for t, _ in held)
    if n < 2 or sxx <= 0:
        return held, None
    return [], (us - window_us // 2, 1e6 * sum((t - mx) * (x - my) for t, x in held) / sxx, n)


def kernel_step(state, us: int, v: float, window_us: int, minimum: int, kernel: Callable[[int], list[float]], stamp: str = "center"):
    """S-23: gathers samples of up to two windows; with an odd number of them that spans more than one window, gives their kernel and starts anew (Q7)."""
    held = [(t, x) for t, x in (state or []) if t != us and t >= us - 2 * window_us] + [(us, v)]
    if len(held) < minimum or us - held[0][0] <= window_us or len(held) % 2 == 0:
        return held, None
    weights = kernel(len(held))
    out = sum(w * x for w, (_, x) in zip(weights, held, strict=True)) / sum(weights)
    at = {"lower": us - window_us, "center": us - window_us // 2, "upper": us}[stamp]
    return [], (at, out, len(held))


def lttb(points: list[tuple[float, float]], n: int) -> list[tuple[float, float]]:
    """S-28, largest triangle three buckets (the published algorithm): n points that keep a curve's shape."""
    if n >= len(points) or n < 3:
        return list(points)
    width = (len(points) - 2) / (n - 2)
    out, a = [points[0]], 0
    for i in range(n - 2):
        lo, hi, end = int(i * width) + 1, int((i + 1) * width) + 1, min(int((i + 2) * width) + 1, len(points))
        ahead = points[hi:end] or [points[-1]]
        cx, cy = sum(p[0] for p in ahead) / len(ahead), sum(p[1] for p in ahead) / len(ahead)
        ax, ay = points[a]
        a = max(range(lo, hi), key=lambda k: (abs((ax - cx) * (points[k][1] - ay) - (ax - points[k][0]) * (cy - ay)), -k))
        out.append(points[a])
    return [*out, points[-1]]


def _largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of sorted (k, b, x, y, cx, cy): the point of each bucket that makes the largest triangle with the one before and the next bucket's mean."""
    at, before, best = None, None, None  # (key, bucket), the chosen point before it, (area, x, y) so far
    for p in batches:
        out = []
        keys, b = p["k"].tolist(), p["b"].to_numpy()
        x, y, cx, cy = (p[c].to_numpy(np.float64) for c in ("x", "y", "cx", "cy"))
        starts = [i for i in range(len(b)) if i == 0 or b[i] != b[i - 1] or keys[i] != keys[i - 1]]
        for lo, hi in zip(starts, [*starts[1:], len(b)], strict=True):
            if at != (keys[lo], b[lo]):
                if best is not None:
                    out.append((at[0], int(best[1]), best[2]))
                before = best[1:] if best is not None and at[0] == keys[lo] else (x[lo], y[lo])
                at, best = (keys[lo], b[lo]), None
            area = np.nan_to_num(np.abs((before[0] - cx[lo:hi]) * (y[lo:hi] - before[1]) - (before[0] - x[lo:hi]) * (cy[lo:hi] - before[1])))
            i = int(np.argmax(area))
            if best is None or area[i] > best[0]:
                best = (area[i], x[lo + i], y[lo + i])
        yield pd.DataFrame(out, columns=["k", "x", "y"])
    if best is not None:
        yield pd.DataFrame([(at[0], int(best[1]), best[2])], columns=["k", "x", "y"])


def downsample(df: DataFrame, key: str, us: str, value: str, n: int) -> DataFrame:
    """LTTB for each key; samples without time or value aren't points. Buckets are numbered from a key's count and ordinals and
    averaged by groups; then sorted partitions are streamed, and a task holds a batch and one candidate however long a key's series is."""
    kind = dict(df.dtypes)[key]
    d = df.select(F.col(key).cast("string").alias("k"), F.col(us).cast("long").alias("x"), F.col(value).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    every = Window.partitionBy("k")
    d = d.select("*", (F.row_number().over(every.orderBy("x", "y")) - 1).alias("i"), F.count("*").over(every).alias("m"))
    width = F.greatest(F.col("m") - 2, F.lit(1)) / F.lit(float(max(n - 2, 1)))
    b = F.ceil(F.col("i") / width).cast("long")
    b = F.when((b - 1) * width >= F.col("i"), b - 1).when(b * width < F.col("i"), b + 1).otherwise(b)  # as rounding may have it
    d = d.withColumn("b", F.when((F.col("m") <= n) | F.lit(n < 3), F.col("i").cast("long")).when(F.col("i") == 0, F.lit(0)).when(F.col("i") == F.col("m") - 1, F.lit(n - 1)).otherwise(b).cast("long"))
    ahead = d.groupBy(F.col("k").alias("ak"), (F.col("b") - 1).alias("ab")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = d.join(ahead, F.col("k").eqNullSafe(F.col("ak")) & (F.col("b") == F.col("ab")), "left")
    d = d.select("k", "b", "i", "x", "y", "cx", "cy").repartition("k").sortWithinPartitions("k", "i")
    return d.mapInPandas(_largest, "k string, x long, y double").select(F.col("k").cast(kind).alias(key), F.col("x").alias(us), F.col("y").alias(value))
