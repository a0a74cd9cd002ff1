"""Structured Streaming twins (W-*): the same bins and step functions as in batch, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import summary


def binned(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, late: str, centred: bool = False, width_us: int = 0) -> DataFrame:
    """W-01, W-02, W-05: tumbling bins with a summary; samples later than the watermark are dropped. Centred bins are shifted by half a width (their
    anchor is the epoch: a stream has no first sample to wait for)."""
    shift = f"{width_us // 2} microseconds" if centred else None
    w = F.window(ts, width, width, shift) if shift else F.window(ts, width)
    d = stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(*[c.alias(n) for n, c in summary(F.col(value)).items()])
    return d.select(*keys, F.col("w.start").alias("start"), *summary(F.col(value)))


def sliding(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    """W-03."""
    d = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, slide).alias("w")).agg(*[c.alias(n) for n, c in summary(F.col(value)).items()])
    return d.select(*keys, F.col("w.start").alias("start"), *summary(F.col(value)))


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """W-04 (plumbing)."""
    d = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return d.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def folded(stream: DataFrame, key: str, us: str, value: str, step: Callable, schema: str, state_schema: str) -> DataFrame:
    """W-07, W-08: a step function of tidemark.operators.stateful over a keyed stream. Samples are sorted within a trigger; what is
    older than the state is up to the step (they ignore it). The state is a row of numbers."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, out = (state.get if state.exists else None), []
        for t, v in sorted((t, v) for p in batches for t, v in zip(p[us].tolist(), p[value].tolist(), strict=True)):
            held, o = step(tuple(held) if held is not None else None, t, v)
            if o is not None:
                out.append((k[0], *o))
        if held is not None:
            state.update(tuple(held))
        yield pd.DataFrame(out, columns=[key, *names])

    kind = dict(stream.dtypes)[key]
    return stream.select(key, us, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", state_schema, "append", "NoTimeout")
