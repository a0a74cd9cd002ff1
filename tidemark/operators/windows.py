"""Time-series operators as DataFrame transformations (S-01..S-03, S-20, S-21, S-29, A-18, L-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import summary


def last_per_time(df: DataFrame, keys: list[str], us: str, tiebreak: str) -> DataFrame:
    """Q6: of samples at one time the last by tiebreak stays."""
    w = Window.partitionBy(*keys, us).orderBy(F.col(tiebreak).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trailing(keys: list[str], us: str, span_us: int):
    """S-01: all samples of the last span, both ends included (Q5)."""
    return Window.partitionBy(*keys).orderBy(us).rangeBetween(-span_us, 0)


def centred_bins(df: DataFrame, keys: list[str], us: str, width_us: int, value: str) -> DataFrame:
    """S-20: bins centred on multiples of the width from each key's first sample (Q3, Q4), with a summary. The anchor is
    a small aggregate that joins back, so a hot key isn't sorted in one task."""
    anchor = df.groupBy(*keys).agg(F.min(us).alias("_anchor"))
    d = df.join(anchor, keys).withColumn("bin", F.round((F.col(us) - F.col("_anchor")) / width_us).cast("long"))
    d = d.groupBy(*keys, "bin").agg(F.first("_anchor").alias("_anchor"), *[c.alias(n) for n, c in summary(F.col(value)).items()])
    return d.withColumn("bin_center_us", F.col("_anchor") + F.col("bin") * width_us).drop("_anchor")


def clock_bins(df: DataFrame, keys: list[str], us: str, width_us: int, value: str) -> DataFrame:
    """S-21: tumbling bins on the clock, with a summary."""
    start = (F.floor(F.col(us) / width_us) * width_us).cast("long").alias("start_us")
    return df.groupBy(*keys, start).agg(*[c.alias(n) for n, c in summary(F.col(value)).items()])


def sliding(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """S-02: every tuple of n consecutive samples."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("tuple", F.collect_list(value).over(w)).where(F.size("tuple") == n)


def contains_run(a: Column, needle: Column) -> Column:
    """S-03: whether needle stands within a as consecutive elements."""
    starts = F.when(F.size(a) >= F.size(needle), F.sequence(F.lit(1), F.size(a) - F.size(needle) + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.slice(a, i, F.size(needle)) == needle)


def holds_run(df: DataFrame, keys: list[str], order: list[str], value: str, needle: list) -> DataFrame:
    """S-03 over rows: whether each key's values, in order, hold needle in a row; a null value equals nothing, the empty needle is
    in everything. Values ahead come from a window, so no history is collected."""
    w = Window.partitionBy(*keys).orderBy(*order)
    here = F.lit(True)
    for i, x in enumerate(needle):
        here = here & F.coalesce((F.lead(value, i).over(w) if i else F.col(value)) == F.lit(x), F.lit(False))
    return df.select(*keys, here.alias("found")).groupBy(*keys).agg(F.bool_or("found").alias("found"))


def pyramid(df: DataFrame, us: str, value: str, levels: list[int]) -> DataFrame:
    """S-29: minimum, maximum and mean at several resolutions of 2^level microseconds. The finest level is aggregated
    first and the coarser from it, so the samples are shuffled once."""
    fine = min(levels)
    d = df.groupBy(F.shiftright(us, fine).alias("cell")).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = d.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    d = d.groupBy("level", F.expr(f"shiftright(cell, level - {fine})").alias("cell"))
    return d.agg(F.sum("n").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("s") / F.sum("n")).alias("mean"))


def longest_run(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A-18: the longest run of equal values of each key, the first of equal length (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_pos", F.row_number().over(w)).withColumn("_island", F.col("_pos") - F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)))
    d = d.groupBy(*keys, value, "_island").agg(F.count("*").alias("length"), F.min("_pos").alias("start"))
    return d.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value"), "start", "length"), F.struct("length", -F.col("start"))).alias("x")).select(*keys, "x.*")


def chunks(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """L-04: number of the chunk of n consecutive rows that a row is in."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("chunk", F.floor((rn - 1) / n).cast("long"))
