"""What the plan modules share: reading tables, derived carriers, micros of time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Unix microseconds of a time stamp without zone (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lon) made from order keys by integer arithmetic."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("id"), (F.pmod(k * 7919, F.lit(17000)) / 100.0 - 85).alias("lat"), (F.pmod(k * 104729, F.lit(36000)) / 100.0 - 180).alias("lon"))


POINTS_SQL = "(SELECT o_orderkey AS id, (o_orderkey * 7919 % 17000) / 100.0 - 85 AS lat, (o_orderkey * 104729 % 36000) / 100.0 - 180 AS lon FROM orders)"


def r6(c: Column, name: str, digits: int = 6) -> Column:
    return F.round(c, digits).alias(name)
