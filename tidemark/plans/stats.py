"""Queries on one-pass statistics (A-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.operators import windows as O
from tidemark.plans.common import POINTS_SQL, micros, points, r6, read


def summary_by_type(spark, sf_dir):
    """A-10, A-11."""
    s = S.summary(F.col("value"))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(s["n"].alias("n"), r6(s["mean"], "mean"), s["min"].alias("min"), s["max"].alias("max"), r6(s["stddev"], "stddev"))


def running_stats(spark, sf_dir):
    """A-01, A-12: every statistic after each sample of a user. The 1e-9 keeps values off the ties of rounding."""
    w, v = S.running(["user_id"], ["ts", "event_id"]), F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id", F.count(v).over(w).alias("n"), r6(F.avg(v).over(w) + 1e-9, "mean"), F.min(v).over(w).alias("min"), F.max(v).over(w).alias("max"),
        r6(F.var_pop(v).over(w) + 1e-9, "var_biased", 3), r6(F.var_samp(v).over(w) + 1e-9, "var_unbiased", 3), r6(F.stddev_samp(v).over(w) + 1e-9, "sd_unbiased", 4), r6(F.stddev_pop(v).over(w) + 1e-9, "sd_biased", 4),
    )


def variance_family(spark, sf_dir):
    """A-02..A-09."""
    v = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.avg(v), "mean"), F.max(v).alias("max"), F.min(v).alias("min"), r6(S.sum_of_squares(v), "sum_sq", 2), r6(F.var_pop(v), "var_biased"),
        r6(F.var_samp(v), "var_unbiased"), r6(F.stddev_samp(v), "sd_unbiased"), r6(F.stddev_pop(v), "sd_biased"),
    )


def linear_regression(spark, sf_dir):
    """A-13: slope of value over time in days, by user."""
    x = micros(F.col("ts")) / 8.64e10
    d = read(spark, sf_dir, "events").withColumn("x", x - 19723)
    s = S.regression(F.col("x"), F.col("value"))
    return d.groupBy("user_id").agg(r6(s["slope"], "slope", 5), r6(s["mean_x"], "mean_x"), r6(s["mean_y"], "mean_y"))


def regression_by_part(spark, sf_dir):
    """A-13 on few samples a group: price over quantity."""
    s = S.regression(F.col("l_quantity"), F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(r6(s["slope"], "slope", 3), r6(s["mean_x"], "mean_x", 4), r6(s["mean_y"], "mean_y", 3))


def array_extremes(spark, sf_dir):
    """A-14 on arrays; A-15 as the first position of the largest element (from 0)."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_min(e).cast("double").alias("min"), F.array_max(e).cast("double").alias("max"), (F.array_position(e, F.array_max(e)) - 1).alias("max_index"))


def argmax_first(spark, sf_dir):
    """A-15, L-06: the first order with the highest price of each customer."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.max("o_totalprice").alias("price"))


def bbox_centroid(spark, sf_dir):
    """A-16, A-17, F-09: bounding box and vertex mean of each tenth's points."""
    d = points(spark, sf_dir).withColumn("g", F.col("id") % 10)
    return d.groupBy("g").agg(F.min("lat").alias("min_y"), F.max("lat").alias("max_y"), F.min("lon").alias("min_x"), F.max("lon").alias("max_x"), r6(F.avg("lon"), "cx"), r6(F.avg("lat"), "cy"))


def longest_run(spark, sf_dir):
    """A-18: each user's longest run of events of one type; start counts from 1."""
    d = O.longest_run(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return d.select("user_id", "value", F.col("start").cast("long").alias("start"), "length")


def byte_counts(spark, sf_dir):
    """A-19: bytes and bits of each source's texts."""
    n = F.octet_length("text").cast("long")
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).alias("bytes"), (F.sum(n) * 8).alias("bits"), F.count("*").alias("texts"))


def gauges(spark, sf_dir):
    """A-20: the latest value of each gauge (event type) and its time."""
    d = read(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
    return d.groupBy("event_type").agg(F.max_by("value", F.struct("us", "event_id")).alias("value"), F.max("us").alias("us"))


def zoom_range(spark, sf_dir):
    """A-21, IO-52: zoom levels and bounds kept as metadata."""
    return points(spark, sf_dir).agg(F.min(F.col("id") % 19).alias("min_zoom"), F.max(F.col("id") % 19).alias("max_zoom"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def decay_factors(spark, sf_dir):
    """A-22, S-41: decay by half-life and by mean lifetime."""
    t = F.col("l_quantity")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(S.decay_by_half_life(t, 12.5), "by_half_life", 9), r6(S.decay_by_lifetime(t, 12.5), "by_lifetime", 9))


def gaussian(spark, sf_dir):
    """A-23."""
    return read(spark, sf_dir, "events").select("event_id", r6(S.gaussian_pdf(F.col("value"), 50.0, 20.0), "pdf", 9), r6(S.gaussian_pdf(F.col("value") / 100), "standard", 9))


def half_life_run(spark, sf_dir):
    """S-41: what is left of each part's size after 0..9 half-lives."""
    d = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    return d.select("p_partkey", F.col("step").cast("long").alias("step"), r6(F.col("p_size") * F.pow(F.lit(0.5), F.col("step")), "remains"))


QUERIES = {
    "summary_by_type": (summary_by_type, "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY event_type"),
    "running_stats": (running_stats, """SELECT event_id, count(value) OVER w AS n, round((avg(value) OVER w) + 1e-9, 6) AS mean, min(value) OVER w AS min, max(value) OVER w AS max,
        round((var_pop(value) OVER w) + 1e-9, 3) AS var_biased, round((var_samp(value) OVER w) + 1e-9, 3) AS var_unbiased, round((stddev_samp(value) OVER w) + 1e-9, 4) AS sd_unbiased, round((stddev_pop(value) OVER w) + 1e-9, 4) AS sd_biased
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "variance_family": (variance_family, """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS max, min(l_quantity) AS min, round(var_pop(l_quantity) * count(l_quantity), 2) AS sum_sq,
        round(var_pop(l_quantity), 6) AS var_biased, round(var_samp(l_quantity), 6) AS var_unbiased, round(stddev_samp(l_quantity), 6) AS sd_unbiased, round(stddev_pop(l_quantity), 6) AS sd_biased FROM lineitem GROUP BY ALL"""),
    "linear_regression": (linear_regression, """SELECT user_id, round(CASE WHEN count(*) > 1 AND var_pop(x) > 0 THEN regr_slope(value, x) END, 5) AS slope, round(avg(x), 6) AS mean_x, round(avg(value), 6) AS mean_y
        FROM (SELECT user_id, value, epoch_us(ts) / 8.64e10 - 19723 AS x FROM events) GROUP BY user_id"""),
    "regression_by_part": (regression_by_part, """SELECT l_partkey, round(CASE WHEN count(*) > 1 AND var_pop(l_quantity) > 0 THEN regr_slope(l_extendedprice, l_quantity) END, 3) AS slope, round(avg(l_quantity), 4) AS mean_x, round(avg(l_extendedprice), 3) AS mean_y FROM lineitem GROUP BY l_partkey"""),
    "array_extremes": (array_extremes, "SELECT vec_id, list_min(embedding)::DOUBLE AS min, list_max(embedding)::DOUBLE AS max, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS max_index FROM embeddings"),
    "argmax_first": (argmax_first, "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey"),
    "bbox_centroid": (bbox_centroid, f"SELECT id % 10 AS g, min(lat) AS min_y, max(lat) AS max_y, min(lon) AS min_x, max(lon) AS max_x, round(avg(lon), 6) AS cx, round(avg(lat), 6) AS cy FROM {POINTS_SQL} GROUP BY 1"),
    "longest_run": (longest_run, """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
        b AS (SELECT user_id, event_type AS value, min(pos) AS start, count(*) AS length FROM a GROUP BY user_id, event_type, pos - k)
        SELECT user_id, value, start, length FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start) = 1"""),
    "byte_counts": (byte_counts, "SELECT source, sum(strlen(text))::BIGINT AS bytes, (sum(strlen(text)) * 8)::BIGINT AS bits, count(*) AS texts FROM documents GROUP BY source"),
    "gauges": (gauges, "SELECT event_type, arg_max(value, (ts, event_id)) AS value, epoch_us(max(ts)) AS us FROM events GROUP BY event_type"),
    "zoom_range": (zoom_range, f"SELECT min(id % 19) AS min_zoom, max(id % 19) AS max_zoom, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM {POINTS_SQL}"),
    "decay_factors": (decay_factors, "SELECT l_orderkey, l_linenumber, round(pow(2.0, -l_quantity / 12.5), 9) AS by_half_life, round(exp(-l_quantity / 12.5), 9) AS by_lifetime FROM lineitem"),
    "gaussian_pdf": (gaussian, "SELECT event_id, round(exp(-0.5 * ((value - 50) / 20) * ((value - 50) / 20)) / (20 * sqrt(2 * pi())), 9) AS pdf, round(exp(-0.5 * (value / 100) * (value / 100)) / sqrt(2 * pi()), 9) AS standard FROM events"),
    "half_life_run": (half_life_run, "SELECT p_partkey, step, round(p_size * pow(0.5, step), 6) AS remains FROM part, range(10) t(step)"),
}
