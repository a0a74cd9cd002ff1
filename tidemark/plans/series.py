"""Queries on time-series windows, kernels, codings and stateful filters (S-*)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import codec as C
from tidemark.functions import kernels as K
from tidemark.operators import stateful as T
from tidemark.operators import windows as O
from tidemark.plans.common import micros, r6, read

DAY, HOUR, MINUTE, SECOND = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000
FAMILIES = {"savgol_smooth_23": (2, 0, (5, 7, 9)), "savgol_smooth_45": (4, 0, (5, 7, 9)), "savgol_deriv_2": (2, 1, (5, 7, 9)), "savgol_deriv_3": (3, 1, (5, 7, 9))}


def events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))


def _by_user():
    return Window.partitionBy("user_id").orderBy("us", "event_id")


def rolling_1d(spark, sf_dir):
    """S-01, L-05, Q5, Q6: trailing day of each user: count, mean, first and last."""
    d = O.last_per_time(events(spark, sf_dir), ["user_id"], "us", "event_id")
    w = O.trailing(["user_id"], "us", DAY)
    return d.select("event_id", F.count("value").over(w).alias("n"), r6(F.avg("value").over(w), "mean"), F.first("value").over(w).alias("first"), F.last("value").over(w).alias("last"))


def sliding_tuples(spark, sf_dir):
    """S-02: triples of consecutive values of a user."""
    return O.sliding(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "value", 3).select("event_id", F.array_join("tuple", "|").alias("tuple"))


def contains_windowed(spark, sf_dir):
    """S-03: whether a user's types hold 'click, view' in a row."""
    return O.holds_run(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "event_type", ["click", "view"])


def _kernel(degree, derivative, sizes, spark, sf_dir):
    w = _by_user()
    return events(spark, sf_dir).select("event_id", *[r6(K.centred(F.col("value"), K.savitzky_golay(n, degree, derivative), w), f"k{n}", 5) for n in sizes])


def _kernel_sql(degree, derivative, sizes):
    def one(n):
        m, ws = n // 2, K.savitzky_golay(n, degree, derivative)
        terms = " + ".join(f"{x!r} * " + (f"lag(value, {m - i}) OVER w" if i < m else f"lead(value, {i - m}) OVER w" if i > m else "value") for i, x in enumerate(ws) if x)
        return f"round(CASE WHEN lag(value, {m}) OVER w IS NOT NULL AND lead(value, {m}) OVER w IS NOT NULL THEN {terms} END, 5) AS k{n}"

    return f"SELECT event_id, {', '.join(map(one, sizes))} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def bins_1h_centered(spark, sf_dir):
    """S-20, Q3, Q4."""
    d = O.centred_bins(events(spark, sf_dir), ["event_type"], "us", HOUR, "value")
    return d.select("event_type", "bin", "bin_center_us", "n", r6(F.col("mean"), "mean"), "min", "max", r6(F.col("stddev"), "stddev"))


def _clock(width, spark, sf_dir):
    d = O.clock_bins(events(spark, sf_dir), ["event_type"], "us", width, "value")
    return d.select("event_type", "start_us", "n", r6(F.col("mean"), "mean"), "min", "max", r6(F.col("stddev"), "stddev"))


def _clock_sql(width):
    return f"SELECT event_type, (epoch_us(ts) // {width} * {width})::BIGINT AS start_us, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1, 2"


TAPS = (0.5, 0.25, 0.125, 0.125)


def fir_causal(spark, sf_dir):
    """S-24 with all taps (Q9)."""
    return events(spark, sf_dir).select("event_id", r6(K.causal(F.col("value"), list(TAPS), _by_user()), "filtered"))


def convolve_arrays(spark, sf_dir):
    """S-22 on arrays, length n + k - 1 (Q10)."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(K.convolve(e, [0.25, 0.5, 0.25])).alias("i", "v"))
    return d.select("vec_id", F.col("i").cast("long").alias("i"), r6(F.col("v"), "v"))


def slope_by_day(spark, sf_dir):
    """S-25 aligned to the clock: slope a day of each user's values, by four days."""
    d = events(spark, sf_dir).withColumn("b", F.floor(F.col("us") / (4 * DAY)).cast("long")).withColumn("x", (F.col("us") - F.col("b") * 4 * DAY) / DAY)
    return d.groupBy("user_id", "b").agg(F.count("*").alias("n"), r6(F.when((F.count("x") > 1) & (F.var_pop("x") > 0), F.regr_slope("value", "x")), "slope", 3))


def delta_zigzag(spark, sf_dir):
    """S-32..S-35: differences of times, zigzag and its inverse, xor with the one before, bytes of the code."""
    w = _by_user()
    d = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("delta", C.delta(F.col("cents"), w)).withColumn("xor", C.xor_delta(F.col("cents"), w))
    d = d.withColumn("zigzag", C.zigzag(F.col("delta")))
    return d.select("event_id", "delta", "zigzag", C.unzigzag(F.col("zigzag")).alias("back"), "xor", C.vbyte_length(F.col("zigzag")).alias("bytes"))


def delta_roundtrip(spark, sf_dir):
    """S-32: the running sum of the differences is the series."""
    w = _by_user()
    d = events(spark, sf_dir).withColumn("delta", C.delta(F.col("us"), w))
    return d.select("event_id", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("us"))


def dictionary_code(spark, sf_dir):
    """S-38, H-32, J-07: values by number of first appearance, joined back as a dictionary."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    codes = d.groupBy("source").agg(F.min("doc_id").alias("f"))
    codes = codes.select("source", (F.row_number().over(Window.orderBy("f")) - 1).cast("long").alias("code"))
    codes = codes.withColumnRenamed("source", "_source")
    return d.join(codes, d["source"].eqNullSafe(codes["_source"])).select("doc_id", "code")


def pyramid(spark, sf_dir):
    """S-29 at 2^30, 2^34 and 2^38 microseconds."""
    d = O.pyramid(events(spark, sf_dir), "us", "value", [30, 34, 38])
    return d.select(F.col("level").cast("long").alias("level"), "cell", "n", "min", "max", r6(F.col("mean"), "mean"))


def alpha_beta(spark, sf_dir):
    """S-26."""
    d = T.folded(events(spark, sf_dir), "user_id", "us", "value", partial(T.alpha_beta_step, alpha=0.5, beta=0.1), T.AB)
    return d.select("user_id", "us", *[r6(F.col(c), c, 4) for c in ("predicted", "estimated", "residual")])


ALPHA_BETA_SQL = """
WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) AS us, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, us, v AS predicted, v AS estimated, 0.0::DOUBLE AS velocity, 0.0::DOUBLE AS residual FROM s WHERE k = 1
      UNION ALL
      SELECT s.user_id, s.k, s.us, p, p + 0.5 * (s.v - p), f.velocity + 0.1 * ((s.v - p) / ((s.us - f.us) / 1e6::DOUBLE)), s.v - p
      FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1, LATERAL (SELECT f.estimated + f.velocity * ((s.us - f.us) / 1e6::DOUBLE) AS p))
SELECT user_id, us, round(predicted, 4) AS predicted, round(estimated, 4) AS estimated, round(residual, 4) AS residual FROM f WHERE k > 1
"""


ALPHA_BETA_GAMMA_SQL = """
WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) AS us, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, us, v AS predicted, v AS estimated, 0.0::DOUBLE AS velocity, 0.0::DOUBLE AS acceleration, 0.0::DOUBLE AS residual FROM s WHERE k = 1
      UNION ALL
      SELECT s.user_id, s.k, s.us, p, p + 0.5 * (s.v - p), f.velocity + 0.1 * ((s.v - p) / dt), f.acceleration + 0.01 * ((s.v - p) / (dt * dt / 2)), s.v - p
      FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1, LATERAL (SELECT (s.us - f.us) / 1e6::DOUBLE AS dt), LATERAL (SELECT f.estimated + f.velocity * dt + f.acceleration * (dt * dt / 2) AS p))
SELECT user_id, us, CASE WHEN abs(predicted) < 1e9 THEN round(predicted, 3) ELSE predicted END AS predicted, CASE WHEN abs(estimated) < 1e9 THEN round(estimated, 3) ELSE estimated END AS estimated,
       CASE WHEN abs(residual) < 1e9 THEN round(residual, 3) ELSE residual END AS residual FROM f WHERE k > 1
"""


def alpha_beta_gamma(spark, sf_dir):
    """S-27."""
    d = T.folded(events(spark, sf_dir), "user_id", "us", "value", partial(T.alpha_beta_gamma_step, alpha=0.5, beta=0.1, gamma=0.01), T.ABG)
    fine = lambda c: F.when(F.abs(c) < 1e9, F.round(c, 3)).otherwise(F.col(c)).alias(c)  # noqa: E731  larger values have no such digits
    return d.select("user_id", "us", *[fine(c) for c in ("predicted", "estimated", "residual")])


def window_slope_filter(spark, sf_dir):
    """S-25, Q8: slope a day, emitted as the data fill the window."""
    d = T.folded(events(spark, sf_dir), "user_id", "us", "value", partial(T.slope_step, window_us=DAY), "at_us long, slope double, n long")
    return d.select("user_id", "at_us", r6(F.col("slope"), "slope", 9), "n")


def timed_window_filter(spark, sf_dir):
    """S-23, Q7: smoothing kernel over the gathered samples."""
    step = partial(T.kernel_step, window_us=DAY, minimum=5, kernel=lambda n: K.savitzky_golay(n, 2))
    d = T.folded(events(spark, sf_dir), "user_id", "us", "value", step, "at_us long, value double, n long")
    return d.select("user_id", "at_us", r6(F.col("value"), "value"), "n")


def _gathering_sql(keep_us: int, full: str, result: str) -> str:
    """A user's samples gathered in order of time, one a time, until `full` holds of them (h) and the last time; then `result` of them
    by place i of n, time t and value x."""
    return f"""WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) AS us, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events),
      f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0::BIGINT AS us, []::STRUCT(t BIGINT, x DOUBLE)[] AS h, false AS done FROM events
            UNION ALL
            SELECT user_id, k, us, h, {full} FROM (SELECT s.user_id, s.k, s.us, list_append(list_filter(CASE WHEN f.done THEN [] ELSE f.h END, lambda p: p.t <> s.us AND p.t >= s.us - {keep_us}), {{'t': s.us, 'x': s.v}}) AS h FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)),
      g AS (SELECT user_id, us, len(h) AS n, unnest(range(1, len(h) + 1)) AS i, unnest(h) AS p FROM f WHERE done)
      SELECT user_id, us - {DAY // 2} AS at_us, {result}, n FROM (SELECT *, p.t AS t, p.x AS x FROM g) GROUP BY user_id, us, n"""


SLOPE_SQL = _gathering_sql(DAY, f"us - h[1].t >= {DAY * 95 // 100} AND len(h) > 1", "round(regr_slope(x, (t - us) / 1e6::DOUBLE), 9) AS slope")
#: The quadratic's smoothing weights in closed form; they sum to 1.
KERNEL_SQL = _gathering_sql(2 * DAY, f"us - h[1].t > {DAY} AND len(h) >= 5 AND len(h) % 2 = 1", "round(sum(x * 3 * ((3 * n * n - 7) / 4.0::DOUBLE - 5 * (i - (n + 1) / 2.0::DOUBLE) * (i - (n + 1) / 2.0::DOUBLE)) / (n * (n * n - 4))), 6) AS value")


def lttb(spark, sf_dir):
    """S-28: 20 points of each user's curve."""
    return T.downsample(events(spark, sf_dir), "user_id", "us", "value", 20)


def chunked(spark, sf_dir):
    """L-02..L-05: chunks of 10 rows of a user with their first and last sample."""
    d = O.chunks(events(spark, sf_dir), ["user_id"], ["us", "event_id"], 10)
    return d.groupBy("user_id", "chunk").agg(F.count("*").alias("n"), F.min_by("value", F.struct("us", "event_id")).alias("first"), F.max_by("value", F.struct("us", "event_id")).alias("last"))


def retained_bins(spark, sf_dir):
    """S-20, W-05: what stays of daily bins after removal of data before a time: bins from the one before it on."""
    d = O.clock_bins(events(spark, sf_dir), [], "us", DAY, "value")
    return d.where(F.col("start_us") >= 1705276800000000 - DAY).select("start_us", "n", r6(F.col("mean"), "mean"))


QUERIES = {
    "rolling_1d": (rolling_1d, f"""SELECT event_id, count(value) OVER w AS n, round(avg(value) OVER w, 6) AS mean, first(value) OVER w AS first, last(value) OVER w AS last
        FROM (SELECT *, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
        WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)"""),
    "sliding_tuples": (sliding_tuples, """SELECT event_id, array_to_string(t, '|') AS tuple FROM (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM events) WHERE len(t) = 3"""),
    "contains_windowed": (contains_windowed, """SELECT user_id, bool_or(event_type = 'click' AND nxt = 'view') AS found FROM (SELECT user_id, event_type, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS nxt FROM events) GROUP BY user_id"""),
    **{name: (partial(_kernel, d, r, n), _kernel_sql(d, r, n)) for name, (d, r, n) in FAMILIES.items()},
    "bins_1h_centered": (bins_1h_centered, f"""SELECT event_type, bin, a + bin * {HOUR} AS bin_center_us, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS stddev
        FROM (SELECT *, round((us - a) / {HOUR})::BIGINT AS bin FROM (SELECT event_type, value, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY event_type) AS a FROM events)) GROUP BY event_type, bin, a"""),
    "per_second": (partial(_clock, SECOND), _clock_sql(SECOND)),
    "per_minute": (partial(_clock, MINUTE), _clock_sql(MINUTE)),
    "per_day": (partial(_clock, DAY), _clock_sql(DAY)),
    "fir_causal": (fir_causal, "SELECT event_id, round(0.5 * value + 0.25 * lag(value, 1) OVER w + 0.125 * lag(value, 2) OVER w + 0.125 * lag(value, 3) OVER w, 6) AS filtered FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "convolve_arrays": (convolve_arrays, """SELECT vec_id, i + j AS i, round(sum(x * k), 6) AS v FROM
        (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM embeddings), (VALUES (0::BIGINT, 0.25), (1, 0.5), (2, 0.25)) t(j, k) GROUP BY vec_id, i + j"""),
    "slope_by_day": (slope_by_day, f"""SELECT user_id, b, count(*) AS n, round(CASE WHEN count(*) > 1 AND var_pop(x) > 0 THEN regr_slope(value, x) END, 3) AS slope FROM
        (SELECT user_id, value, epoch_us(ts) // {4 * DAY} AS b, (epoch_us(ts) % {4 * DAY}) / {DAY} AS x FROM events) GROUP BY user_id, b"""),
    "delta_zigzag": (delta_zigzag, """SELECT event_id, delta, z AS zigzag, delta AS back, x AS xor, greatest(1, ceil(len(bin(z)) / 7))::BIGINT AS bytes FROM
        (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS z FROM
          (SELECT event_id, c - lag(c, 1, 0) OVER w AS delta, xor(c, lag(c, 1, 0) OVER w) AS x FROM (SELECT *, round(value * 100)::BIGINT AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""),
    "delta_roundtrip": (delta_roundtrip, "SELECT event_id, epoch_us(ts) AS us FROM events"),
    "dictionary_code": (dictionary_code, "SELECT doc_id, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS f FROM documents)"),
    "pyramid": (pyramid, "SELECT level, epoch_us(ts) >> level::INTEGER AS cell, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean FROM events, (VALUES (30::BIGINT), (34), (38)) t(level) GROUP BY 1, 2"),
    "alpha_beta": (alpha_beta, ALPHA_BETA_SQL),
    "alpha_beta_gamma": (alpha_beta_gamma, ALPHA_BETA_GAMMA_SQL),
    "window_slope_filter": (window_slope_filter, SLOPE_SQL),
    "timed_window_filter": (timed_window_filter, KERNEL_SQL),
    "lttb": (lttb, None),
    "chunked": (chunked, """SELECT user_id, chunk, count(*) AS n, arg_min(value, k) AS first, arg_max(value, k) AS last FROM
        (SELECT user_id, value, k, (k - 1) // 10 AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)) GROUP BY user_id, chunk"""),
    "retained_bins": (retained_bins, f"SELECT epoch_us(ts) // {DAY} * {DAY} AS start_us, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE epoch_us(ts) >= {1705276800000000 - DAY} GROUP BY 1"),
}
