"""Statistics, kernels, windows and stateful filters against independent values."""

import math
from functools import partial

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import codec, kernels
from tidemark.functions import stats as S
from tidemark.operators import stateful as T
from tidemark.operators import windows as O


def one(df):
    return df.collect()[0]


def test_summary_of_the_textbook_sample(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "v double")
    s = S.summary(F.col("v"))
    r = one(df.agg(*[c.alias(n) for n, c in s.items()], F.var_pop("v").alias("vp"), S.sum_of_squares(F.col("v")).alias("ss")))
    assert (r.n, r.mean, r.min, r.max, r.vp, r.ss) == (8, 5.0, 2.0, 9.0, 4.0, 32.0)
    assert math.isclose(r.stddev**2, 32 / 7)


def test_single_sample_has_no_unbiased_variance(spark):
    assert one(spark.createDataFrame([(1.0,)], "v double").agg(F.var_samp("v").alias("x"))).x is None


def test_regression(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.5, 0.5), (1.0, 1.0)], "x double, y double")
    r = one(df.agg(*[c.alias(n) for n, c in S.regression(F.col("x"), F.col("y")).items()]))
    assert (r.slope, r.mean_x, r.mean_y) == (1.0, 0.5, 0.5)
    assert one(df.limit(1).agg(S.regression(F.col("x"), F.col("y"))["slope"].alias("s"))).s is None


@pytest.mark.parametrize(
    ("size", "degree", "derivative", "table", "scale"),
    [
        (5, 2, 0, [-3, 12, 17, 12, -3], 35), (7, 3, 0, [-2, 3, 6, 7, 6, 3, -2], 21), (9, 2, 0, [-21, 14, 39, 54, 59, 54, 39, 14, -21], 231),
        (7, 4, 0, [5, -30, 75, 131, 75, -30, 5], 231), (9, 5, 0, [15, -55, 30, 135, 179, 135, 30, -55, 15], 429),
        (5, 2, 1, [-2, -1, 0, 1, 2], 10), (7, 2, 1, [-3, -2, -1, 0, 1, 2, 3], 28), (5, 4, 1, [1, -8, 0, 8, -1], 12), (7, 3, 1, [22, -67, -58, 0, 58, 67, -22], 252), (9, 4, 1, [86, -142, -193, -126, 0, 126, 193, 142, -86], 1188),
    ],
)
def test_savitzky_golay_literature_tables(size, degree, derivative, table, scale):
    assert kernels.savitzky_golay(size, degree, derivative) == pytest.approx([x / scale for x in table], abs=1e-15)


def test_convolve_and_fir(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],)], "a array<double>")
    assert [r.c for r in df.select(kernels.convolve(F.col("a"), [1.0, 10.0]).alias("c")).collect()] == [[1.0, 12.0, 23.0, 30.0], []]
    rows = spark.createDataFrame([(i, float(i)) for i in range(4)], "i int, v double")
    got = [r.f for r in rows.select("i", kernels.causal(F.col("v"), [0.5, 0.25], Window.orderBy("i")).alias("f")).orderBy("i").collect()]
    assert got == [None, 0.5, 1.25, 2.0]


def test_zigzag_round_trip(spark):
    xs = [0, -1, 1, -2, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(x,) for x in xs], "x long").withColumn("z", codec.zigzag(F.col("x")))
    assert [r.b for r in df.select(codec.unzigzag(F.col("z")).alias("b")).collect()] == xs


def test_centred_bins_round_half_away(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in (100, 105, 114, 115, 94)], "k string, us long, v double")
    got = {(r.bin, r.n) for r in O.centred_bins(df, ["k"], "us", 10, "v").collect()}
    assert got == {(0, 1), (1, 2), (2, 2)}


def test_longest_run_reaches_the_end(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("abbaccc")], "k int, i int, v string")
    assert one(O.longest_run(df, ["k"], ["i"], "v"))[1:] == ("c", 5, 3)


def test_alpha_beta_equals_gamma_zero(spark):
    rows = [("k", i * 1_000_000, float(i * i)) for i in range(30)] + [("k", 5_000_000, 99.0)]
    df = spark.createDataFrame(rows, "k string, us long, v double").repartition(4)
    a = T.folded(df, "k", "us", "v", partial(T.alpha_beta_step, alpha=0.5, beta=0.1), T.AB).orderBy("us").collect()
    g = T.folded(df, "k", "us", "v", partial(T.alpha_beta_gamma_step, alpha=0.5, beta=0.1, gamma=0.0), T.ABG).orderBy("us").collect()
    assert len(a) == 29
    assert [r.estimated for r in a] == pytest.approx([r.estimated for r in g])


def test_window_filters():
    state, out = None, []
    for i in range(40):
        state, o = T.slope_step(state, i * 10, 3.0 * i, 100)
        out += [o] if o else []
    assert out and all(o[1] == pytest.approx(3e5) for o in out)
    state, out = None, []
    for i in range(40):
        state, o = T.kernel_step(state, i * 10, 2.0 * i, 100, 5, lambda n: kernels.savitzky_golay(n, 2))
        out += [o] if o else []
    assert out[0][2] == 13 and out[0][1] == pytest.approx(12.0)


def test_lttb_keeps_ends_and_spike():
    pts = [(float(i), 0.0) for i in range(100)]
    pts[57] = (57.0, 50.0)
    got = T.lttb(pts, 10)
    assert len(got) == 10 and got[0] == pts[0] and got[-1] == pts[-1] and pts[57] in got


def test_pyramid_counts(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1000)], "us long, v double")
    got = O.pyramid(df, "us", "v", [4, 6, 20]).groupBy("level").agg(F.sum("n").alias("n"), F.max("max").alias("m")).collect()
    assert all((r.n, r.m) == (1000, 999.0) for r in got) and len(got) == 3


@pytest.mark.parametrize("n", [2, 3, 7, 20])
def test_streamed_lttb_equals_the_whole(spark, n):
    import random

    rng = random.Random(n)
    series = {k: [(i * 10, float(rng.randrange(1000))) for i in range(size)] for k, size in (("a", 1), ("b", 5), ("c", 21), ("d", 997), (None, 64))}
    rows = [(k, t, v) for k, pts in series.items() for t, v in pts] + [("a", None, 1.0), ("a", 5, None)]
    rng.shuffle(rows)
    got: dict = {}
    for r in T.downsample(spark.createDataFrame(rows, "k string, us long, v double"), "k", "us", "v", n).collect():
        got.setdefault(r.k, []).append((r.us, r.v))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(T.lttb(v, n)) for k, v in series.items()}


def test_holds_run(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a"), (2, 2, None), (2, 3, "b"), (None, 1, "b"), (None, 2, "c")], "k int, t int, v string")
    found = lambda needle: {r.k: r.found for r in O.holds_run(df, ["k"], ["t"], "v", needle).collect()}
    assert found(["b", "c"]) == {1: True, 2: False, None: True} and found(["a", "b"]) == {1: True, 2: False, None: False} and found([]) == {1: True, 2: True, None: True}
