"""Positions, quantities, walks and flows on small cases: nulls, unknown names, cycles, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions import positions as P
from tidemark.functions import units as U
from tidemark.operators import graph as G

EDGES = "src string, dst string, directed boolean, cost double"


def test_altitudes(spark):
    d = spark.createDataFrame([(100.0, "Ellipsoid"), (100.0, "Geoid"), (5.0, "Terrain"), (5.0, "Sky"), (None, None)], "h double, f string")
    a = P.altitude(F.col("h"), F.col("f"))
    got = d.select(a.alias("a")).select("a.*", P.ellipsoidal(F.col("a"), F.lit(-30.0)).alias("e")).collect()
    assert [tuple(r) for r in got] == [(100.0, "Ellipsoid", "ELL", 100.0), (100.0, "Geoid", "MSL", 70.0), (5.0, "Terrain", "AGL", None), (5.0, "Unspecified", "UNK", None), (None, "Unspecified", "UNK", None)]


def test_dilutions(spark):
    d = spark.createDataFrame([(3.0, 4.0, 12.0, 3), (3.0, None, 1.0, 7), (None, None, None, None)], "h double, v double, t double, fix int")
    got = d.select(P.dops(F.col("h"), F.col("v"), F.col("t")).alias("d"), P.fix_type(F.col("fix")).alias("f")).select("d.p", "d.g", P.dops_text(F.col("d")), "f").collect()
    assert tuple(got[0]) == (5.0, 13.0, "hdop: 3.000 vdop: 4.000 pdop: 5.000 gdop: 13.000 tdop: 12.000", "ThreeDim")
    assert tuple(got[1]) == (None, None, "hdop: 3.000 vdop: ? pdop: ? gdop: ? tdop: 1.000", "Unknown")
    assert got[2][2].count("?") == 5 and got[2][3] == "Unknown"


def test_positions_about_a_base(spark):
    """A point straight above the base is up, or minus down, and nowhere else."""
    r = spark.range(1).select(P.positions(F.lit(40.0), F.lit(-75.0), F.lit(250.0), (40.0, -75.0)).alias("b")).collect()[0].b
    assert (r.enu.e, r.enu.n, r.enu.u) == pytest.approx((0, 0, 250), abs=1e-6) and (r.ned.n, r.ned.e, r.ned.d) == pytest.approx((0, 0, -250), abs=1e-6)


def test_quantities(spark):
    rows = [(1500.0, "Meter"), (0.0025, "Volt"), (50.0, "Hertz"), (0.0, "Ohm"), (-2.0e6, "Pascal"), (1e30, "Gram"), (1.0, "Furlong"), (None, "Meter"), (1.0, None)]
    got = [r.q for r in spark.createDataFrame(rows, "v double, u string").select(U.quantity(F.col("v"), F.col("u")).alias("q")).collect()]
    assert got == ["1.500km", "2.500mV", "50.000Hz", "0.000Ω", "-2.000MPa", "1" + "0" * 30 + ".000g", None, None, None]


def test_country_codes(spark):
    rows = [('"Aland"', "AX"), ("Aland", "AA"), (None, "ZZ"), ("Blank", None)]
    d = spark.createDataFrame(rows, "country string, code string")
    assert {tuple(r) for r in P.country_codes(d, "country", "code").collect()} == {("Aland", "AX"), ("Blank", None)}
    assert P.country_codes(d.limit(0), "country", "code").collect() == []


def test_walk_and_flows(spark):
    """A cycle, an undirected edge walked against its writing, a component out of reach."""
    e = spark.createDataFrame([("a", "b", True, 1.0), ("b", "a", True, 2.0), ("c", "b", False, 4.0), ("x", "a", True, 8.0), ("y", "z", True, 16.0)], EDGES)
    n = spark.createDataFrame([(k,) for k in "abcxyz"], "id string")
    nodes, edges = G.walked(n, e, spark.createDataFrame([("a",)], "id string"))
    assert sorted(r.id for r in nodes.collect()) == ["a", "b", "c"]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("a", "b"), ("b", "a"), ("c", "b")]
    f = {r.id: (r.kind, r.inflow, r.outflow) for r in G.flows(e, spark.createDataFrame([("x", 5.0), ("z", -5.0), ("alone", 1.0)], "id string, supply double")).collect()}
    assert f["a"] == ("Directed", 10.0, 1.0) and f["x"] == ("FloodSource", 0.0, 8.0) and f["z"] == ("FloodSink", 16.0, 0.0) and f["alone"] == ("FloodSource", 0.0, 0.0)


def test_inverse_beside_an_alias_of_its_input(spark):
    """Rounded results named like the inputs in the same select leave the way back exact."""
    args = (41.0, -71.5, 41.716666666666667, 42.683333333333333, 200_000.0, 750_000.0)
    x, y = geo.lambert_conformal(F.col("lat"), F.col("lon"), *args)
    d = spark.createDataFrame([(42.123456789, -70.987654321)], "lat double, lon double").select("lat", "lon", x.alias("x"), y.alias("y"))
    la, lo = geo.from_lambert_conformal(F.col("x"), F.col("y"), *args)
    r = d.select(F.round("x").alias("x"), F.round("y").alias("y"), la.alias("la"), lo.alias("lo")).collect()[0]
    assert (r.la, r.lo) == pytest.approx((42.123456789, -70.987654321), abs=1e-11)
