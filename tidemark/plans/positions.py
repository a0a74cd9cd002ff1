"""Queries on positions, quantities and walks through graphs (C-14..C-16, M-27, T-19, T-20, N-08, N-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import positions as P
from tidemark.functions import units as U
from tidemark.operators import graph as G
from tidemark.plans.common import POINTS_SQL, points, r6, read
from tidemark.plans.geo import BASE, _base, _enu_sql
from tidemark.plans.io import _EDGES, _edges

_UNITS = ["Meter", "Pascal", "Hertz", "Volt", "Ohm", "Gram", "Furlong"]
_FRAME_NAMES = list(P.FRAMES) + ["Sky"]


def _pick(names: list, k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(k, F.lit(len(names))) + 1).cast("int"))


def altitude_frames(spark, sf_dir):
    """C-14: altitudes in every frame, and their ellipsoidal heights where they are known; an unlisted frame is unspecified."""
    d = points(spark, sf_dir).select("id", P.altitude(F.col("id") % 9000 - 100, _pick(_FRAME_NAMES, F.col("id"))).alias("a"), (F.col("lat") / 4).alias("geoid"))
    return d.select("id", "a.value", "a.frame", "a.short", r6(P.ellipsoidal(F.col("a"), F.col("geoid")), "ellipsoidal", 4))


def dilutions(spark, sf_dir):
    """C-15: kinds of fixes, dilutions of precision from their parts, and these as text."""
    k = F.col("id")
    d = P.dops(F.when(k % 5 != 0, (k % 7 + 1) / 2), F.when(k % 6 != 0, (k % 9 + 1) / 4), (k % 3 + 1) / 8)
    s = points(spark, sf_dir).select("id", P.fix_type(k % 6).alias("fix"), d.alias("d"))
    return s.select("id", "fix", r6(F.col("d.p"), "p"), r6(F.col("d.g"), "g"), P.dops_text(F.col("d")).alias("text"))


def position_bundles(spark, sf_dir):
    """C-16: each point in the frames of the earth, of the ellipsoid and about a base."""
    b = P.positions(F.col("lat"), F.col("lon"), F.lit(0.0), BASE)
    d = points(spark, sf_dir).select("id", b.alias("b"))
    base = _base()
    away = F.sqrt(sum(((F.col(f"b.ecef.{k}") - v) ** 2 for k, v in zip("xyz", base, strict=True)), F.lit(0.0)))
    local = F.sqrt(F.col("b.ned.n") ** 2 + F.col("b.ned.e") ** 2 + F.col("b.ned.d") ** 2)
    return d.select("id", r6(F.col("b.ned.n"), "n", 3), r6(F.col("b.ned.e"), "e", 3), r6(-F.col("b.ned.d"), "u", 3), (F.abs(away - local) < 1e-3).alias("back"))


def quantities(spark, sf_dir):
    """M-27, T-19: prices as quantities of several units, one of them unknown; orders without a unit's symbol come out null."""
    v = F.col("o_totalprice") * F.pow(F.lit(10.0), F.pmod(F.col("o_orderkey"), F.lit(5)) * 3 - 9)
    unit = _pick(_UNITS, F.col("o_orderkey"))
    return read(spark, sf_dir, "orders").select("o_orderkey", unit.alias("unit"), U.lookup(unit, U.SYMBOLS).alias("symbol"), U.quantity(v, unit).isNotNull().alias("known"), F.regexp_extract(U.quantity(v, unit), r"[^0-9.]*$", 0).alias("tail"))


def country_table(spark, sf_dir):
    """T-20: countries and codes from a table given as a parameter, here nations and their keys."""
    d = read(spark, sf_dir, "nation").select(F.concat(F.lit('"'), "n_name", F.lit('"')).alias("name"), F.upper(F.substring("n_name", 1, 2)).alias("code"))
    return P.country_codes(d, "name", "code")


def graph_walk(spark, sf_dir):
    """N-08: the part of the graph that a walk from two nations makes: nodes and edges."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n, w = G.walked(nodes, e, spark.range(3, 5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id")))
    return n.select(F.lit("node").alias("kind"), "id").unionByName(w.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id")))


def graph_flows(spark, sf_dir):
    """N-11: what may flow into and out of each node; regions are sources, customers sinks."""
    e = _edges(spark, sf_dir)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind = F.substring("id", 1, 1)
    return G.flows(e, ids.select("id", F.when(kind == "r", 100.0).when(kind == "c", -1.0).otherwise(0.0).alias("supply")))


def _list(names: list) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_ALTITUDE = f"SELECT id, lat, (id % 9000 - 100)::DOUBLE AS value, ({_list(list(P.FRAMES) + ['Unspecified'])})[(id % {len(_FRAME_NAMES)} + 1)::INT] AS frame, ({_list(list(P.FRAMES.values()) + ['UNK'])})[(id % {len(_FRAME_NAMES)} + 1)::INT] AS short FROM {POINTS_SQL}"
_PART = lambda k: f"'{k}dop: ' || coalesce(printf('%.3f', {k}), '?')"
_SIZED = f"SELECT o_orderkey, o_totalprice * pow(10.0, (o_orderkey % 5) * 3 - 9) AS v, (o_orderkey % {len(_UNITS)} + 1)::INT AS i FROM orders"
QUERIES = {
    "altitude_frames": (altitude_frames, f"SELECT id, value, frame, short, round(CASE frame WHEN 'Ellipsoid' THEN value WHEN 'Geoid' THEN value + lat / 4 END, 4) AS ellipsoidal FROM ({_ALTITUDE})"),
    "dilutions": (dilutions, f"""SELECT id, (['Unknown', 'NoFix', 'TwoDim', 'ThreeDim', 'Unknown', 'Unknown'])[(id % 6 + 1)::INT] AS fix, round(p, 6) AS p, round(g, 6) AS g, {" || ' ' || ".join(map(_PART, "hvpgt"))} AS text
        FROM (SELECT *, sqrt(h * h + v * v) AS p, sqrt(h * h + v * v + t * t) AS g FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN (id % 7 + 1) / 2.0::DOUBLE END AS h, CASE WHEN id % 6 <> 0 THEN (id % 9 + 1) / 4.0::DOUBLE END AS v, (id % 3 + 1) / 8.0::DOUBLE AS t FROM {POINTS_SQL}))"""),
    "position_bundles": (position_bundles, _enu_sql()),
    "quantities": (quantities, f"""SELECT o_orderkey, ({_list(_UNITS)})[i] AS unit, sym AS symbol, sym IS NOT NULL AS known, CASE WHEN sym IS NOT NULL THEN (['n', 'µ', 'm', '', 'k', 'M', 'G', 'T'])[floor(log10(v) / 3)::INT + 4] || sym END AS tail
        FROM (SELECT *, ({_list([U.SYMBOLS.get(u, '-') for u in _UNITS])})[i] AS s, nullif(s, '-') AS sym FROM ({_SIZED}))"""),
    "country_table": (country_table, "SELECT n_name AS country, upper(substring(n_name, 1, 2)) AS code FROM nation"),
    "graph_walk": (graph_walk, f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), b AS (SELECT 'n3' AS id UNION SELECT 'n4' UNION SELECT e.dst FROM b JOIN e ON e.src = b.id)
        SELECT 'node' AS kind, id FROM b UNION ALL SELECT 'edge', src || '>' || dst FROM e WHERE src IN (SELECT id FROM b)"""),
    "graph_flows": (graph_flows, f"""WITH e AS (SELECT * FROM {_EDGES}), f AS (SELECT dst AS id, cost AS inflow, 0.0::DOUBLE AS outflow FROM e UNION ALL SELECT src, 0.0, cost FROM e)
        SELECT id, CASE left(id, 1) WHEN 'r' THEN 100.0 WHEN 'c' THEN -1.0 ELSE 0.0 END::DOUBLE AS supply, sum(inflow) AS inflow, sum(outflow) AS outflow, CASE left(id, 1) WHEN 'r' THEN 'FloodSource' WHEN 'c' THEN 'FloodSink' ELSE 'Directed' END AS kind FROM f GROUP BY id"""),
}
