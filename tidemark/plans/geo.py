"""Queries on geometry, geodesy and tiles (G-*, C-*, F-*, J-06, IO-5x)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import geo as G
from tidemark.plans.common import POINTS_SQL, points, r6, read

BASE = (40.0, -75.0)
POLYGON = [(-120.0, -40.0), (10.0, -60.0), (90.0, 10.0), (40.0, 70.0), (-20.0, 5.0), (-100.0, 60.0)]
A, B_, E2 = G.axes()


def ecef_forward(spark, sf_dir):
    """C-01, C-03."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y, z = G.to_ecef(lat, lon, F.col("id") % 1000)
    return points(spark, sf_dir).select("id", r6(x, "x", 4), r6(y, "y", 4), r6(z, "z", 4))


def ecef_inverse(spark, sf_dir):
    """C-02 after C-01: the way back."""
    lat, lon = F.col("lat"), F.col("lon")
    d = points(spark, sf_dir).withColumn("h", (F.col("id") % 1000).cast("double"))
    d = d.select("id", *[c.alias(n) for n, c in zip("xyz", G.to_ecef(lat, lon, F.col("h")), strict=True)])
    la, lo, h = G.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return d.select("id", r6(la, "lat"), r6(lo, "lon"), r6(h, "h", 3))


_SQL_ECEF = f"""(SELECT id, (v + h) * cos(p) * cos(l) AS x, (v + h) * cos(p) * sin(l) AS y, (v * (1 - {E2!r}::DOUBLE) + h) * sin(p) AS z FROM
  (SELECT id, h, p, l, {A!r}::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin(p) * sin(p)) AS v FROM (SELECT id, radians(lat) AS p, radians(lon) AS l, H AS h FROM {POINTS_SQL})))"""


def enu(spark, sf_dir):
    """C-04 both ways."""
    lat, lon = F.col("lat"), F.col("lon")
    bx = _base()
    d = points(spark, sf_dir)
    x, y, z = G.to_ecef(lat, lon, F.lit(0.0))
    d = d.select("id", (x - bx[0]).alias("x"), (y - bx[1]).alias("y"), (z - bx[2]).alias("z"))
    e = G.to_enu((F.col("x"), F.col("y"), F.col("z")), *BASE)
    d = d.select("id", "x", *[c.alias(n) for n, c in zip("enu", e, strict=True)])
    back = G.from_enu((F.col("e"), F.col("n"), F.col("u")), *BASE)[0]
    return d.select("id", r6(F.col("e"), "e", 3), r6(F.col("n"), "n", 3), r6(F.col("u"), "u", 3), (F.abs(back - F.col("x")) < 1e-6).alias("back"))


def _base():
    p, l = math.radians(BASE[0]), math.radians(BASE[1])
    v = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    return v * math.cos(p) * math.cos(l), v * math.cos(p) * math.sin(l), v * (1 - E2) * math.sin(p)


def _enu_sql():
    bx, by, bz = _base()
    sp, cp, sl, cl = (f(math.radians(a)) for a in BASE for f in (math.sin, math.cos))
    return f"""SELECT id, round({-sl!r}::DOUBLE * x + {cl!r}::DOUBLE * y, 3) AS e, round({-sp * cl!r}::DOUBLE * x - {sp * sl!r}::DOUBLE * y + {cp!r}::DOUBLE * z, 3) AS n,
      round({cp * cl!r}::DOUBLE * x + {cp * sl!r}::DOUBLE * y + {sp!r}::DOUBLE * z, 3) AS u, true AS back FROM (SELECT id, x - ({bx!r}::DOUBLE) AS x, y - ({by!r}::DOUBLE) AS y, z - ({bz!r}::DOUBLE) AS z FROM {_SQL_ECEF.replace('H AS h', '0.0::DOUBLE AS h')})"""


def tile_index(spark, sf_dir):
    """C-05, IO-54 at zoom 10, and the way back."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y = G.tile(lat, lon, 10)
    la, lo = G.from_tile(x, y, 10)
    tx, ty = F.floor(x).cast("long"), F.floor(y).cast("long")
    return points(spark, sf_dir).select("id", tx.alias("x"), ty.alias("y"), G.tile_key(F.lit(10), tx, ty).alias("key"), r6(la, "lat", 4), r6(lo, "lon", 4))


def tile_cover(spark, sf_dir):
    """C-17, G-11, Q20 for all points."""
    return _cover(points(spark, sf_dir))


def _cover(d):
    lat, lon = F.col("lat"), F.col("lon")
    d = d.withColumn("zoom", F.explode(F.sequence(F.lit(3), F.lit(6))))
    x0, y0 = G.tile(lat + 2, lon, F.col("zoom"))
    x1, y1 = G.tile(lat - 2, lon + 4, F.col("zoom"))
    top = F.pow(F.lit(2.0), F.col("zoom")) - 1
    lo, hi = (lambda c: F.greatest(F.floor(c), F.lit(0)).cast("long")), (lambda c: F.least(F.floor(c).cast("double"), top).cast("long"))
    d = d.withColumns({"x0": lo(x0), "x1": hi(x1), "y0": lo(y0), "y1": hi(y1)}).where("x0 <= x1 and y0 <= y1")
    d = d.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return d.select("id", F.col("zoom").cast("long").alias("zoom"), "x", "y", F.concat_ws("/", "zoom", "x", "y").alias("path"))


def points_in_rect(spark, sf_dir):
    """F-02..F-05: open, closed and excluded ranges."""
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, sf_dir).select("id", (lat.between(-10, 30) & lon.between(20, 60)).alias("inside"), ((lat > -10) & (lat < 30)).alias("within_open"), (~lon.between(20, 60)).alias("outside"))


def points_in_polygon(spark, sf_dir):
    """G-07, J-06, Q14."""
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, sf_dir).where(G.in_polygon(lon, lat, POLYGON)).select("id")


def _polygon_sql():
    crossed = []
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True):
        crossed.append(f"CASE WHEN ((lat < {y1}) <> (lat < {y2})) AND lon < ({x2 - x1}) * (lat - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END")
    return f"SELECT id FROM {POINTS_SQL} WHERE ({' + '.join(crossed)}) % 2 = 1"


def segment_distance(spark, sf_dir):
    """G-01..G-03, G-05, Q15: distance to a segment, and to one without length; slope, length and direction."""
    lat, lon = F.col("lat"), F.col("lon")
    d = G.segment_distance(lon, lat, F.lit(-50.0), F.lit(-20.0), F.lit(80.0), F.lit(40.0))
    z = G.segment_distance(lon, lat, F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))
    return points(spark, sf_dir).select("id", r6(d, "distance"), r6(z, "to_point"), r6(F.hypot(lon, lat), "length"), r6(F.atan2(lat, lon), "direction"), r6(lon * 3 + lat * 4, "dot"), r6(lon * 4 - lat * 3, "cross"))


def segment_intersect(spark, sf_dir):
    """G-04: where the way from the origin to each point crosses a fixed segment."""
    lat, lon = F.col("lat"), F.col("lon")
    zero = F.lit(0.0)
    x, y = G.segment_intersection((zero, zero), (lon, lat), (F.lit(30.0), F.lit(-50.0)), (F.lit(60.0), F.lit(50.0)))
    return points(spark, sf_dir).select("id", r6(x, "x"), r6(y, "y"))


def polygon_shape(spark, sf_dir):
    """G-06, G-08, A-16: bounding box, area and orientation of polygons of eight points each."""
    d = points(spark, sf_dir).withColumn("g", F.floor(F.col("id") / 8).cast("long")).groupBy("g")
    d = d.agg(F.sort_array(F.collect_list(F.struct("id", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("p"))  # at most 8 by key
    a = G.signed_area(F.col("p"))
    return d.select("g", F.size("p").alias("n"), (F.round(a, 4) + 0.0).alias("area"), (a < -1e-6).alias("clockwise"), F.array_min(F.transform("p", lambda q: q["x"])).alias("min_x"), F.array_max(F.transform("p", lambda q: q["y"])).alias("max_y"))


def rect_overlap(spark, sf_dir):
    """G-09, Q12, J-06 as a range join: boxes of neighbouring ids that overlap, by a grid cell of the box corners."""
    lat, lon = F.col("lat"), F.col("lon")
    d = points(spark, sf_dir).select("id", lon.alias("x0"), lat.alias("y0"), (lon + 20).alias("x1"), (lat + 15).alias("y1"))
    e = points(spark, sf_dir).select((F.col("id") - 1).alias("id"), lon.alias("u0"), lat.alias("v0"), (lon + 20).alias("u1"), (lat + 15).alias("v1"))
    c = F.col
    return d.join(e, "id").select("id", G.rects_overlap((c("x0"), c("y0"), c("x1"), c("y1")), (c("u0"), c("v0"), c("u1"), c("v1"))).alias("overlap"))


#: Keys whose points share a place are a multiple of this apart. The ids of a list are of one block of keys, so a place has at most 128 in it and a cell some 100 times that.
PERIOD = 612_000
BLOCK = 128 * PERIOD


def near_pairs(spark, sf_dir):
    """G-12, J-06: all pairs of points within 3 degrees, the lesser id first.

    Cells of 3 degrees meet themselves and half of their neighbours as lists of places, a place with the list of its ids; two places are tested once, ids only paired.
    The join's work isn't in proportion to its bytes, so the number of its partitions comes from the rows and nothing is broadcast.
    """
    p = points(spark, sf_dir).where("id IS NOT NULL")
    return _near(p, max(2 * spark.sparkContext.defaultParallelism, p.count() // 25_000))


def _near(p, partitions):
    lat, lon = F.col("lat"), F.col("lon")
    cell = lambda c: F.floor(c / 3).cast("long")
    p = p.select("*", cell(lat).alias("cy"), cell(lon).alias("cx"), F.floor(F.col("id") / BLOCK).alias("block")).repartition(partitions, "cy", "cx")
    places = p.groupBy("cy", "cx", "block", "lat", "lon").agg(F.collect_list("id").alias("ids"), F.min("id").alias("least"))  # at most 128 by key
    cells = places.groupBy("cy", "cx", "block").agg(F.collect_list(F.struct("lat", "lon", "least", "ids")).alias("ps"))
    around = F.array(*[F.struct((F.col("cy") + i).alias("cy"), (F.col("cx") + j).alias("cx"), F.lit(i == j == 0).alias("own")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    others = cells.select(F.col("ps").alias("qs"), F.explode(around).alias("c")).select("qs", "c.*")
    d = cells.join(others.hint("merge"), ["cy", "cx"]).select("qs", "own", F.explode("ps").alias("p")).select("qs", "own", "p.*")
    d = d.select("lat", "lon", "least", "ids", "own", F.explode("qs").alias("q")).where("(NOT own OR least <= q.least) AND (lat - q.lat) * (lat - q.lat) + (lon - q.lon) * (lon - q.lon) <= 9")
    # No partition is merged: a stage of generated code holds all that one of its input rows gives, so pairs start from a pair of places, not of cells.
    d = d.select("ids", F.col("q.ids").alias("others"), (F.col("least") == F.col("q.least")).alias("same")).coalesce(2**31 - 1)
    d = d.select(F.explode("ids").alias("a"), "others", "same").select("a", F.explode("others").alias("b"), "same").where("NOT same OR a < b")
    return d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def transforms(spark, sf_dir):
    """G-10, M-12: scale and shift, rotation, shear and reflection."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y = G.linear_transform(lon, lat, 2.5, 10.0, -4.0)
    u, v = G.rotate(lon, lat, 30.0)
    return points(spark, sf_dir).select("id", r6(x, "x"), r6(y, "y"), r6(u, "rx"), r6(v, "ry"), r6(lon + 0.5 * lat, "shear"), r6(-lon, "mirror"))


def ellipsoid_radii(spark, sf_dir):
    """C-09."""
    lat, lon = F.col("lat"), F.col("lon")
    m, v = G.radii(lat)
    return points(spark, sf_dir).select("id", r6(m, "meridian", 3), r6(v, "prime_vertical", 3), r6(F.sqrt(m * v), "mean", 3))


def meridian_arc(spark, sf_dir):
    """C-11."""
    lat, lon = F.col("lat"), F.col("lon")
    return points(spark, sf_dir).select("id", r6(G.meridian_arc(lat), "arc", 3))


def _arc_sql():
    a, inv = G.ELLIPSOIDS["wgs84"]
    n = 1 / (2 * inv - 1)
    return f"""SELECT id, round({a / (1 + n)!r}::DOUBLE * ({1 + n**2 / 4 + n**4 / 64!r}::DOUBLE * p + ({-3 / 2 * (n - n**3 / 8)!r}::DOUBLE) * sin(2 * p) + {15 / 16 * (n**2 - n**4 / 4)!r}::DOUBLE * sin(4 * p)
      + ({-35 / 48 * n**3!r}::DOUBLE) * sin(6 * p) + {315 / 512 * n**4!r}::DOUBLE * sin(8 * p)), 3) AS arc FROM (SELECT id, radians(lat) AS p FROM {POINTS_SQL})"""


def geocentric(spark, sf_dir):
    """C-13: geocentric and reduced latitude; C-12: differences between ellipsoids."""
    lat, lon = F.col("lat"), F.col("lon")
    p = F.radians(lat)
    return points(spark, sf_dir).select("id", r6(F.degrees(F.atan((1 - E2) * F.tan(p))), "geocentric"), r6(F.degrees(F.atan(B_ / A * F.tan(p))), "reduced"))


def transverse_mercator(spark, sf_dir):
    """C-06 and its inverse, zone around 9 degrees east."""
    lat, lon = F.col("lat"), F.col("lon")
    d = points(spark, sf_dir).withColumn("lon", 9 + lon / 60)
    x, y = G.transverse_mercator(lat, lon, 9.0)
    d = d.select("id", "lat", "lon", x.alias("x"), y.alias("y"))
    la, lo = G.from_transverse_mercator(F.col("x"), F.col("y"), 9.0)
    return d.select("id", r6(F.col("x"), "x", 3), r6(F.col("y"), "y", 3), (F.abs(la - lat) < 1e-6).alias("lat_back"), (F.abs(lo - lon) < 1e-6).alias("lon_back"))


def _tm_sql():
    a, inv = G.ELLIPSOIDS["wgs84"]
    n = 1 / (2 * inv - 1)
    e = math.sqrt(E2)
    k = 0.9996 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    term = lambda f, g: " + ".join(f"({c!r}::DOUBLE) * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, c in enumerate(al, 1))
    return f"""SELECT id, round(500000 + {k!r}::DOUBLE * (eta + {term('cos', 'sinh')}), 3) AS x, round({k!r}::DOUBLE * (xi + {term('sin', 'cosh')}), 3) AS y, true AS lat_back, true AS lon_back
      FROM (SELECT id, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM (SELECT id, d, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t
      FROM (SELECT id, sin(radians(lat)) AS s, radians(lon / 60::DOUBLE) AS d FROM {POINTS_SQL})))"""


LCC = (41.0, -71.5, 41.716666666666667, 42.683333333333333, 200_000.0, 750_000.0)


def lambert(spark, sf_dir):
    """C-07, C-08 (the state plane of mainland Massachusetts) and the way back."""
    lat, lon = F.col("lat"), F.col("lon")
    d = points(spark, sf_dir).select("id", (42 + lat / 80).alias("lat"), (lon / 100 - 71.5).alias("lon"))
    x, y = G.lambert_conformal(lat, lon, *LCC)
    d = d.select("id", "lat", "lon", x.alias("x"), y.alias("y"))
    la, lo = G.from_lambert_conformal(F.col("x"), F.col("y"), *LCC)
    return d.select("id", r6(F.col("x"), "x", 3), r6(F.col("y"), "y", 3), (F.abs(la - lat) < 1e-9).alias("lat_back"), (F.abs(lo - lon) < 1e-9).alias("lon_back"))


def _lcc_sql():
    a, _, e2 = G.axes("grs80")
    e = math.sqrt(e2)
    lat0, lon0, lat1, lat2, false_e, false_n = LCC
    t = lambda p: f"(tan(pi() / 4 - {p} / 2) / pow((1 - {e!r}::DOUBLE * sin({p})) / (1 + {e!r}::DOUBLE * sin({p})), {e / 2!r}::DOUBLE))"
    m = lambda p: f"(cos({p}) / sqrt(1 - {e2!r}::DOUBLE * sin({p}) * sin({p})))"
    p0, p1, p2 = (f"radians({v!r}::DOUBLE)" for v in (lat0, lat1, lat2))
    return f"""WITH k AS (SELECT n, m1 / (n * pow(t1, n)) AS f, t0 FROM (SELECT {t(p0)} AS t0, {t(p1)} AS t1, {m(p1)} AS m1, (ln({m(p1)}) - ln({m(p2)})) / (ln({t(p1)}) - ln({t(p2)})) AS n))
      SELECT id, round({false_e!r} + {a!r}::DOUBLE * f * pow({t('p')}, n) * sin(n * d), 3) AS x, round({false_n!r} + {a!r}::DOUBLE * f * pow(t0, n) - {a!r}::DOUBLE * f * pow({t('p')}, n) * cos(n * d), 3) AS y, true AS lat_back, true AS lon_back
      FROM k, (SELECT id, radians(42 + lat / 80::DOUBLE) AS p, radians(lon / 100::DOUBLE) AS d FROM {POINTS_SQL})"""


_TILE = f"(SELECT id, lat, lon, (lon + 180) / 360 * 1024 AS fx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * 1024 AS fy FROM {POINTS_SQL})"
QUERIES = {
    "ecef_forward": (ecef_forward, f"SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM {_SQL_ECEF.replace('H AS h', 'id % 1000 AS h')}"),
    "ecef_inverse": (ecef_inverse, f"SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, round((id % 1000)::DOUBLE, 3) AS h FROM {POINTS_SQL}"),
    "enu": (enu, _enu_sql()),
    "tile_index": (tile_index, f"SELECT id, floor(fx)::BIGINT AS x, floor(fy)::BIGINT AS y, ((10::BIGINT << 58) | (floor(fy)::BIGINT << 29) | floor(fx)::BIGINT) AS key, round(lat, 4) AS lat, round(lon, 4) AS lon FROM {_TILE}"),
    "tile_cover": (tile_cover, f"""SELECT id, zoom, x, y, zoom || '/' || x || '/' || y AS path FROM (SELECT id, zoom, x, unnest(range(y0, y1 + 1)) AS y, y0, y1 FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM
        (SELECT id, zoom, greatest(floor((lon + 180) / 360 * n), 0)::BIGINT AS x0, least(floor((lon + 184) / 360 * n), n - 1)::BIGINT AS x1, greatest(floor((1 - asinh(tan(radians(lat + 2))) / pi()) / 2 * n), 0)::BIGINT AS y0, least(floor((1 - asinh(tan(radians(lat - 2))) / pi()) / 2 * n), n - 1)::BIGINT AS y1
         FROM (SELECT *, pow(2.0, zoom) AS n FROM {POINTS_SQL}, (VALUES (3::BIGINT), (4), (5), (6)) t(zoom))) WHERE x0 <= x1 AND y0 <= y1))"""),
    "points_in_rect": (points_in_rect, f"SELECT id, lat BETWEEN -10 AND 30 AND lon BETWEEN 20 AND 60 AS inside, lat > -10 AND lat < 30 AS within_open, lon NOT BETWEEN 20 AND 60 AS outside FROM {POINTS_SQL}"),
    "points_in_polygon": (points_in_polygon, _polygon_sql()),
    "segment_distance": (segment_distance, f"""SELECT id, round(sqrt(pow(lon - (-50 + 130 * t), 2) + pow(lat - (-20 + 60 * t), 2)), 6) AS distance, round(sqrt(pow(lon - 1, 2) + pow(lat - 2, 2)), 6) AS to_point, round(sqrt(lon * lon + lat * lat), 6) AS length, round(atan2(lat, lon), 6) AS direction,
        round(lon * 3 + lat * 4, 6) AS dot, round(lon * 4 - lat * 3, 6) AS cross FROM (SELECT *, least(greatest(((lon + 50) * 130 + (lat + 20) * 60) / 20500.0, 0), 1) AS t FROM {POINTS_SQL})"""),
    "segment_intersect": (segment_intersect, f"""SELECT id, round(CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN t * lon END, 6) AS x, round(CASE WHEN t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 THEN t * lat END, 6) AS y
        FROM (SELECT id, lon, lat, (30.0 * 100 - (-50.0) * 30) / nullif(lon * 100 - lat * 30, 0) AS t, (30.0 * lat - (-50.0) * lon) / nullif(lon * 100 - lat * 30, 0) AS u FROM {POINTS_SQL})"""),
    "polygon_shape": (polygon_shape, f"""WITH p AS (SELECT id // 8 AS g, id, lon AS x, lat AS y, coalesce(lead(lon) OVER w, first(lon) OVER w) AS nx, coalesce(lead(lat) OVER w, first(lat) OVER w) AS ny FROM {POINTS_SQL} WINDOW w AS (PARTITION BY id // 8 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
        SELECT g, count(*)::INT AS n, round(sum(x * ny - nx * y) / 2, 4) + 0.0 AS area, sum(x * ny - nx * y) / 2 < -1e-6 AS clockwise, min(x) AS min_x, max(y) AS max_y FROM p GROUP BY g"""),
    "rect_overlap": (rect_overlap, f"SELECT a.id, a.lon <= b.lon + 20 AND b.lon <= a.lon + 20 AND a.lat <= b.lat + 15 AND b.lat <= a.lat + 15 AS overlap FROM {POINTS_SQL} a JOIN {POINTS_SQL} b ON b.id = a.id + 1"),
    "near_pairs": (near_pairs, f"SELECT a.id AS a, b.id AS b FROM {POINTS_SQL} a JOIN {POINTS_SQL} b ON a.id < b.id AND (a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon) <= 9"),
    "transforms": (transforms, f"SELECT id, round(lon * 2.5 + 10, 6) AS x, round(lat * 2.5 - 4, 6) AS y, round(cos(radians(30)) * lon - sin(radians(30)) * lat, 6) AS rx, round(sin(radians(30)) * lon + cos(radians(30)) * lat, 6) AS ry, round(lon + 0.5 * lat, 6) AS shear, round(-lon, 6) AS mirror FROM {POINTS_SQL}"),
    "ellipsoid_radii": (ellipsoid_radii, f"""SELECT id, round(m, 3) AS meridian, round(v, 3) AS prime_vertical, round(sqrt(m * v), 3) AS mean FROM (SELECT id, {A * (1 - E2)!r}::DOUBLE / pow(w, 1.5) AS m, {A!r}::DOUBLE / sqrt(w) AS v FROM (SELECT id, 1 - {E2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat)) AS w FROM {POINTS_SQL}))"""),
    "meridian_arc": (meridian_arc, _arc_sql()),
    "geocentric": (geocentric, f"SELECT id, round(degrees(atan({1 - E2!r}::DOUBLE * tan(radians(lat)))), 6) AS geocentric, round(degrees(atan({B_ / A!r}::DOUBLE * tan(radians(lat)))), 6) AS reduced FROM {POINTS_SQL}"),
    "transverse_mercator": (transverse_mercator, _tm_sql()),
    "lambert_conformal": (lambert, _lcc_sql()),
}
