"""Planar geometry, geodesy, tiles (G-*, C-*, IO-54) as column expressions; angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of standard ellipsoids (C-12).
ELLIPSOIDS = {"wgs84": (6378137.0, 298.257223563), "grs80": (6378137.0, 298.257222101), "wgs72": (6378135.0, 298.26), "intl1924": (6378388.0, 297.0), "clarke1866": (6378206.4, 294.9786982), "airy1830": (6377563.396, 299.3249646), "bessel1841": (6377397.155, 299.1528128), "mean_radius": (6371008.7714, math.inf), "equal_area": (6371007.1809, math.inf), "equal_volume": (6371000.79, math.inf)}
ELLIPSOIDS |= {"nad27": ELLIPSOIDS["clarke1866"], "nad83": ELLIPSOIDS["grs80"], "navionics": ELLIPSOIDS["intl1924"]}


def axes(name: str = "wgs84") -> tuple[float, float, float]:
    """a, b and the first eccentricity squared (C-10)."""
    a, inv = ELLIPSOIDS[name]
    f = 1 / inv
    return a, a * (1 - f), f * (2 - f)


def radii(lat: Column, name: str = "wgs84") -> tuple[Column, Column]:
    """C-09: radius of curvature in the meridian and in the prime vertical."""
    a, _, e2 = axes(name)
    s = F.sin(F.radians(lat))
    w = 1 - e2 * s * s
    return a * (1 - e2) / F.pow(w, F.lit(1.5)), a / F.sqrt(w)


def to_ecef(lat: Column, lon: Column, h: Column, name: str = "wgs84") -> tuple[Column, Column, Column]:
    """C-01, C-03."""
    _, _, e2 = axes(name)
    _, v = radii(lat, name)
    p, l = F.radians(lat), F.radians(lon)
    return (v + h) * F.cos(p) * F.cos(l), (v + h) * F.cos(p) * F.sin(l), (v * (1 - e2) + h) * F.sin(p)


def from_ecef(x: Column, y: Column, z: Column, name: str = "wgs84") -> tuple[Column, Column, Column]:
    """C-02: Bowring's formula, one step."""
    a, b, e2 = axes(name)
    p = F.sqrt(x * x + y * y)
    q = F.atan2(z * a, p * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(q), F.lit(3)), p - e2 * a * F.pow(F.cos(q), F.lit(3)))
    s = F.sin(phi)
    return F.degrees(phi), F.degrees(F.atan2(y, x)), p / F.cos(phi) - a / F.sqrt(1 - e2 * s * s)


def to_enu(d: tuple[Column, Column, Column], lat: float, lon: float) -> tuple[Column, Column, Column]:
    """C-04: east, north, up of an ECEF difference at a base point."""
    sp, cp, sl, cl = math.sin(math.radians(lat)), math.cos(math.radians(lat)), math.sin(math.radians(lon)), math.cos(math.radians(lon))
    x, y, z = d
    return -sl * x + cl * y, -sp * cl * x - sp * sl * y + cp * z, cp * cl * x + cp * sl * y + sp * z


def from_enu(d: tuple[Column, Column, Column], lat: float, lon: float) -> tuple[Column, Column, Column]:
    sp, cp, sl, cl = math.sin(math.radians(lat)), math.cos(math.radians(lat)), math.sin(math.radians(lon)), math.cos(math.radians(lon))
    e, n, u = d
    return -sl * e - sp * cl * n + cp * cl * u, cl * e - sp * sl * n + cp * sl * u, cp * n + sp * u


def tile(lat: Column, lon: Column, zoom: int | Column) -> tuple[Column, Column]:
    """C-05: web-Mercator tile coordinates, fractional."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def from_tile(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n = float(1 << zoom)
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n)))), x / n * 360 - 180


def tile_key(zoom: Column, col: Column, row: Column) -> Column:
    """IO-54, Q19."""
    return F.shiftleft(zoom.cast("long"), 58).bitwiseOR(F.shiftleft(row.cast("long"), 29)).bitwiseOR(col.cast("long"))


def meridian_arc(lat: Column, name: str = "wgs84") -> Column:
    """C-11: length of the meridian from the equator, by the series in the third flattening."""
    a, inv = ELLIPSOIDS[name]
    n = 1 / (2 * inv - 1)
    p = F.radians(lat)
    c = (1 + n**2 / 4 + n**4 / 64, -3 / 2 * (n - n**3 / 8), 15 / 16 * (n**2 - n**4 / 4), -35 / 48 * n**3, 315 / 512 * n**4)
    return a / (1 + n) * (c[0] * p + c[1] * F.sin(2 * p) + c[2] * F.sin(4 * p) + c[3] * F.sin(6 * p) + c[4] * F.sin(8 * p))


def transverse_mercator(lat: Column, lon: Column, lon0: float, scale: float = 0.9996, false_e: float = 500_000.0, name: str = "wgs84") -> tuple[Column, Column]:
    """C-06 forward, by the series in the third flattening to third order."""
    a, inv = ELLIPSOIDS[name]
    n = 1 / (2 * inv - 1)
    e = math.sqrt(axes(name)[2])
    k = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    s, d = F.sin(F.radians(lat)), F.radians(lon - lon0)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(al, 1)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(al, 1)), F.lit(0.0))
    return false_e + scale * k * east, scale * k * north


def from_transverse_mercator(x: Column, y: Column, lon0: float, scale: float = 0.9996, false_e: float = 500_000.0, name: str = "wgs84") -> tuple[Column, Column]:
    """C-06 inverse."""
    a, inv = ELLIPSOIDS[name]
    n = 1 / (2 * inv - 1)
    k = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    be = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    de = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = y / (scale * k), (x - false_e) / (scale * k)
    xi2 = xi - sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(be, 1)), F.lit(0.0))
    eta2 = eta - sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(be, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(de, 1)), F.lit(0.0))
    return F.degrees(lat), lon0 + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2)))


def lambert_conformal(lat: Column, lon: Column, lat0: float, lon0: float, lat1: float, lat2: float, false_e: float, false_n: float, name: str = "grs80") -> tuple[Column, Column]:
    """C-07 forward, with two standard parallels on an ellipsoid or, by the name of a sphere, on it; C-08 with the parameters of a state plane."""
    a, _, e2 = axes(name)
    e = math.sqrt(e2)
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    s = F.sin(F.radians(lat))
    tc = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    r, r0, th = a * f * F.pow(tc, F.lit(n)), a * f * t(p0) ** n, n * F.radians(lon - lon0)
    return false_e + r * F.sin(th), false_n + r0 - r * F.cos(th)


def from_lambert_conformal(x: Column, y: Column, lat0: float, lon0: float, lat1: float, lat2: float, false_e: float, false_n: float, name: str = "grs80", rounds: int = 6) -> tuple[Column, Column]:
    """C-07 inverse: the latitude by a fixed number of rounds of its contraction (to 1e-12)."""
    a, _, e2 = axes(name)
    e = math.sqrt(e2)
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    r0 = a * f * t(p0) ** n
    dx, dy = x - false_e, r0 - (y - false_n)
    tc = F.pow(F.sqrt(dx * dx + dy * dy) / (a * f), F.lit(1 / n))
    # tc goes through the state: a column named within the lambda would meet an alias of the same select before its input.
    step = lambda q: math.pi / 2 - 2 * F.atan(q["tc"] * F.pow((1 - e * F.sin(q["p"])) / (1 + e * F.sin(q["p"])), F.lit(e / 2)))
    start = F.struct((math.pi / 2 - 2 * F.atan(tc)).alias("p"), tc.alias("tc"))
    again = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda q, _: F.struct(step(q).alias("p"), q["tc"].alias("tc")), lambda q: q["p"])
    return F.degrees(again), lon0 + F.degrees(F.atan2(dx, dy) / n)


#: Centre, offset, forward and inverse coefficients and radius of a state plane given by polynomials (C-08).
MASSACHUSETTS = {"lat": 42.2006252872, "lon": -71.5, "east": 200_000.0, "north": 883_353.0384, "radius": 7_044_348.7021, "forward": (111073.2431, 9.71650, 5.63098, 0.021759), "inverse": (9.003068344e-6, -7.09026e-15, -3.69789e-20, -1.1855e-27)}


def _poly(x: Column, factors: tuple) -> Column:
    """The polynomial with these factors of x, x^2, ..."""
    total = F.lit(0.0)
    for f in reversed(factors):
        total = (total + f) * x
    return total


def state_plane(lat: Column, lon: Column, plane: dict = MASSACHUSETTS) -> tuple[Column, Column]:
    """C-08: easting and northing by the polynomial along the central meridian."""
    u = _poly(lat - plane["lat"], plane["forward"])
    turn = F.radians(plane["lon"] - lon) * math.sin(math.radians(plane["lat"]))
    e = (plane["radius"] - u) * F.sin(turn)
    return plane["east"] - e, plane["north"] + u + e * F.tan(turn / 2)


def from_state_plane(x: Column, y: Column, plane: dict = MASSACHUSETTS) -> tuple[Column, Column]:
    e, n = plane["east"] - x, y - plane["north"]
    turn = F.atan(e / (plane["radius"] - n))
    return plane["lat"] + _poly(n - e * F.tan(turn / 2), plane["inverse"]), plane["lon"] - F.degrees(turn) / math.sin(math.radians(plane["lat"]))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """G-05: distance of a point to a segment; to its point if it has no length (Q15)."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segment_intersection(a: tuple, b: tuple, c: tuple, d: tuple) -> tuple[Column, Column]:
    """G-04: where segments ab and cd meet; null if they don't or are parallel."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    det = F.nullif((bx - ax) * (dy - cy) - (by - ay) * (dx - cx), F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
    meet = t.between(0, 1) & u.between(0, 1)
    return F.when(meet, ax + t * (bx - ax)), F.when(meet, ay + t * (by - ay))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """G-07: even-odd rule with half-open edges (Q14), behind the bounding box, which reaches the scan as a filter."""
    xs, ys = zip(*polygon, strict=True)
    edges = zip(polygon, polygon[1:] + polygon[:1], strict=True)
    crossed = [((y < y1) != (y < y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) for (x1, y1), (x2, y2) in edges if y1 != y2]
    odd = F.lit(False)
    for c in crossed:
        odd = odd != c
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & odd


def signed_area(polygon: Column) -> Column:
    """G-06: shoelace sum of an array of (x, y) structs; positive if counter-clockwise."""
    n = F.size(polygon)
    i = F.sequence(F.lit(0), n - 1)
    term = lambda k: F.get(polygon, k)["x"] * F.get(polygon, F.pmod(k + 1, n))["y"] - F.get(polygon, F.pmod(k + 1, n))["x"] * F.get(polygon, k)["y"]
    return F.aggregate(i, F.lit(0.0), lambda s, k: s + term(k)) / 2


def rects_overlap(a: tuple, b: tuple) -> Column:
    """G-09, Q12: whether boxes (x0, y0, x1, y1) share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def linear_transform(x: Column, y: Column, scale: float, tx: float, ty: float) -> tuple[Column, Column]:
    """G-10."""
    return x * scale + tx, y * scale + ty


def rotate(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    """M-12."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return c * x - s * y, s * x + c * y
