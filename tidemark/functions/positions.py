"""Positions as structs: altitudes in a frame of reference, kinds of fixes, dilutions of precision, bundles of positions (C-14..C-16, T-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.units import lookup

#: Frames of reference of altitudes and their short names (C-14).
FRAMES = {"Unspecified": "UNK", "Ellipsoid": "ELL", "Geoid": "MSL", "Terrain": "AGL", "Geocentric": "GEO", "SurfaceFeatures": "MSA", "PressureAltitude": "PA", "IndicatedAltitude": "IA", "DensityAltitude": "DA"}
#: Kinds of fixes by code; any other code is unknown (C-15).
FIXES = {1: "NoFix", 2: "TwoDim", 3: "ThreeDim"}


def altitude(metres: Column, frame: Column) -> Column:
    """C-14: (value, frame, short); a frame that isn't listed is unspecified."""
    short = lookup(frame, FRAMES)
    return F.struct(metres.cast("double").alias("value"), F.when(short.isNull(), "Unspecified").otherwise(frame).alias("frame"), F.coalesce(short, F.lit(FRAMES["Unspecified"])).alias("short"))


def ellipsoidal(alt: Column, undulation: Column) -> Column:
    """C-14: metres above the ellipsoid of an altitude above it or above the geoid, which lies `undulation` above the ellipsoid; null in
    frames that need more than that."""
    return F.when(alt["frame"] == "Ellipsoid", alt["value"]).when(alt["frame"] == "Geoid", alt["value"] + undulation)


def fix_type(code: Column) -> Column:
    return F.coalesce(lookup(code.cast("int"), FIXES), F.lit("Unknown"))


def dops(horizontal: Column, vertical: Column, time: Column) -> Column:
    """C-15: dilutions of precision; those of position and geometry from their parts, null where a part is."""
    position = F.sqrt(horizontal * horizontal + vertical * vertical)
    return F.struct(horizontal.alias("h"), vertical.alias("v"), position.alias("p"), F.sqrt(horizontal * horizontal + vertical * vertical + time * time).alias("g"), time.alias("t"))


def dops_text(d: Column) -> Column:
    """Three decimals each, `?` for null."""
    part = lambda k: F.concat(F.lit(f"{k}dop: "), F.when(d[k].isNull(), "?").otherwise(F.format_string("%.3f", d[k])))
    return F.concat_ws(" ", *map(part, "hvpgt"))


def positions(lat: Column, lon: Column, h: Column, base: tuple[float, float]) -> Column:
    """C-16: one place as (ecef, latlon, enu, ned); the local ones are about the base (lat, lon) on the ellipsoid, ned the same axes as enu in
    the order north, east, down."""
    place = geo.to_ecef(lat, lon, h)
    origin = geo.to_ecef(F.lit(base[0]), F.lit(base[1]), F.lit(0.0))
    e, n, u = geo.to_enu(tuple(a - b for a, b in zip(place, origin, strict=True)), *base)
    triple = lambda names, values: F.struct(*[v.alias(k) for k, v in zip(names, values, strict=True)])
    return F.struct(triple("xyz", place).alias("ecef"), triple(("lat", "lon", "h"), (lat, lon, h)).alias("latlon"), triple("enu", (e, n, u)).alias("enu"), triple("ned", (n, e, -u)).alias("ned"))


def country_codes(rows: DataFrame, name: str, code: str) -> DataFrame:
    """T-20: (country, code) of a table of countries, given as a parameter: quotes taken off the names, the last code in code order of a
    repeated name, rows without a name dropped."""
    clean = F.replace(F.col(name), F.lit('"'), F.lit(""))
    return rows.where(F.col(name).isNotNull()).groupBy(clean.alias("country")).agg(F.max(F.col(code)).alias("code"))
