"""Physical units (M-20..M-28): one hop through a base unit, so every pair converts alike (Q16, Q17, Q18, Q34)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of each unit in the quantity's base unit.
FACTORS = {
    "length": {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.344, "nmi": 1852.0, "usft": 1200 / 3937},
    "speed": {"m/s": 1.0, "km/h": 1 / 3.6, "ft/s": 0.3048, "mph": 0.44704, "kn": 1852 / 3600},
    "frequency": {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9},
    "duration": {"ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0, "y": 31_557_600.0},
    "angle": {"rad": 1.0, "deg": math.pi / 180, "arcmin": math.pi / 10800, "arcsec": math.pi / 648000, "rev": 2 * math.pi, "mil": 2 * math.pi / 6400},
    "data": {"b": 1.0, "B": 8.0, "kB": 8e3, "MB": 8e6, "KiB": 8192.0, "MiB": 8388608.0},
    "drift": {"one": 1.0, "ppk": 1e-3, "ppm": 1e-6, "ppb": 1e-9, "ppt": 1e-12},
}
PREFIXES = ["y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y"]


def convert(v: Column, quantity: str, from_: str, to: str) -> Column:
    return v * FACTORS[quantity][from_] / FACTORS[quantity][to]


def to_kelvin(v: Column, scale: str) -> Column:
    return {"K": v, "C": v + 273.15, "F": (v + 459.67) * 5 / 9, "R": v * 5 / 9}[scale]


def from_kelvin(k: Column, scale: str) -> Column:
    return {"K": k, "C": k - 273.15, "F": k * 9 / 5 - 459.67, "R": k * 9 / 5}[scale]


def normalize_degrees(a: Column) -> Column:
    """Into [0, 360) (Q33)."""
    return F.pmod(a, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Signed smallest turn from a to b, in [-180, 180)."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def to_dms(a: Column) -> tuple[Column, Column, Column]:
    """Whole degrees (towards zero), minutes, seconds."""
    x = F.abs(a)
    d = F.floor(x)
    m = F.floor((x - d) * 60)
    return (F.signum(a) * d).cast("long"), m.cast("long"), ((x - d) * 60 - m) * 60


def si_prefix(v: Column) -> tuple[Column, Column]:
    """M-26: value and prefix by thousands, from yocto to yotta."""
    e = F.least(F.greatest(F.floor(F.log10(F.abs(v)) / 3), F.lit(-8)), F.lit(8))
    e = F.when(v == 0, F.lit(0)).otherwise(e).cast("int")
    return v / F.pow(F.lit(1000.0), e), F.element_at(F.array(*map(F.lit, PREFIXES)), e + 9)


def circle(radius: Column) -> dict[str, Column]:
    """M-28."""
    return {"diameter": 2 * radius, "circumference": 2 * math.pi * radius, "area": math.pi * radius * radius}


def ellipse(a: Column, b: Column) -> dict[str, Column]:
    """M-28, C-10: parameters of an ellipse of semi-axes a >= b."""
    e2 = 1 - (b * b) / (a * a)
    return {"flattening": (a - b) / a, "e2": e2, "second_e2": (a * a) / (b * b) - 1, "area": math.pi * a * b, "focus": F.sqrt(a * a - b * b)}


def cardinal(heading: Column, n: int = 8) -> Column:
    """M-25: name of the nearest of 8 compass points."""
    names = F.array(*map(F.lit, ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]))
    return F.element_at(names, (F.floor(F.pmod(heading + 22.5, F.lit(360.0)) / 45) + 1).cast("int"))


#: Names of units of quantities and their symbols (M-27).
SYMBOLS = {
    "Gram": "g", "Meter": "m", "SquareMeter": "m²", "CubicMeter": "m³", "MeterPerSecond": "m/s", "MeterPerSecondPerSecond": "m/s²", "Second": "s", "Mole": "mol", "Ampere": "A", "Kelvin": "K", "Candela": "cd",
    "Newton": "N", "Joule": "J", "Katal": "kat", "Coulomb": "C", "Celsius": "°C", "Lux": "lx", "Lumen": "lm", "Farad": "F", "Weber": "Wb", "Watt": "W", "Pascal": "Pa", "Gray": "Gy", "Becquerel": "Bq", "Henry": "H", "Volt": "V",
    "Ohm": "Ω", "Steradian": "sr", "Radian": "rad", "Siemens": "S", "Tesla": "T", "Hertz": "Hz", "Sievert": "Sv",
}


def lookup(key: Column, table: dict) -> Column:
    """T-19: the value of a small fixed table; null where the key isn't in it."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def quantity(v: Column, unit: Column) -> Column:
    """M-27: three decimals, prefix and symbol of a value. Zero, values beyond the prefixes and values in units of 1 have no prefix;
    an unknown unit or a null gives null."""
    x, p = si_prefix(v)
    size = F.abs(v)
    plain = (size == 0) | (size < 1e-24) | (size >= 1e27)
    return F.when(v.isNotNull(), F.concat(F.format_string("%.3f", F.when(plain, v).otherwise(x)), F.when(plain, "").otherwise(p), lookup(unit, SYMBOLS)))
