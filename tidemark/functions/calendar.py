"""Calendar, epochs and Julian dates as column expressions (D-*). Times are Unix microseconds or dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Unix day number of each epoch's first day.
EPOCH_DAYS = {"unix": 0, "gps": 3657, "gregorian": -141427, "windows_nt": -134774, "common_era": -719162, "prime": -25567, "ntp": -25567, "leapoch": 11017, "y2k": 10957, "vicinti": 18262}
#: Julian date at which each day count begins.
JULIAN_OFFSETS = {"julian": 0.0, "reduced": 2400000.0, "modified": 2400000.5, "truncated": 2440000.5, "lilian": 2299159.5, "rata_die": 1721424.5, "prime": 2415020.5, "mjd2000": 2451544.5, "unix": 2440587.5}


def from_year_day(year: Column, day_of_year: Column) -> Column:
    """D-01: date of a year and a day of it from 0."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day_of_year)


def day_of_year(d: Column) -> Column:
    """D-02: from 0."""
    return F.dayofyear(d) - 1


def is_leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def is_long(year: Column) -> Column:
    """D-06: whether the ISO year has 53 weeks: one that ends on a Thursday, or whose predecessor ends on a Wednesday."""
    ends = lambda y: F.pmod(y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400), F.lit(7))
    return (ends(year) == 4) | (ends(year - 1) == 3)


def days_in_year(year: Column) -> Column:
    return F.when(is_leap(year), 366).otherwise(365)


def iso_week(d: Column) -> tuple[Column, Column, Column]:
    """D-05, D-17: ISO year (that of the week's Thursday), week, weekday from 1 for Monday."""
    weekday = F.weekday(d) + 1
    return F.year(F.date_add(d, 4 - weekday)), F.weekofyear(d), weekday


def since_epoch(us: Column, epoch: str) -> Column:
    """D-12: whole seconds since another epoch."""
    return F.floor(us / 1_000_000).cast("long") - EPOCH_DAYS[epoch] * 86400


def julian(us: Column, kind: str = "julian") -> Column:
    """D-15 (Q35: the true offset of the Unix epoch)."""
    return us / float(DAY_US) + 2440587.5 - JULIAN_OFFSETS[kind]


def from_julian(jd: Column) -> Column:
    return F.round((jd - 2440587.5) * DAY_US).cast("long")


def gps_week(us: Column) -> tuple[Column, Column]:
    """D-22: week and second of the week, without leap seconds."""
    s = since_epoch(us, "gps")
    return F.floor(s / 604800).cast("long"), F.pmod(s, F.lit(604800))


def iso_duration(us: Column) -> Column:
    """D-18: PnDTnHnMnS of a non-negative duration in microseconds."""
    s = F.floor(us / 1_000_000).cast("long")
    return F.when(s.isNotNull(), F.format_string("P%dDT%dH%dM%dS", F.floor(s / 86400).cast("long"), F.floor(s / 3600).cast("long") % 24, F.floor(s / 60).cast("long") % 60, s % 60))


def parse_iso_duration(text: Column) -> Column:
    """D-19: seconds of PnYnMnWnDTnHnMnS with years of 365 and months of 30 days; null if it is none."""
    pattern = r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit("999999999.999999")).cast("double"), F.lit(0.0))
    size = (31_536_000, 2_592_000, 604_800, 86_400, 3_600, 60, 1)
    total = sum((part(i + 2) * n for i, n in enumerate(size)), F.lit(0.0))
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1.0).otherwise(1.0)
    return F.when(text.rlike(pattern) & text.rlike(r"\d"), sign * total)


def hms(us: Column) -> tuple[Column, Column, Column, Column]:
    """D-10: hour, minute, second and microsecond of the day."""
    u = F.pmod(us, F.lit(DAY_US))
    s = F.floor(u / 1_000_000).cast("long")
    return F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, F.pmod(u, F.lit(1_000_000))


def fixed32(us: Column) -> Column:
    """D-11, M-06: seconds as 32.32 fixed point, the fraction truncated."""
    s = F.floor(us / 1_000_000).cast("long")
    return F.shiftleft(s, 32) + F.floor(F.pmod(us, F.lit(1_000_000)) * 4294967296 / 1_000_000).cast("long")
