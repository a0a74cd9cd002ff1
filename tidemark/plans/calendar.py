"""Queries on calendar, epochs and units (D-*, M-2x)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import units as U
from tidemark.plans.common import micros, r6, read


def iso_calendar(spark, sf_dir):
    """D-01..D-07, D-17, Q32, Q36."""
    d = F.col("o_orderdate").cast("date")
    y, w, k = C.iso_week(d)
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), C.day_of_year(d).alias("doy"), (k - 1).alias("weekday"),
        F.format_string("%04d-W%02d-%d", y, w, k).alias("iso"), C.is_leap(F.year(d)).alias("leap"), C.is_long(y).alias("long"), C.days_in_year(F.year(d)).alias("days"),
        F.dayofmonth(F.last_day(d)).alias("month_days"), (F.dayofyear(F.trunc(d, "month")) - 1).alias("month_start"),
    )


def date_arithmetic(spark, sf_dir):
    """D-01, D-03, D-08, D-13, D-14."""
    d = F.col("l_shipdate").cast("date")
    e = F.make_date(F.lit(2000), F.lit(2), F.lit(29))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format(F.date_add(d, 45), "yyyy-MM-dd").alias("later"), F.date_format(F.add_months(d, 12), "yyyy-MM-dd").alias("next_year"),
        F.datediff(d, e).alias("days"), F.date_format(C.from_year_day(F.year(d), F.lit(59)), "yyyy-MM-dd").alias("day59"), (micros(F.col("l_shipdate")) - 951782400000000).alias("us"),
    )


def julian_dates(spark, sf_dir):
    """D-15, Q35."""
    us = micros(F.col("o_orderdate"))
    return read(spark, sf_dir, "orders").select("o_orderkey", *[r6(C.julian(us, k), k) for k in C.JULIAN_OFFSETS], (C.from_julian(C.julian(us)) - us).alias("back"))


def epochs(spark, sf_dir):
    """D-11, D-12, D-22."""
    d = read(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
    week, tow = C.gps_week(F.col("us"))
    return d.select("event_id", *[C.since_epoch(F.col("us"), k).alias(k) for k in C.EPOCH_DAYS], week.alias("gps_week"), tow.alias("gps_tow"), C.fixed32(F.col("us")).alias("fixed"))


def time_of_day(spark, sf_dir):
    """D-10, D-16, D-20."""
    d = read(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")))
    h, m, s, u = C.hms(F.col("us"))
    return d.select("event_id", h.alias("h"), m.alias("m"), s.alias("s"), u.alias("u"), F.date_format("ts", "yyyyMMdd'T'HHmmss").alias("basic"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("extended"))


def iso_parse(spark, sf_dir):
    """D-16: basic and extended forms read back to the same time."""
    d = read(spark, sf_dir, "events")
    basic, extended = F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    both = [F.to_timestamp_ntz(basic, F.lit("yyyyMMdd'T'HHmmss")), F.to_timestamp_ntz(extended, F.lit("yyyy-MM-dd'T'HH:mm:ss"))]
    return d.select("event_id", *[F.floor(micros(c) / 1_000_000).cast("long").alias(n) for n, c in zip(("basic", "extended"), both, strict=True)])


def iso_duration(spark, sf_dir):
    """D-18, D-19: durations since 2024 written and read back."""
    d = read(spark, sf_dir, "events").withColumn("us", micros(F.col("ts")) - 1704067200000000)
    return d.withColumn("iso", C.iso_duration(F.col("us"))).select("event_id", "iso", C.parse_iso_duration(F.col("iso")).cast("long").alias("seconds"))


def unit_conversions(spark, sf_dir):
    """M-20..M-24."""
    q = F.col("l_quantity")
    pairs = [("length", "ft", "km"), ("length", "mi", "nmi"), ("length", "usft", "m"), ("speed", "ft/s", "km/h"), ("speed", "kn", "mph"), ("frequency", "Hz", "kHz"), ("angle", "arcmin", "deg"), ("angle", "rev", "mil"), ("data", "MiB", "MB"), ("duration", "h", "d"), ("drift", "ppm", "ppb")]
    cols = [r6(U.convert(q, k, a, b), f"{a}_{b}".replace("/", ""), 9) for k, a, b in pairs]
    kelvin = U.to_kelvin(q, "C")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols, *[r6(U.from_kelvin(kelvin, s), f"c_to_{s.lower()}", 6) for s in "FKR"])


def _unit_sql():
    pairs = [("length", "ft", "km"), ("length", "mi", "nmi"), ("length", "usft", "m"), ("speed", "ft/s", "km/h"), ("speed", "kn", "mph"), ("frequency", "Hz", "kHz"), ("angle", "arcmin", "deg"), ("angle", "rev", "mil"), ("data", "MiB", "MB"), ("duration", "h", "d"), ("drift", "ppm", "ppb")]
    cols = [f"round(l_quantity * {U.FACTORS[k][a]!r}::DOUBLE / {U.FACTORS[k][b]!r}::DOUBLE, 9) AS {a}_{b}".replace("ft/s", "fts").replace("km/h", "kmh") for k, a, b in pairs]
    cols = [c.replace("m/s", "ms") if "AS m/s" in c else c for c in cols]
    k = "(l_quantity + 273.15)"
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cols)}, round({k} * 9 / 5 - 459.67, 6) AS c_to_f, round({k}, 6) AS c_to_k, round({k} * 9 / 5, 6) AS c_to_r FROM lineitem"


def compass(spark, sf_dir):
    """M-22, M-25."""
    a = (F.col("l_partkey") * 37.5 % 900) - 270
    b = F.col("l_suppkey") * 11.25
    d, m, s = U.to_dms(a / 7)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", U.normalize_degrees(a).alias("heading"), U.angle_between(a, b).alias("turn"), U.cardinal(a).alias("name"), d.alias("deg"), m.alias("min"), r6(s, "sec", 4))


def si_prefixes(spark, sf_dir):
    """M-26."""
    v = F.col("o_totalprice") * F.col("o_orderkey") / 7
    x, p = U.si_prefix(v)
    return read(spark, sf_dir, "orders").select("o_orderkey", r6(x + 1e-9, "value"), p.alias("prefix"))


def shapes(spark, sf_dir):
    """M-28, C-10."""
    r = F.col("p_size").cast("double")
    c, e = U.circle(r), U.ellipse(r + 1, r)
    return read(spark, sf_dir, "part").select("p_partkey", *[r6(x, n) for n, x in c.items()], *[r6(x, f"e_{n}") for n, x in e.items()])


_EP = ", ".join(f"(epoch_us(ts) // 1000000 - {d} * 86400::BIGINT) AS {k}" for k, d in C.EPOCH_DAYS.items())
QUERIES = {
    "iso_calendar": (iso_calendar, """SELECT o_orderkey, year(o)::INT AS y, month(o)::INT AS m, day(o)::INT AS d, (dayofyear(o) - 1)::INT AS doy, (isodow(o) - 1)::INT AS weekday, strftime(o, '%G-W%V-%u') AS iso,
        (year(o) % 4 = 0 AND (year(o) % 100 <> 0 OR year(o) % 400 = 0)) AS leap, weekofyear(make_date(isoyear(o), 12, 28)) = 53 AS long,
        (dayofyear(make_date(year(o), 12, 31)))::INT AS days, day(last_day(o))::INT AS month_days, (dayofyear(date_trunc('month', o)) - 1)::INT AS month_start FROM (SELECT o_orderkey, o_orderdate::DATE AS o FROM orders)"""),
    "date_arithmetic": (date_arithmetic, """SELECT l_orderkey, l_linenumber, strftime(d + 45, '%Y-%m-%d') AS later, strftime(d + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year, (d - DATE '2000-02-29')::INT AS days,
        strftime(make_date(year(d), 1, 1) + 59, '%Y-%m-%d') AS day59, epoch_us(l_shipdate) - 951782400000000 AS us FROM (SELECT *, l_shipdate::DATE AS d FROM lineitem)"""),
    "julian_dates": (julian_dates, "SELECT o_orderkey, " + ", ".join(f"round(epoch_us(o_orderdate) / 8.64e10 + 2440587.5 - {v}, 6) AS {k}" for k, v in C.JULIAN_OFFSETS.items()) + ", 0::BIGINT AS back FROM orders"),
    "epochs": (epochs, f"SELECT event_id, {_EP}, (epoch_us(ts) // 1000000 - 3657 * 86400::BIGINT) // 604800 AS gps_week, (epoch_us(ts) // 1000000 - 3657 * 86400::BIGINT) % 604800 AS gps_tow, ((epoch_us(ts) // 1000000) << 32) + ((epoch_us(ts) % 1000000) * 4294967296 // 1000000) AS fixed FROM events"),
    "time_of_day": (time_of_day, "SELECT event_id, hour(ts) AS h, minute(ts) AS m, (epoch_us(ts) // 1000000) % 60 AS s, epoch_us(ts) % 1000000 AS u, strftime(ts, '%Y%m%dT%H%M%S') AS basic, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS extended FROM events"),
    "iso_parse": (iso_parse, "SELECT event_id, epoch_us(ts) // 1000000 AS basic, epoch_us(ts) // 1000000 AS extended FROM events"),
    "iso_duration": (iso_duration, "SELECT event_id, 'P' || (s // 86400) || 'DT' || (s // 3600 % 24) || 'H' || (s // 60 % 60) || 'M' || (s % 60) || 'S' AS iso, s AS seconds FROM (SELECT event_id, (epoch_us(ts) - 1704067200000000) // 1000000 AS s FROM events)"),
    "unit_conversions": (unit_conversions, _unit_sql()),
    "compass": (compass, """SELECT l_orderkey, l_linenumber, ((a % 360) + 360) % 360 AS heading, (((b - a + 180) % 360) + 360) % 360 - 180 AS turn,
        (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[1 + floor((((a + 22.5) % 360) + 360) % 360 / 45)::INT] AS name,
        (sign(a) * floor(x))::BIGINT AS deg, floor((x - floor(x)) * 60)::BIGINT AS min, round(((x - floor(x)) * 60 - floor((x - floor(x)) * 60)) * 60, 4) AS sec
        FROM (SELECT *, abs(a / 7) AS x FROM (SELECT l_orderkey, l_linenumber, ((l_partkey * 37.5::DOUBLE) % 900) - 270 AS a, l_suppkey * 11.25::DOUBLE AS b FROM lineitem))"""),
    "si_prefixes": (si_prefixes, "SELECT o_orderkey, round(v / pow(1000.0, e) + 1e-9, 6) AS value, (['y', 'z', 'a', 'f', 'p', 'n', 'µ', 'm', '', 'k', 'M', 'G', 'T', 'P', 'E', 'Z', 'Y'])[e::INT + 9] AS prefix FROM (SELECT o_orderkey, v, CASE WHEN v = 0 THEN 0 ELSE least(greatest(floor(log10(abs(v)) / 3), -8), 8) END AS e FROM (SELECT o_orderkey, o_totalprice * o_orderkey / 7 AS v FROM orders))"),
    "shapes": (shapes, """SELECT p_partkey, round(2 * r, 6) AS diameter, round(2 * pi() * r, 6) AS circumference, round(pi() * r * r, 6) AS area, round((a - r) / a, 6) AS e_flattening, round(1 - (r * r) / (a * a), 6) AS e_e2,
        round((a * a) / (r * r) - 1, 6) AS e_second_e2, round(pi() * a * r, 6) AS e_area, round(sqrt(a * a - r * r), 6) AS e_focus FROM (SELECT p_partkey, p_size::DOUBLE AS r, p_size::DOUBLE + 1 AS a FROM part)"""),
}
