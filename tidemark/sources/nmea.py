"""NMEA 0183 sentences as text columns: framing, checksum, parsing and building (IO-20..IO-27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import xor_checksum

QUALITY = {0: "invalid", 1: "gps", 2: "dgps", 3: "pps", 4: "rtk", 5: "float_rtk", 6: "estimated", 7: "manual", 8: "simulation"}


#: Codes of GNS sentences (IO-25): fix mode of each system, navigational status, system of the talker.
MODE = {"A": "autonomous", "D": "differential", "E": "estimated", "F": "rtk_float", "M": "manual", "N": "no_fix", "P": "precise", "R": "rtk_integer", "S": "simulator", "V": "valid"}
STATUS = {"S": "safe", "C": "caution", "U": "unsafe", "V": "not_valid"}
SYSTEMS = {"GN": "multi", "GP": "gps", "GL": "glonass", "GA": "galileo", "GB": "beidou", "BD": "beidou", "GQ": "qzss", "QZ": "qzss"}


def body(line: Column) -> Column:
    return F.regexp_extract(line, r"\$([^*\r\n]*)", 1)


def checksum(text: Column) -> Column:
    """IO-22: two hex digits."""
    return F.lpad(F.hex(xor_checksum(text)), 2, "0")


def sentence(text: Column) -> Column:
    return F.concat(F.lit("$"), text, F.lit("*"), checksum(text))


def degrees(value: Column, half: Column) -> Column:
    """IO-23: ddmm.mmmm and hemisphere to signed degrees."""
    v = value.try_cast("double")
    return (F.floor(v / 100) + (v - F.floor(v / 100) * 100) / 60) * F.when(half.isin("S", "W"), -1).otherwise(1)


def filled(form: str, *values: Column) -> Column:
    """Values in a format; null, an empty field of a sentence, if one of them is null."""
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return F.when(known, F.format_string(form, *values))


def to_degrees_minutes(v: Column, digits: int) -> Column:
    """Degrees to ddmm.mmmmm with so many digits of degrees; hundred-thousandths of minutes are rounded first, so that 60 never appears."""
    units = F.round(F.abs(v) * 6_000_000).cast("long")
    return filled(f"%0{digits}d%02d.%05d", F.floor(units / 6_000_000).cast("long"), F.floor(units / 100_000).cast("long") % 60, units % 100_000)


def day_seconds(value: Column) -> Column:
    """hhmmss.s to seconds of the day."""
    v = value.try_cast("double")
    h, m = F.floor(v / 10000), F.floor(v / 100) % 100
    return h * 3600 + m * 60 + (v - h * 10000 - m * 100)


def build_gga(seconds: Column, lat: Column, lon: Column, quality: Column, satellites: Column, hdop: Column, altitude: Column, geoid: Column) -> Column:
    """A GGA sentence; a null is an empty field."""
    s = seconds.cast("long")
    time = filled("%02d%02d%02d.00", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
    lat_half, lon_half = F.when(lat < 0, "S").when(lat >= 0, "N"), F.when(lon < 0, "W").when(lon >= 0, "E")
    fields = [F.lit("GPGGA"), time, to_degrees_minutes(lat, 2), lat_half, to_degrees_minutes(lon, 3), lon_half, quality.cast("string"), F.lpad(satellites.cast("string"), 2, "0"), filled("%.1f", hdop), filled("%.1f", altitude), F.lit("M"), filled("%.1f", geoid), F.lit("M"), F.lit(""), F.lit("")]
    return sentence(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]))


def build_command(kind: str, *fields: Column) -> Column:
    """IO-26: command sentences such as rate control."""
    return sentence(F.concat_ws(",", F.lit(kind), *[f.cast("string") for f in fields]))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """IO-20, IO-21: adds talker, kind, fields and checksum_ok (Q26); unknown kinds are kept."""
    text = body(F.col(line))
    said = F.upper(F.regexp_extract(F.col(line), r"\*([0-9A-Fa-f]{2})", 1))
    first = F.element_at(F.split(text, ","), 1)
    return lines.withColumn("fields", F.split(text, ",")).withColumn("talker", F.substring(first, 1, 2)).withColumn("kind", F.substring(first, 3, 10)).withColumn("checksum_ok", said == checksum(text))


def _field(i: int) -> Column:
    return F.nullif(F.get("fields", F.lit(i)), F.lit(""))


def _name(code: Column, names: dict) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.get(F.array(table), F.lit(0))[code]


def gga(p: DataFrame) -> DataFrame:
    """IO-24, IO-25."""
    return p.where("kind = 'GGA'").select(
        "*", day_seconds(_field(1)).alias("seconds"), degrees(_field(2), _field(3)).alias("lat"), degrees(_field(4), _field(5)).alias("lon"), _name(_field(6).try_cast("int"), QUALITY).alias("quality"),
        _field(7).try_cast("int").alias("satellites"), _field(8).try_cast("double").alias("hdop"), _field(9).try_cast("double").alias("altitude"), _field(11).try_cast("double").alias("geoid"),
    )


def gns(p: DataFrame) -> DataFrame:
    """IO-24, IO-25: a fix of several systems; modes holds the mode of GPS, GLONASS, Galileo, BeiDou and QZSS, as far as given; an unknown letter is unknown."""
    letters = F.filter(F.split(F.coalesce(_field(6), F.lit("")), ""), lambda c: c != "")
    status = F.substring(_field(13), 1, 1)
    return p.where("kind = 'GNS'").select(
        "*", F.coalesce(_name(F.col("talker"), SYSTEMS), F.lit("unknown")).alias("system"), day_seconds(_field(1)).alias("seconds"), degrees(_field(2), _field(3)).alias("lat"), degrees(_field(4), _field(5)).alias("lon"),
        F.transform(letters, lambda c: F.coalesce(_name(c, MODE), F.lit("unknown"))).alias("modes"), _field(7).try_cast("int").alias("satellites"), _field(8).try_cast("double").alias("hdop"), _field(9).try_cast("double").alias("altitude"), _field(10).try_cast("double").alias("geoid"),
        _field(11).try_cast("double").alias("age"), _field(12).alias("station"), F.when(status.isNotNull(), F.coalesce(_name(status, STATUS), F.lit("unknown"))).alias("status"),
    )


def rmc(p: DataFrame) -> DataFrame:
    """IO-24: position, speed in knots, track and date (two-digit years are of this century, Q26)."""
    d = _field(9)
    date = F.make_date(F.substring(d, 5, 2).try_cast("int") + 2000, F.substring(d, 3, 2).try_cast("int"), F.substring(d, 1, 2).try_cast("int"))
    return p.where("kind = 'RMC'").select("*", day_seconds(_field(1)).alias("seconds"), (_field(2) == "A").alias("valid"), degrees(_field(3), _field(4)).alias("lat"), degrees(_field(5), _field(6)).alias("lon"), _field(7).try_cast("double").alias("knots"), _field(8).try_cast("double").alias("track"), date.alias("date"))


def gsa(p: DataFrame) -> DataFrame:
    sats = F.filter(F.transform(F.slice("fields", 4, 12), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return p.where("kind = 'GSA'").select("*", _field(1).alias("mode"), _field(2).try_cast("int").alias("fix"), sats.alias("satellites"), _field(15).try_cast("double").alias("pdop"), _field(16).try_cast("double").alias("hdop"), _field(17).try_cast("double").alias("vdop"))


def gsv(p: DataFrame) -> DataFrame:
    """A row for each satellite in view."""
    four = F.array(*[F.struct(F.get("fields", F.lit(4 + 4 * i)).try_cast("int").alias("id"), F.get("fields", F.lit(5 + 4 * i)).try_cast("int").alias("elevation"), F.get("fields", F.lit(6 + 4 * i)).try_cast("int").alias("azimuth"), F.get("fields", F.lit(7 + 4 * i)).try_cast("int").alias("snr")) for i in range(4)])
    return p.where("kind = 'GSV'").select("*", F.explode(F.filter(four, lambda s: s["id"].isNotNull())).alias("s")).select("*", "s.*").drop("s")


def zda_time(p: DataFrame) -> Column:
    """Unix seconds of a ZDA sentence; null for other kinds."""
    t = day_seconds(_field(1)) + F.unix_date(F.make_date(_field(4).try_cast("int"), _field(3).try_cast("int"), _field(2).try_cast("int"))) * 86400
    return F.when(F.col("kind") == "ZDA", t)


def fixes(p: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """IO-27, J-02: each GGA with the latest ZDA before it in its stream."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return gga(p.withColumn("zda", F.last(zda_time(p), ignorenulls=True).over(w)))
