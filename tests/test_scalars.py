"""Calendar, units, text, hashes, geodesy against published values and round trips."""

import functools
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as C
from tidemark.functions import geo as G
from tidemark.functions import text as X
from tidemark.functions import units as U


def val(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    return r[0] if len(cols) == 1 else tuple(r)


def test_murmur3_vectors():
    assert X.murmur3_32_bytes(b"") == 0
    assert X.murmur3_32_bytes(b"", 1) == 0x514E28B7
    assert X.murmur3_32_bytes(b"test") == 0xBA6BD213
    assert X.murmur3_32_bytes(b"Hello, world!") == 0xC0363E43
    assert X.murmur3_128_bytes(b"") == (0, 0)
    assert X.murmur3_128_bytes(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)


def test_digests(spark):
    t = F.lit("abc")
    assert val(spark, X.blake2(t, "b", 512)).startswith("ba80a53f981c4d0d")
    assert val(spark, X.blake2(t, "s", 256)).startswith("508c5e8c327c14e2")
    for key in (b"key", b"k" * 100):
        assert val(spark, X.hmac_sha256(F.lit("The quick brown fox"), key)) == hmac.new(key, b"The quick brown fox", "sha256").hexdigest()
    pieces = hashlib.sha256(b"abc").digest()  # the first byte of each piece is the lowest
    assert val(spark, X.fold_to_u64(F.lit(pieces.hex()))) % 2**64 == functools.reduce(int.__xor__, [int.from_bytes(pieces[i : i + 8], "little") for i in range(0, 32, 8)])


@pytest.mark.parametrize(("a", "b", "n"), [("kitten", "sitting", 3), ("", "abc", 3), ("é", "e", 2), ("flaw", "lawn", 2)])
def test_byte_levenshtein(spark, a, b, n):
    assert val(spark, X.byte_levenshtein(F.lit(a), F.lit(b))) == n


def test_match_score(spark):
    assert val(spark, X.match_score(F.lit("aab"), F.lit("abb"))) == 2 * 1 + 1 * 2


def test_addresses(spark):
    assert val(spark, X.parse_ipv4(F.lit("192.168.1.200")), X.parse_ipv4(F.lit("1.2.3.256")), X.parse_ipv4(F.lit("1.2.3"))) == (3232235976, None, None)
    assert val(spark, X.ipv4_text(F.lit(3232235976))) == "192.168.1.200"


def test_calendar(spark):
    d = F.to_date(F.lit("2021-01-03"))
    assert val(spark, *C.iso_week(d)) == (2020, 53, 7)
    assert val(spark, C.is_long(F.lit(2020)), C.is_long(F.lit(2021)), C.is_leap(F.lit(1900)), C.is_leap(F.lit(2000))) == (True, False, False, True)
    assert val(spark, C.julian(F.lit(946728000000000))) == 2451545.0
    assert val(spark, C.julian(F.lit(0), "modified")) == 40587.0
    assert val(spark, *C.gps_week(F.lit(315964800000000))) == (0, 0)
    assert val(spark, C.iso_duration(F.lit(93784000000))) == "P1DT2H3M4S"
    got = [val(spark, C.parse_iso_duration(F.lit(x))) for x in ("P1DT2H3M4S", "-PT1.5S", "P2W", "P", "x", "PT")]
    assert got == [93784.0, -1.5, 1209600.0, None, None, None]


def test_units(spark):
    assert val(spark, U.convert(F.lit(1.0), "length", "mi", "km")) == pytest.approx(1.609344)
    assert val(spark, U.convert(F.lit(1.0), "speed", "ft/s", "m/s")) == 0.3048
    assert val(spark, U.convert(F.lit(1000.0), "frequency", "Hz", "kHz")) == 1.0
    assert val(spark, U.from_kelvin(U.to_kelvin(F.lit(-40.0), "C"), "F")) == pytest.approx(-40.0)
    assert val(spark, U.normalize_degrees(F.lit(360.0)), U.angle_between(F.lit(350.0), F.lit(10.0))) == (0.0, 20.0)


def test_ecef_published_point(spark):
    x = val(spark, *G.to_ecef(F.lit(53.0 + 48 / 60 + 33.82 / 3600), F.lit(2 + 7 / 60 + 46.38 / 3600), F.lit(73.0)))
    assert x == pytest.approx((3771793.968, 140253.342, 5124304.349), abs=1e-3)
    assert val(spark, *G.from_ecef(*map(F.lit, x))) == pytest.approx((53.809394444, 2.129550, 73.0), abs=1e-4)


def test_tile_published_point(spark):
    x, y = val(spark, *G.tile(F.lit(24.846562), F.lit(-81.914), 10))
    assert (int(x), int(y)) == (279, 439)


def test_projections_round_trip(spark):
    x, y = val(spark, *G.transverse_mercator(F.lit(43.642567), F.lit(-79.387139), -81.0))
    assert (x, y) == pytest.approx((630084.3, 4833438.6), abs=1.0)  # UTM zone 17 place of a well-known tower
    assert val(spark, *G.from_transverse_mercator(F.lit(x), F.lit(y), -81.0)) == pytest.approx((43.642567, -79.387139), abs=1e-7)
    args = (41.0, -71.5, 41.716666666666667, 42.683333333333333, 200_000.0, 750_000.0)
    assert val(spark, *G.lambert_conformal(F.lit(41.0), F.lit(-71.5), *args)) == pytest.approx((200_000.0, 750_000.0), abs=1e-6)


def test_geometry(spark):
    z = F.lit(0.0)
    assert val(spark, G.segment_distance(F.lit(3.0), F.lit(4.0), z, z, z, z)) == 5.0
    assert val(spark, *G.segment_intersection((z, z), (F.lit(2.0), F.lit(2.0)), (z, F.lit(2.0)), (F.lit(2.0), z))) == (1.0, 1.0)
    assert val(spark, *G.segment_intersection((z, z), (F.lit(1.0), z), (z, F.lit(1.0)), (F.lit(1.0), F.lit(1.0)))) == (None, None)
    square = [(-4.0, -4.0), (-1.0, -4.0), (-1.0, -1.0), (-4.0, -1.0)]
    assert val(spark, G.in_polygon(F.lit(-2.0), F.lit(-2.0), square), G.in_polygon(F.lit(2.0), F.lit(-2.0), square)) == (True, False)
    bars = G.rects_overlap((F.lit(0), F.lit(4), F.lit(10), F.lit(6)), (F.lit(4), F.lit(0), F.lit(6), F.lit(10)))
    assert val(spark, bars) is True
