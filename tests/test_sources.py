"""Sources, graph and streaming operators."""

import sqlite3
import struct
import zlib
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import stateful as T
from tidemark.sources import binary, csv, geofiles, nmea, registry
from tidemark.streaming import transforms


def test_csv_quotes_comments_and_lines(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('# note\nh1,h2,h3\n1,"x, y","a ""q"" b"\n2,"two\nlines",\n')
    got = [tuple(r) for r in csv.read_csv(spark, str(p), "unix").collect()]
    assert got == [("1", "x, y", 'a "q" b'), ("2", "two\nlines", None)]
    raw = csv.read_csv(spark, str(p), "unix", raw_quotes=True, multi_line=False, schema="a string, b string", header=False)
    assert raw.columns == ["a", "b"]


def test_csv_wrong_width_is_an_error(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        csv.read_csv(spark, str(p), "unix", multi_line=False).collect()


def test_csv_pipe_write(spark, tmp_path):
    d = spark.createDataFrame([("a|b", None, 'q"q')], "x string, y string, z string")
    csv.write_csv(d, str(tmp_path / "o"), "pipe")
    assert [tuple(r) for r in csv.read_csv(spark, str(tmp_path / "o"), "pipe", comment=None, multi_line=False).collect()] == [("a|b", None, 'q"q')]


def test_gga_sentence(spark):
    line = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
    p = nmea.parsed(spark.createDataFrame([(line,), (line[:-2] + "48",), ("$PXYZ,1*00",)], "line string"))
    rows = nmea.gga(p).orderBy(F.desc("checksum_ok")).collect()
    assert [r.checksum_ok for r in rows] == [True, False] and p.count() == 3
    assert (rows[0].seconds, rows[0].quality, rows[0].satellites, rows[0].altitude) == (45319.0, "gps", 8, 545.4)
    assert (rows[0].lat, rows[0].lon) == pytest.approx((48.1173, 11.516667), abs=1e-6)


def test_gga_with_unknown_fields(spark):
    """Nulls are empty fields in their places, and read back as nulls."""
    none = F.lit(None).cast("double")
    line = nmea.build_gga(F.lit(3661), none, F.lit(-71.5), F.lit(None).cast("int"), F.lit(7), none, F.lit(12.0), F.lit(0.0))
    d = spark.range(1).select(line.alias("line"))
    assert d.collect()[0].line.split("*")[0] == "$GPGGA,010101.00,,,07130.00000,W,,07,,12.0,M,0.0,M,,"
    r = nmea.gga(nmea.parsed(d)).collect()[0]
    assert r.checksum_ok and (r.lat, r.lon, r.quality, r.satellites, r.hdop) == (None, -71.5, None, 7, None)


def test_rmc_gsa_gsv(spark):
    lines = [
        "$GPRMC,123519,A,4807.038,N,01131.000,W,022.4,084.4,230394,003.1,W*78", "$GPGSA,A,3,04,05,,09,12,,,24,,,,,2.5,1.3,2.1*39",
        "$GPGSV,2,1,08,01,40,083,46,02,17,308,41,12,07,344,39,14,22,228,45*75",
    ]
    p = nmea.parsed(spark.createDataFrame([(x,) for x in lines], "line string"))
    r = nmea.rmc(p).collect()[0]
    assert (r.valid, r.checksum_ok, str(r.date), r.knots) == (True, True, "2094-03-23", 22.4) and r.lon < 0
    assert nmea.gsa(p).collect()[0].satellites == [4, 5, 9, 12, 24]
    assert [x.id for x in nmea.gsv(p).collect()] == [1, 2, 12, 14]


def test_mixed_stream(spark):
    ubx = binary.ubx_frame(1, 2, struct.pack("<IiiiiII", 1, 85000000, 480000000, 3, 4, 5, 6))
    sirf = binary.sirf_frame(bytes([0x09]) + struct.pack(">HHHH", 1, 2, 3, 4))
    data = b"junk" + ubx + b"$GPGGA,1*7B\r\n" + sirf + ubx[:-1] + b"\x00" + b"\xb5\x62\x01"
    got = binary.frames(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")).orderBy("offset").collect()
    assert [(r.protocol, r.name, r.checksum_ok) for r in got] == [("ubx", "NAV-POSLLH", True), ("nmea", "GPGGA", False), ("sirf", "cpu-throughput", True), ("ubx", "NAV-POSLLH", False)]
    assert got[0].fields["lat"] == 480000000 and got[2].fields["ms"] == 4


def test_tiles_and_header(spark, tmp_path):
    p = str(tmp_path / "t.mbtiles")
    t = spark.createDataFrame([(1, 0, 0, bytearray(b"a")), (3, 1, 2, bytearray(b"a")), (3, 1, 3, bytearray(b"b"))], "zoom long, col long, row long, data binary")
    registry.write(t, "mbtiles", p)
    assert {tuple(r)[:3] for r in registry.read(spark, "mbtiles", p).collect()} == {(1, 0, 0), (3, 1, 2), (3, 1, 3)}
    assert {tuple(r) for r in geofiles.read_mbtiles(spark, p, "metadata").collect()} == {("minzoom", "1"), ("maxzoom", "3")}
    assert geofiles.dedup_tiles(t)[1].count() == 2
    assert registry.read(spark, "sqlite_header", p).collect()[0].page_size == 4096


def test_sonar_to_gpx(spark, tmp_path):
    p = str(tmp_path / "s.sdf")
    db = sqlite3.connect(p)
    db.execute("CREATE TABLE Tracks (trackId integer, name text)")
    db.execute("CREATE TABLE Subtracks (trackId integer, data blob)")
    db.execute("INSERT INTO Tracks VALUES (7, 'lake')")
    cols = [[1704067200.0, 1704067201.0], [0.0, 111319.49079327357], [0.0, 0.0], [3.5, 4.5]]
    db.execute("INSERT INTO Subtracks VALUES (7, ?)", (zlib.compress(b"".join(struct.pack("<2d", *c) for c in cols)),))
    db.commit()
    db.close()
    (f,) = geofiles.sonar_to_gpx(spark, p, str(tmp_path))
    got = geofiles.read_gpx(spark, f).orderBy("time").collect()
    assert [(round(r.lon, 6), r.ele, r.time) for r in got] == [(0.0, -3.5, "2024-01-01T00:00:00Z"), (1.0, -4.5, "2024-01-01T00:00:01Z")]


def test_influx_answer():
    a = '{"results":[{"series":[{"name":"cpu","columns":["time","v"],"values":[[1,2.5]]}]}]}'
    assert registry.influx_series(a) == [("cpu", ["time", "v"], [[1, 2.5]])]
    with pytest.raises(ValueError):
        registry.influx_series('{"results":[{"error":"bad"}]}')


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b", True, 1.0), ("b", "c", True, 1.0), ("a", "c", True, 5.0), ("c", "d", False, 2.0), ("e", "e", True, 1.0), ("c", "a", True, 1.0)], "src string, dst string, directed boolean, cost double")


def test_bfs_with_cycles(spark, edges):
    got = {r.id: (r.level, r.path) for r in G.bfs(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (1, ["a", "c"]), "d": (2, ["a", "c", "d"])}


def test_shortest_paths(spark, edges):
    got = {(r.src, r.dst): (r.cost, r.hop) for r in G.shortest_paths(edges, spark.createDataFrame([("a",), ("d",)], "id string")).collect()}
    assert got[("a", "d")] == (4.0, "b") and got[("d", "b")] == (4.0, "c") and got[("a", "c")] == (2.0, "b")
    with pytest.raises(ValueError):
        G.shortest_paths(edges.withColumn("cost", -F.col("cost")), spark.createDataFrame([("a",)], "id string"))


def test_force_layout_repeats():
    a = G.force_layout(["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert a == G.force_layout(["a", "b", "c"], [("a", "b"), ("b", "c")])
    assert sum(x for x, _ in a.values()) == pytest.approx(0, abs=1e-9)


def _events(spark, tmp_path):
    rows = [(f"u{i % 3}", i * 1_000_000, float(i % 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "k string, us long, v double")
    d.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "e"))
    return d, spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "e"))


def _drain(q):
    q.processAllAvailable()
    q.stop()


def test_streaming_filter_equals_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    step = partial(T.alpha_beta_step, alpha=0.5, beta=0.1)
    s = transforms.folded(stream, "k", "us", "v", step, T.AB, "us long, x double, dx double")
    _drain(s.writeStream.format("memory").queryName("ab").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start())
    want = sorted(map(tuple, T.folded(batch, "k", "us", "v", step, T.AB).collect()))
    assert sorted(map(tuple, spark.table("ab").collect())) == want


def test_streaming_bins_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    s = transforms.binned(stream.withColumn("ts", F.timestamp_micros("us")), ["k"], "ts", "v", "10 seconds", "1 minute")
    _drain(s.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start())
    got = {(r.k, r.start.timestamp(), r.n, round(r.mean, 9)) for r in spark.table("bins").collect()}
    b = batch.groupBy("k", (F.floor(F.col("us") / 10_000_000) * 10).alias("s")).agg(F.count("*").alias("n"), F.avg("v").alias("m")).collect()
    assert {(k, n, m) for k, _, n, m in got} == {(r.k, r.n, round(r.m, 9)) for r in b}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_gns(spark):
    text = "GNGNS,014035.00,4332.69262,S,17235.48549,E,RRX,13,0.9,25.63,11.24,1.5,0031,S"
    lines = spark.createDataFrame([(text,), ("GPGNS,,,,,,,,,,,,",)], "t string").select(nmea.sentence(F.col("t")).alias("line"))
    got = sorted(nmea.gns(nmea.parsed(lines)).collect(), key=lambda r: r.system)
    none, r = got
    assert r.checksum_ok and r.system == "multi" and r.modes == ["rtk_integer", "rtk_integer", "unknown"] and r.status == "safe" and r.station == "0031"
    assert r.lat == pytest.approx(-(43 + 32.69262 / 60)) and r.lon == pytest.approx(172 + 35.48549 / 60) and (r.satellites, r.hdop, r.altitude, r.geoid, r.age) == (13, 0.9, 25.63, 11.24, 1.5)
    assert none.system == "gps" and none.modes == [] and none.lat is None and none.status is None


def test_influx_catalogue(spark):
    import http.server
    import threading
    import urllib.parse

    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            asked.append((q.get("q"), self.headers.get("Accept")))
            ping = self.path.startswith("/ping")
            self.send_response(204 if ping else 200)
            self.end_headers()
            if not ping:
                self.wfile.write(b"name,tags,v\ncpu,,1\n" if self.headers.get("Accept") == "application/csv" else b'{"results":[{"series":[{"name":"cpu","columns":["k","v"],"values":[["a",2.5],["b","x"]]}]}]}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        assert registry.influx_ping(url) and registry.influx_csv(url, "SELECT 1").startswith("name,")
        d = registry.influx_typed(registry.influx_catalogue(spark, url, "field_keys", "my db"), {"k": "string", "v": "float"})
        assert sorted((r.name, r.k, r.v) for r in d.collect()) == [("cpu", "a", 2.5), ("cpu", "b", None)]
    finally:
        server.shutdown()
    assert ([q for q, _ in asked if q])[-1] == ['SHOW FIELD KEYS ON "my db"']
