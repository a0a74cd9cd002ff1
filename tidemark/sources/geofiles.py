"""GPX, tile packages, sonar recordings, DOT graphs, position reports (IO-10..IO-12, IO-34, IO-40..IO-54, IO-68)."""

from __future__ import annotations

import os
import sqlite3
import struct
import zlib
from functools import reduce
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "`_lat` double, `_lon` double, ele double, time string, name string, fix string, sat int, hdop double"


def read_gpx(spark: SparkSession, path: str, kind: str = "trkpt") -> DataFrame:
    """IO-10, IO-11: waypoints (wpt), route (rtept) or track points (trkpt) of GPX 1.1 files."""
    d = spark.read.format("xml").option("rowTag", kind).schema(POINT).load(path)
    return d.withColumnRenamed("_lat", "lat").withColumnRenamed("_lon", "lon")


def gpx_point(kind: str) -> Column:
    ele = F.coalesce(F.concat(F.lit("<ele>"), F.col("ele").cast("string"), F.lit("</ele>")), F.lit(""))
    time = F.coalesce(F.concat(F.lit("<time>"), F.col("time"), F.lit("</time>")), F.lit(""))
    return F.concat(F.lit(f'<{kind} lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), ele, time, F.lit(f"</{kind}>"))


def write_gpx(points: DataFrame, path: str, order: str, name: str = "track") -> None:
    """IO-12: one GPX document on the driver's file system with one track; points stream in order, a partition at a time."""
    rows = points.orderBy(order).select(gpx_point("trkpt").alias("x")).toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="tidemark" xmlns="http://www.topografix.com/GPX/1/1">\n<trk><name>{escape(name)}</name><trkseg>\n')
        f.writelines(r.x + "\n" for r in rows)
        f.write("</trkseg></trk>\n</gpx>\n")


def open_mbtiles(path: str) -> sqlite3.Connection:
    """IO-50: opens or creates a tile package."""
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS metadata (name text PRIMARY KEY, value text)")
    db.execute("CREATE TABLE IF NOT EXISTS tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob, PRIMARY KEY (zoom_level, tile_column, tile_row))")
    return db


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """IO-51, IO-52: upserts (zoom, col, row, data) rows and keeps zoom range and own metadata; a driver-side file format, streamed."""
    with open_mbtiles(path) as db:
        for r in tiles.select("zoom", "col", "row", "data").toLocalIterator():
            db.execute("INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)", (r.zoom, r.col, r.row, bytes(r.data)))
        lo, hi = db.execute("SELECT min(zoom_level), max(zoom_level) FROM tiles").fetchone()
        for k, v in ((metadata or {}) | {"minzoom": str(lo), "maxzoom": str(hi)}).items():
            db.execute("INSERT OR REPLACE INTO metadata VALUES (?, ?)", (k, v))
    db.close()


def read_mbtiles(spark: SparkSession, path: str, table: str = "tiles") -> DataFrame:
    """Rows of a local tile package, read on one executor task (the format has one file and one reader)."""
    schema = {"tiles": "zoom long, col long, row long, data binary", "metadata": "name string, value string"}[table]

    def run(_):
        import pandas as pd

        with sqlite3.connect(path) as db:
            yield pd.DataFrame(db.execute(f"SELECT * FROM {table}").fetchall(), columns=[x.split()[0] for x in schema.split(", ")])  # noqa: S608

    return spark.range(1).repartition(1).mapInPandas(run, schema)


def merge_tiles(packages: list[DataFrame]) -> DataFrame:
    """IO-53, U-01: all tiles; of one address the last package's stays. Equal data is kept once by hash in dedup_tiles."""
    n = reduce(DataFrame.unionByName, [p.withColumn("_n", F.lit(i)) for i, p in enumerate(packages)])
    return n.groupBy("zoom", "col", "row").agg(F.max_by("data", "_n").alias("data"))


def dedup_tiles(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Addresses with the hash of their data, and each data once."""
    t = tiles.withColumn("hash", F.sha2("data", 256))
    return t.select("zoom", "col", "row", "hash"), t.dropDuplicates(["hash"]).select("hash", "data")


def read_sonar(spark: SparkSession, path: str) -> DataFrame:
    """IO-40, IO-41, J-05: points of all tracks of a recording: a SQLite file whose Subtracks hold zlib-packed columns of
    (time, x, y, depth) doubles in spherical Mercator."""
    import math

    def run(_):
        import pandas as pd

        with sqlite3.connect(path) as db:
            for track, name in db.execute("SELECT trackId, name FROM Tracks").fetchall():
                for (data,) in db.execute("SELECT data FROM Subtracks WHERE trackId = ?", (track,)):
                    raw = zlib.decompress(data)
                    n = len(raw) // 32
                    t, x, y, depth = (struct.unpack_from(f"<{n}d", raw, 8 * n * k) for k in range(4))
                    lat = [math.degrees(math.atan(math.sinh(v / 6378137.0))) for v in y]
                    yield pd.DataFrame({"track": track, "name": name, "time": t, "lat": lat, "lon": [math.degrees(v / 6378137.0) for v in x], "depth": depth})

    return spark.range(1).repartition(1).mapInPandas(run, "track long, name string, time double, lat double, lon double, depth double")


def sonar_to_gpx(spark: SparkSession, path: str, out: str) -> list[str]:
    """IO-42: one GPX file for each track."""
    d, files = read_sonar(spark, path), []
    for r in d.select("track", "name").distinct().collect():
        files.append(os.path.join(out, f"{r.track}.gpx"))
        p = d.where(F.col("track") == r.track).withColumn("ele", -F.col("depth")).withColumn("at", F.col("time")).withColumn("time", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        write_gpx(p, files[-1], "at", r.name)
    return files


def dot_lines(edges: DataFrame) -> DataFrame:
    """IO-68: a line of a DOT graph for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(q("src"), F.when(F.col("directed"), F.lit(" -> ")).otherwise(F.lit(" -- ")), q("dst"), F.lit(" [label="), F.col("cost").cast("string"), F.lit("];")).alias("line"))


def tpv(time_us: Column, lat: Column, lon: Column, alt: Column, speed: Column) -> Column:
    """IO-34: position report as JSON."""
    time = F.date_format(F.timestamp_micros(time_us), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(F.lit("TPV").alias("class"), time.alias("time"), F.lit(3).alias("mode"), lat.alias("lat"), lon.alias("lon"), alt.alias("alt"), speed.alias("speed")))
