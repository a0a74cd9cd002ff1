"""IO-73: readers and writers by format name, over DataFrames; and thin clients (IO-33, IO-60..IO-62)."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import binary, csv, geofiles, nmea

READERS: dict[str, Callable] = {
    "csv": csv.read_csv,
    "csv_rows": csv.read_rows,
    "nmea": lambda s, p: nmea.parsed(s.read.text(p).withColumnRenamed("value", "line")),
    "gpx": geofiles.read_gpx,
    "gnss": lambda s, p: binary.frames(s.read.format("binaryFile").load(p)),
    "zip": lambda s, p: binary.zip_entries(s.read.format("binaryFile").load(p)),
    "png": lambda s, p: binary.png_chunks(s.read.format("binaryFile").load(p)),
    "sqlite_header": lambda s, p: binary.sqlite_header(s.read.format("binaryFile").load(p)),
    "mbtiles": geofiles.read_mbtiles,
    "sonar": geofiles.read_sonar,
    "series": lambda s, p: s.read.parquet(p),  # IO-65, S-30: coded series are Parquet
    "json": lambda s, p: s.read.json(p),  # IO-69
}
WRITERS: dict[str, Callable] = {
    "csv": csv.write_csv,
    "gpx": geofiles.write_gpx,
    "mbtiles": geofiles.write_mbtiles,
    "series": lambda d, p: d.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.bytestreamsplit", "true").parquet(p),  # S-31
}


def read(spark: SparkSession, format_: str, path: str, **kw) -> DataFrame:
    return READERS[format_](spark, path, **kw)


def write(df: DataFrame, format_: str, path: str, **kw) -> None:
    WRITERS[format_](df, path, **kw)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """IO-33: sentences from a TCP server as a stream."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "line")


#: Types of a time-series database's fields (IO-61).
FIELD_TYPES = {"float": "double", "integer": "long", "timestamp": "long", "string": "string", "boolean": "boolean"}


def influx_series(answer: str) -> list[tuple[str, list[str], list[list]]]:
    """IO-60: (name, columns, rows) of all series of a JSON query answer; an error in it is raised."""
    out = []
    for r in json.loads(answer).get("results", []):
        if "error" in r:
            raise ValueError(r["error"])
        out += [(s.get("name", ""), s["columns"], s.get("values", [])) for s in r.get("series", [])]
    return out


def influx_query(spark: SparkSession, url: str, q: str, db: str | None = None) -> DataFrame:
    """IO-60, IO-62: a query's answer over HTTP as rows of strings; one request, made where the frame is built."""
    args = {"q": q} | ({"db": db} if db else {})
    with urllib.request.urlopen(f"{url}/query?{urllib.parse.urlencode(args)}") as r:  # noqa: S310
        rows = [(n, {c: None if v is None else str(v) for c, v in zip(cols, row, strict=True)}) for n, cols, values in influx_series(r.read().decode()) for row in values]
    return spark.createDataFrame(rows, "name string, fields map<string,string>")


#: What a time-series database lists of itself (IO-62).
CATALOGUE = {"databases": "SHOW DATABASES", "retention_policies": "SHOW RETENTION POLICIES", "measurements": "SHOW MEASUREMENTS", "tag_keys": "SHOW TAG KEYS", "tag_values": "SHOW TAG VALUES", "field_keys": "SHOW FIELD KEYS"}


def influx_ping(url: str) -> bool:
    """IO-60: whether the server answers."""
    with urllib.request.urlopen(f"{url}/ping") as r:  # noqa: S310
        return r.status in (200, 204)


def influx_csv(url: str, q: str, db: str | None = None) -> str:
    """IO-60: a query's answer as the server's own CSV text, for the reader of `csv`."""
    args = {"q": q} | ({"db": db} if db else {})
    request = urllib.request.Request(f"{url}/query?{urllib.parse.urlencode(args)}", headers={"Accept": "application/csv"})  # noqa: S310
    with urllib.request.urlopen(request) as r:  # noqa: S310
        return r.read().decode()


def influx_catalogue(spark: SparkSession, url: str, kind: str, db: str | None = None) -> DataFrame:
    """IO-60, IO-62: databases, policies, measurements, keys, one row each; a catalogue is small and read where the frame is built."""
    on = f' ON "{db}"' if db and kind != "databases" else ""
    return influx_query(spark, url, CATALOGUE[kind] + on)


def influx_typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """IO-61: an answer's fields as columns of the types the database names; what isn't of its type becomes null."""
    return df.select("name", *[F.get(F.array("fields"), F.lit(0))[c].try_cast(FIELD_TYPES[t]).alias(c) for c, t in types.items()])
