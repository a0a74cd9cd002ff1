"""Binary GNSS streams and small binary containers, read through Spark's binaryFile or binary columns (IO-30..IO-32, IO-63, IO-71, IO-75).

Frames are found and decoded a file (or row) at a time with struct; a row comes out for each frame, so that a decoder's memory is
one file's. Layouts are lists of (name, struct code), stated as the protocols publish them.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: UBX payload layouts (little endian), by class and id.
UBX = {
    (0x01, 0x02): ("NAV-POSLLH", [("iTOW", "I"), ("lon", "i"), ("lat", "i"), ("height", "i"), ("hMSL", "i"), ("hAcc", "I"), ("vAcc", "I")]),
    (0x01, 0x03): ("NAV-STATUS", [("iTOW", "I"), ("gpsFix", "B"), ("flags", "B"), ("fixStat", "B"), ("flags2", "B"), ("ttff", "I"), ("msss", "I")]),
    (0x01, 0x04): ("NAV-DOP", [("iTOW", "I"), ("gDOP", "H"), ("pDOP", "H"), ("tDOP", "H"), ("vDOP", "H"), ("hDOP", "H"), ("nDOP", "H"), ("eDOP", "H")]),
    (0x01, 0x12): ("NAV-VELNED", [("iTOW", "I"), ("velN", "i"), ("velE", "i"), ("velD", "i"), ("speed", "I"), ("gSpeed", "I"), ("heading", "i"), ("sAcc", "I"), ("cAcc", "I")]),
    (0x01, 0x20): ("NAV-TIMEGPS", [("iTOW", "I"), ("fTOW", "i"), ("week", "h"), ("leapS", "b"), ("valid", "B"), ("tAcc", "I")]),
    (0x01, 0x21): ("NAV-TIMEUTC", [("iTOW", "I"), ("tAcc", "I"), ("nano", "i"), ("year", "H"), ("month", "B"), ("day", "B"), ("hour", "B"), ("min", "B"), ("sec", "B"), ("valid", "B")]),
    (0x0D, 0x01): ("TIM-TP", [("towMS", "I"), ("towSubMS", "I"), ("qErr", "i"), ("week", "H"), ("flags", "B"), ("refInfo", "B")]),
    (0x06, 0x08): ("CFG-RATE", [("measRate", "H"), ("navRate", "H"), ("timeRef", "H")]),
}
#: SiRF payload layouts (big endian), by message id, after the id.
SIRF = {
    0x02: ("measured-nav", [("x", "i"), ("y", "i"), ("z", "i"), ("vx", "h"), ("vy", "h"), ("vz", "h"), ("mode1", "B"), ("hdop", "B"), ("mode2", "B"), ("week", "H"), ("tow", "I"), ("sats", "B")]),
    0x07: ("clock-status", [("week", "H"), ("tow", "I"), ("sats", "B"), ("drift", "I"), ("bias", "I"), ("gps_ms", "I")]),
    0x09: ("cpu-throughput", [("max", "H"), ("latency", "H"), ("average", "H"), ("ms", "H")]),
    0x29: ("geodetic-nav", [("valid", "H"), ("type", "H"), ("week", "H"), ("tow", "I"), ("year", "H"), ("month", "B"), ("day", "B"), ("hour", "B"), ("minute", "B"), ("second", "H"), ("sat_ids", "I"), ("lat", "i"), ("lon", "i"), ("alt_ellipsoid", "i"), ("alt_msl", "i"), ("datum", "B"), ("sog", "H"), ("cog", "H")]),
}
FRAME = "path string, offset long, protocol string, name string, checksum_ok boolean, fields map<string,long>, payload binary"


def fletcher(data: bytes) -> bytes:
    a = b = 0
    for x in data:
        a = (a + x) & 255
        b = (b + a) & 255
    return bytes((a, b))


def ubx_frame(cls: int, id_: int, payload: bytes) -> bytes:
    head = bytes((cls, id_)) + struct.pack("<H", len(payload)) + payload
    return b"\xb5\x62" + head + fletcher(head)


def sirf_frame(payload: bytes) -> bytes:
    return b"\xa0\xa2" + struct.pack(">H", len(payload)) + payload + struct.pack(">H", sum(payload) & 0x7FFF) + b"\xb0\xb3"


def _fields(layout: list[tuple[str, str]], data: bytes, order: str) -> dict[str, int]:
    code = order + "".join(c for _, c in layout)
    if len(data) < struct.calcsize(code):
        return {}
    return dict(zip([n for n, _ in layout], map(int, struct.unpack_from(code, data)), strict=True))


def demultiplex(data: bytes) -> Iterator[tuple[int, str, str, bool, dict[str, int], bytes]]:
    """IO-32: frames of a mixed stream in order: (offset, protocol, name, checksum ok, fields, payload). Bytes of no frame are skipped."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\xb5\x62" and at + 8 <= len(data):
            n = struct.unpack_from("<H", data, at + 4)[0]
            end = at + 8 + n
            if end <= len(data):
                p = data[at + 6 : at + 6 + n]
                name, layout = UBX.get((data[at + 2], data[at + 3]), (f"{data[at + 2]:02X}-{data[at + 3]:02X}", []))
                yield at, "ubx", name, fletcher(data[at + 2 : at + 6 + n]) == data[end - 2 : end], _fields(layout, p, "<"), p
                at = end
                continue
        elif data[at : at + 2] == b"\xa0\xa2" and at + 8 <= len(data):
            n = struct.unpack_from(">H", data, at + 2)[0]
            end = at + 8 + n
            if end <= len(data) and data[end - 2 : end] == b"\xb0\xb3":
                p = data[at + 4 : at + 4 + n]
                name, layout = SIRF.get(p[0] if p else -1, (f"{p[0]:02X}" if p else "", []))
                yield at, "sirf", name, sum(p) & 0x7FFF == struct.unpack_from(">H", data, end - 4)[0], _fields(layout, p[1:], ">"), p
                at = end
                continue
        elif data[at : at + 1] == b"$" and 0 <= (end := data.find(b"\r\n", at)) < at + 1024:
            p = data[at:end]
            body, _, said = p[1:].partition(b"*")
            x = 0
            for c in body:
                x ^= c
            yield at, "nmea", body.split(b",")[0].decode("ascii", "replace"), said.upper() == b"%02X" % x, {}, p
            at = end + 2
            continue
        at += 1


def frames(files: DataFrame) -> DataFrame:
    """Frames of (path, content) rows, as spark.read.format('binaryFile') gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "offset", "protocol", "name", "checksum_ok", "fields", "payload"]
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(path, *f) for f in demultiplex(bytes(content))], columns=names)

    return files.select("path", "content").mapInPandas(run, FRAME)


def zip_entries(files: DataFrame) -> DataFrame:
    """IO-71: members of ZIP files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, i.filename, i.file_size, i.compress_size, i.CRC) for path, c in zip(b["path"], b["content"], strict=True) for i in zipfile.ZipFile(io.BytesIO(bytes(c))).infolist()]
            yield pd.DataFrame(rows, columns=["path", "name", "size", "packed", "crc32"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, packed long, crc32 long")


def png_chunks(files: DataFrame) -> DataFrame:
    """IO-75: chunks of PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, c in zip(b["path"], b["content"], strict=True):
                c, at = bytes(c), 8
                while c[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(c):
                    n, kind = struct.unpack_from(">I4s", c, at)
                    rows.append((path, at, kind.decode("ascii", "replace"), n))
                    at += n + 12
            yield pd.DataFrame(rows, columns=["path", "offset", "kind", "length"])

    return files.select("path", "content").mapInPandas(run, "path string, offset long, kind string, length long")


def sqlite_header(files: DataFrame) -> DataFrame:
    """IO-63: page size, pages, encoding and version of SQLite files, with the kind and cells of the first page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, c in zip(b["path"], b["content"], strict=True):
                c = bytes(c[:112])
                if c[:16] == b"SQLite format 3\0":
                    size = struct.unpack_from(">H", c, 16)[0]
                    pages, enc = struct.unpack_from(">I", c, 28)[0], struct.unpack_from(">I", c, 56)[0]
                    rows.append((path, 65536 if size == 1 else size, pages, enc, struct.unpack_from(">I", c, 96)[0], c[100], struct.unpack_from(">H", c, 103)[0]))
            yield pd.DataFrame(rows, columns=["path", "page_size", "pages", "encoding", "version", "root_kind", "root_cells"])

    return files.select("path", "content").mapInPandas(run, "path string, page_size long, pages long, encoding long, version long, root_kind long, root_cells long")
