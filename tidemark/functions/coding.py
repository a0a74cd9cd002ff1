"""Byte codings of numbers, texts and records (S-34..S-40, T-06, T-08, T-10, T-16, T-17, H-30, H-31, H-33..H-36, IO-70, M-02).

Everything works on one row's values and gives null for null. Numbers of 64 bits are longs, read without sign where said so.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Alphabets of the number bases (T-08).
ALPHABETS = {
    "zbase32": "YBNDRFG8EJKMCPQXOT1UWISZA345H769",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32hex": "0123456789ABCDEFGHIJKLMNOPQRSTUV",
    "base32_wordsafe": "23456789CFGHJMPQRVWXcfghjmpqrvwx",
    "base31": "0123456789BCDFGHJKLMNPQRSTVWXYZ",
    "base20_wordsafe": "23456789CFGHJMPQRVWX",
    "base12": "0123456789AB",
}


def _and(v: Column, mask: int) -> Column:
    return v.bitwiseAND(F.lit(mask).cast("long"))


def _hex(v: Column, size: int) -> Column:
    """The low `size` bytes of a long, big end first, in hex."""
    return F.lpad(F.hex(_and(v, (1 << (8 * size)) - 1) if size < 8 else v), 2 * size, "0")


def _byte(b: Column, i: Column) -> Column:
    """Byte i (from 1) of a binary value as a long."""
    return F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long")


def _septets(u: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(u)) / 7))


def vbyte(u: Column, big_end_first: bool = False) -> Column:
    """S-35, H-31: seven bits a byte, the eighth set on all bytes but the last; low bits first as in LEB128, or high bits first. All 64 bits count."""
    n = _septets(u)

    def part(i: int) -> Column:
        seven, follows = _and(F.shiftrightunsigned(u, 7 * i), 127), F.lit(i > 0) if big_end_first else n > i + 1
        return F.when(n > i, _hex(F.when(follows, seven + 128).otherwise(seven), 1)).otherwise("")

    return F.unhex(F.concat(*[part(i) for i in (range(9, -1, -1) if big_end_first else range(10))]))


def unvbyte(b: Column, big_end_first: bool = False) -> Column:
    n = F.octet_length(b)

    def term(i: Column) -> Column:
        return F.shiftleft(_and(_byte(b, i), 127), 0), (n - i if big_end_first else i - 1) * 7

    def add(s: Column, i: Column) -> Column:
        seven, places = term(i)
        return s.bitwiseOR(F.call_function("shiftleft", seven, places.cast("int")))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), add))


def varint(u: Column) -> Column:
    """H-30: one to nine bytes as published for version 4 of a well-known embedded database; u without sign."""
    two, three = u - 240, u - 2288
    wide = F.when(u < 0, 8)
    for size in range(3, 9):
        wide = wide.when(u < 1 << (8 * size), size) if size < 8 else wide.otherwise(8)
    long_form = F.lit(None)
    for size in range(3, 9):
        long_form = F.when(wide == size, F.concat(F.lit(f"{247 + size:02X}"), _hex(u, size))).otherwise(long_form)
    return F.unhex(
        F.when((u >= 0) & (u <= 240), _hex(u, 1))
        .when((u >= 0) & (u <= 2287), F.concat(_hex(F.floor(two / 256).cast("long") + 241, 1), _hex(two, 1)))
        .when((u >= 0) & (u <= 67823), F.concat(F.lit("F9"), _hex(three, 2)))
        .otherwise(long_form)
    )


def unvarint(b: Column) -> Column:
    first, rest = _byte(b, F.lit(1)), F.hex(F.substring(b, F.lit(2), F.lit(8)))
    value = F.conv(rest, 16, -10).cast("long")
    return F.when(first <= 240, first).when(first <= 248, 240 + 256 * (first - 241) + value).when(first == 249, 2288 + value).otherwise(value)


def _used(v: Column) -> Column:
    return F.when(v < 1 << 8, 1).when(v < 1 << 16, 2).when(v < 1 << 24, 3).otherwise(4)


def group_varint(four: list[Column]) -> Column:
    """H-30: a byte of four lengths, then the used bytes of four 32-bit numbers."""
    head = sum((F.shiftleft(_used(v) - 1, 6 - 2 * i) for i, v in enumerate(four[1:], 1)), F.shiftleft(_used(four[0]) - 1, 6))
    tail = [F.substring(_hex(v, 4), 9 - 2 * _used(v), F.lit(8)) for v in four]
    return F.unhex(F.concat(_hex(head.cast("long"), 1), *tail))


def ungroup_varint(b: Column) -> list[Column]:
    head, at, found = _byte(b, F.lit(1)), F.lit(2), []
    for i in range(4):
        size = (_and(F.shiftright(head, 6 - 2 * i), 3) + 1).cast("int")
        found.append(F.conv(F.hex(F.substring(b, at, size)), 16, 10).cast("long"))
        at = at + size
    return found


@F.pandas_udf(T.LongType())
def float_bits(v: pd.Series) -> pd.Series:
    """S-40, M-02: the 64 bits of a double; Spark has no such cast. Whole batches are viewed, no row is touched."""
    return pd.Series(v.to_numpy(np.float64).view(np.int64)).astype("Int64").mask(v.isna().to_numpy())


@F.pandas_udf(T.DoubleType())
def bits_float(b: pd.Series) -> pd.Series:
    return pd.Series(b.fillna(0).to_numpy(np.int64).view(np.float64)).mask(b.isna().to_numpy())


def float_parts(bits: Column) -> tuple[Column, Column, Column]:
    """S-37, M-02: sign, exponent as stored and mantissa of a double's bits."""
    return F.shiftrightunsigned(bits, 63), _and(F.shiftrightunsigned(bits, 52), 0x7FF), _and(bits, (1 << 52) - 1)


def rot54(u: Column) -> Column:
    """S-37: the low seven bytes in reverse order, so that the zeros at a mantissa's end become leading ones; its own inverse on 56 bits."""
    return F.conv(F.concat(*[_hex(F.shiftrightunsigned(u, 8 * i), 1) for i in range(7)]), 16, -10).cast("long")


@F.pandas_udf(T.BinaryType())
def deflate(b: pd.Series) -> pd.Series:
    """S-36: raw DEFLATE of one block of bytes; callers bound the blocks."""

    def one(x: bytes) -> bytes:
        c = zlib.compressobj(wbits=-15)
        return c.compress(x) + c.flush()

    return b.map(lambda x: None if x is None else one(x))


@F.pandas_udf(T.BinaryType())
def inflate(b: pd.Series) -> pd.Series:
    """S-36, H-34: inverse of deflate; what isn't a whole stream is an error."""
    return b.map(lambda x: None if x is None else zlib.decompress(x, wbits=-15))


def lzw_bytes(data: bytes) -> bytes:
    """H-33: codes of 9 to 12 bits, high bits first, as in TIFF; 256 clears the table, 257 ends the stream."""
    table, bits, n, width, free, prefix = {}, 0, 0, 9, 258, None

    def put(code: int) -> None:
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    out = bytearray()
    for byte in data:
        if prefix is None:
            prefix = byte
            continue
        known = table.get((prefix, byte))
        if known is not None:
            prefix = known
            continue
        put(prefix)
        table[prefix, byte], free = free, free + 1
        width = max(9, free.bit_length())
        if free == 4095:
            put(256)
            table, width, free = {}, 9, 258
        prefix = byte
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
        bits &= (1 << n) - 1
    if prefix is not None:
        put(prefix)
        width = max(9, (free + 1).bit_length())  # readers count an entry for this code as well
    put(257)
    pad = -n % 8
    return bytes(out) + (bits << pad).to_bytes((n + pad) // 8, "big")


def unlzw_bytes(data: bytes) -> bytes:
    table, width, before, out = [], 9, None, bytearray()
    bits = n = 0

    def text(code: int) -> bytes:
        return bytes([code]) if code < 256 else table[code - 258]

    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & ((1 << n) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, before = [], 9, None
            continue
        if before is not None:
            start = text(code)[:1] if code < 258 + len(table) else text(before)[:1]
            table.append(text(before) + start)
        out += text(code)
        before = code
        width = max(9, (len(table) + 259).bit_length())
    raise ValueError("LZW stream without an end")


@F.pandas_udf(T.BinaryType())
def lzw(b: pd.Series) -> pd.Series:
    """H-33, one value at a time: each code depends on all bytes before it."""
    return b.map(lambda x: None if x is None else lzw_bytes(x))


@F.pandas_udf(T.BinaryType())
def unlzw(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else unlzw_bytes(x))


def proto_field(tag: int, kind: str, v: Column) -> Column:
    """IO-70: one field of a protocol-buffer message: int (varint), sint (zigzag), double, fixed32, text or bytes. A null field is absent."""
    wire = {"int": 0, "sint": 0, "double": 1, "text": 2, "bytes": 2, "fixed32": 5}[kind]
    swap = lambda h, size: F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    if kind == "int":
        body = vbyte(v.cast("long"))
    elif kind == "sint":
        body = vbyte(F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)))
    elif kind == "double":
        body = F.unhex(swap(_hex(float_bits(v), 8), 8))
    elif kind == "fixed32":
        body = F.unhex(swap(_hex(v, 4), 4))
    else:
        raw = F.encode(v, "UTF-8") if kind == "text" else v
        body = F.concat(vbyte(F.octet_length(raw).cast("long")), raw)
    return F.coalesce(F.concat(vbyte(F.lit(tag << 3 | wire).cast("long")), body), F.lit(b""))


def proto_message(*fields: Column) -> Column:
    return F.concat(*fields)


def record(*fields: tuple[Column, int]) -> Column:
    """H-36: numbers in a fixed layout of 1 to 8 bytes each, big end first."""
    return F.unhex(F.concat(*[_hex(v, size) for v, size in fields]))


def read_number(b: Column, at: int, size: int, big_end_first: bool = True, signed: bool = False) -> Column:
    """H-35, H-36: the number of `size` bytes from byte `at` (from 0) on; null beyond the end."""
    h = F.hex(F.substring(b, at + 1, size))
    if not big_end_first:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    v = F.conv(h, 16, -10).cast("long")
    if signed and size < 8:
        v = F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v)
    return F.when(F.octet_length(b) >= at + size, v)


def bit_string(b: Column) -> Column:
    """H-35: all bits, high bits first."""
    digits = F.regexp_extract_all(F.hex(b), F.lit("(.)"), F.lit(1))
    return F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def in_alphabet(v: Column, alphabet: str) -> Column:
    """T-08: a number from zero on, written with the characters of an alphabet as digits."""
    n, powers = len(alphabet), [1]
    while powers[-1] * n < 1 << 63:
        powers.append(powers[-1] * n)
    digits = F.transform(F.array(*[F.lit(p).cast("long") for p in reversed(powers)]), lambda p: F.substring(F.lit(alphabet), F.pmod(F.call_function("div", v, p), F.lit(n)).cast("int") + 1, F.lit(1)))
    bare = F.ltrim(F.array_join(digits, ""), F.lit(alphabet[0]))
    return F.when(v.isNotNull() & (v >= 0), F.when(v == 0, F.lit(alphabet[0])).otherwise(bare))


def hexdump(b: Column) -> Column:
    """T-06: lines of an offset, 16 bytes in hex and as characters; other than printable Latin-1 shows as a dot; the last line is padded. Each line ends with a line break."""
    chars = F.regexp_replace(F.decode(b, "ISO-8859-1"), "[\\x00-\\x1F\\x7F-\\xA0\\xFF]", ".")
    hexed = F.hex(b)

    def line(i: Column) -> Column:
        pairs = F.regexp_replace(F.substring(hexed, 2 * i + 1, F.lit(32)), "(..)", "$1 ")
        return F.concat(F.lpad(F.hex(i), 8, "0"), F.lit("  "), F.rpad(pairs, 48, " "), F.lit(" |"), F.rpad(F.substring(chars, i + 1, F.lit(16)), 16, " "), F.lit("|\n"))

    n = F.octet_length(b)
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1, F.lit(16)), line), ""))


def uuid_text(b: Column) -> Column:
    """T-10: 16 bytes as 8-4-4-4-12 capital hex digits; null unless there are 16."""
    return F.when(F.octet_length(b) == 16, F.regexp_replace(F.hex(b), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def parse_uuid(text: Column) -> Column:
    """T-10: the 16 bytes of 32 hex digits of either case, dashes ignored; null for anything else."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    return F.when(bare.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(bare))


def otp(digest_hex: Column) -> tuple[Column, Column]:
    """T-17: six decimal digits at most and six hex digits of a digest of 20 bytes or more, from the place its last four bits name."""
    at = F.conv(F.substring(digest_hex, -1, 1), 16, 10).cast("int") * 2
    number = _and(F.conv(F.substring(digest_hex, at + 1, F.lit(8)), 16, 10).cast("long"), 0x7FFFFFFF)
    return (number % 1_000_000).cast("string"), F.upper(F.substring(digest_hex, at + 3, F.lit(6)))


def six_indices(u: Column) -> Column:
    """T-16: five blocks of 11 bits and one of 9 with a checksum of two, as indices into a list of 2048 words."""
    check = _and(sum((_and(F.shiftrightunsigned(u, s), 3) for s in range(2, 64, 2)), _and(u, 3)), 3)
    blocks = [_and(F.shiftrightunsigned(u, s), 0x7FF) for s in (53, 42, 31, 20, 9)]
    return F.array(*blocks, _and(F.shiftleft(u, 2), 0x7FF).bitwiseOR(check))


def six_value(indices: Column) -> Column:
    """T-16: the number of six indices; null if their checksum is wrong."""
    i = [F.get(indices, F.lit(k)).cast("long") for k in range(6)]
    u = F.shiftrightunsigned(i[5], 2)
    for block, s in zip(i, (53, 42, 31, 20, 9)):
        u = u.bitwiseOR(F.shiftleft(block, s))
    return F.when(F.get(six_indices(u), F.lit(5)) == i[5], u)


def words_at(indices: Column, words: list[str]) -> Column:
    """T-16: names of indices from a list the caller brings (2048 words, or 256 for bytes)."""
    names = F.array(*map(F.lit, words))
    return F.transform(indices, lambda i: F.get(names, i.cast("int")))


def byte_words(b: Column, even: list[str], odd: list[str] | None = None) -> Column:
    """T-16: a word for each byte; bytes at odd places from a list of their own, if there is one."""
    lists = [F.array(*map(F.lit, even)), F.array(*map(F.lit, odd or even))]
    pairs = F.regexp_extract_all(F.hex(b), F.lit("(..)"), F.lit(1))
    pick = lambda p, i: F.get(F.when(i % 2 == 0, lists[0]).otherwise(lists[1]), F.conv(p, 16, 10).cast("int"))
    return F.transform(pairs, pick)
