"""Text, hashes, identifiers, addresses and colours as column expressions (T-*, H-*, M-30, M-31)."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def byte_levenshtein(a: Column, b: Column) -> Column:
    """T-01: edit distance over UTF-8 bytes."""
    bytes_ = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(bytes_(a), bytes_(b))


def match_score(a: Column, b: Column) -> Column:
    """T-02: sum over all shifts of equal bytes, that is the sum over bytes of the product of their counts; linear in the texts."""

    @F.pandas_udf(T.LongType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        count = lambda t: np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256)
        return pd.Series([None if u is None or v is None else int(count(u) @ count(v)) for u, v in zip(x, y, strict=True)], dtype="Int64")

    return run(a, b)


def url_base64(b: Column) -> Column:
    """T-07: URL-safe alphabet without padding."""
    return F.rtrim(F.translate(F.base64(b), "+/=", "-_ "))


def to_base(v: Column, base: int) -> Column:
    """T-08: digits 0-9a-z."""
    return F.lower(F.conv(v.cast("string"), 10, base))


def xor_checksum(body: Column) -> Column:
    """IO-22: exclusive or of all characters."""
    return F.aggregate(F.filter(F.split(body, ""), lambda c: c != ""), F.lit(0), lambda s, c: s.bitwiseXOR(F.ascii(c)))


def fold_to_u64(hex_digest: Column) -> Column:
    """H-11: exclusive or of a digest's 8-byte pieces, the first byte lowest; a shorter last piece counts as if padded by zeros."""
    pieces = F.regexp_extract_all(hex_digest, F.lit("(.{2,16})"), F.lit(1))
    number = lambda p: F.conv(F.rpad(p, 16, "0"), 16, -10).cast("long")
    folded = F.lpad(F.hex(F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s.bitwiseXOR(number(p)))), 16, "0")
    return F.conv(F.concat(*[F.substring(folded, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")


def ipv4_text(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def parse_ipv4(text: Column) -> Column:
    """T-13: the address as a number; null unless it is four numbers up to 255."""
    p = F.split(text, r"\.")
    part = lambda i: F.get(p, F.lit(i)).try_cast("long")
    ok = (F.size(p) == 4) & F.forall(p, lambda x: x.rlike(r"^\d{1,3}$") & (x.try_cast("int") <= 255))
    return F.when(ok, sum((part(i) * (1 << (24 - 8 * i)) for i in range(1, 4)), part(0) * (1 << 24)))


def in_network(ip: Column, network: str) -> Column:
    base, bits = network.split("/")
    first = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0), strict=True))
    return F.shiftright(ip, 32 - int(bits)) == (first >> (32 - int(bits)))


def network_of(ip: Column, bits: int) -> tuple[Column, Column]:
    """T-13: network and broadcast address of the network of `bits` that holds ip."""
    size = 1 << (32 - bits)
    net = ip - F.pmod(ip, F.lit(size))
    return net, net + size - 1


def ipv6_text(groups: list[Column]) -> Column:
    """T-14: eight groups in hex, without leading zeros."""
    return F.concat_ws(":", *[F.lower(F.hex(g)) for g in groups])


def mac_text(v: Column) -> Column:
    return F.lower(F.concat_ws(":", *[F.lpad(F.hex(F.shiftright(v, s).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for s in (40, 32, 24, 16, 8, 0)]))


def _digests(name: str, **kw):
    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        make = getattr(hashlib, name)
        return text.map(lambda x: None if x is None else make(x.encode(), **kw).hexdigest())

    return run


def blake2(text: Column, kind: str = "b", bits: int = 256) -> Column:
    """H-07: BLAKE2b or BLAKE2s of the UTF-8 bytes."""
    return _digests(f"blake2{kind}", digest_size=bits // 8)(text)


def hmac(text: Column, key: bytes, algorithm: str = "sha256") -> Column:
    """H-08 with any algorithm of the registry that has blocks (all but murmur3)."""
    name = algorithm_name(algorithm)
    kind, bits = (name[6], int(name[7:])) if name.startswith("blake2") else (None, 0)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        make = (lambda d=b"": getattr(hashlib, f"blake2{kind}")(d, digest_size=bits // 8)) if kind else name
        return s.map(lambda x: None if x is None else _hmac.new(key, x.encode(), make).hexdigest())

    return run(text)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """H-08 within the JVM, by its definition."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ p for x in block)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)


def murmur3_32_bytes(b: bytes, seed: int = 0) -> int:
    """H-05: the published 32-bit algorithm."""
    m, h = 0xFFFFFFFF, seed
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & m
    for i in range(0, len(b), 4):
        k = int.from_bytes(b[i : i + 4], "little")
        h ^= rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        if i + 4 <= len(b):
            h = (rot(h, 13) * 5 + 0xE6546B64) & m
    h ^= len(b)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & m
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & m
    return h ^ (h >> 16)


def murmur3_128_bytes(b: bytes, seed: int = 0) -> tuple[int, int]:
    """H-06: the published 128-bit algorithm for 64-bit machines; low half first."""
    m, c1, c2 = (1 << 64) - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    rot = lambda x, r: ((x << r) | (x >> (64 - r))) & m
    h1 = h2 = seed
    for i in range(0, len(b), 16):
        k1, k2 = (int.from_bytes(b[i + j : i + j + 8], "little") for j in (0, 8))
        whole = i + 16 <= len(b)
        h1 ^= rot(k1 * c1 & m, 31) * c2 & m
        if whole:
            h1 = ((rot(h1, 27) + h2) * 5 + 0x52DCE729) & m
        h2 ^= rot(k2 * c2 & m, 33) * c1 & m
        if whole:
            h2 = ((rot(h2, 31) + h1) * 5 + 0x38495AB5) & m
    h1, h2 = h1 ^ len(b), h2 ^ len(b)
    h1 = (h1 + h2) & m
    h2 = (h2 + h1) & m

    def fin(k: int) -> int:
        k = (k ^ (k >> 33)) * 0xFF51AFD7ED558CCD & m
        k = (k ^ (k >> 33)) * 0xC4CEB9FE1A85EC53 & m
        return k ^ (k >> 33)

    h1, h2 = fin(h1), fin(h2)
    h1 = (h1 + h2) & m
    return h1, (h2 + h1) & m


@F.pandas_udf(T.LongType())
def murmur3_32(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else murmur3_32_bytes(x.encode())).astype("Int64")


@F.pandas_udf(T.StringType())
def murmur3_128(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "%016x%016x" % murmur3_128_bytes(x.encode()))


@F.pandas_udf(T.LongType())
def identifier_number(s: pd.Series) -> pd.Series:
    """T-09: low 64 bits of murmur3-128 as a signed number."""
    return pd.Series([np.uint64(murmur3_128_bytes((x or "").encode())[0]).astype(np.int64) for x in s], dtype="int64")


#: Names of the hash algorithms (H-09), and other names for some of them.
ALGORITHMS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512", "murmur3_128", "murmur3_32", "blake2s128", "blake2s160", "blake2s224", "blake2s256", "blake2b160", "blake2b224", "blake2b256", "blake2b384", "blake2b512")
ALIASES = {"murmur3": "murmur3_128", "m3": "murmur3_128", "b2": "blake2b512", "b2b": "blake2b512", "blake2b": "blake2b512", "b2s": "blake2s256", "blake2s": "blake2s256"}


def algorithm_name(name: str) -> str:
    """H-09: the registered name; an unknown one is an error."""
    found = ALIASES.get(name, name)
    if found not in ALGORITHMS:
        raise ValueError(f"no hash algorithm {name!r}")
    return found


def digest(data: Column, algorithm: str) -> Column:
    """H-09, H-10: a binary value's digest by any registered algorithm, in hex; within the JVM where Spark has it."""
    name = algorithm_name(algorithm)
    if name == "md5":
        return F.md5(data)
    if name == "sha1":
        return F.sha1(data)
    if name.startswith("sha"):
        return F.sha2(data, int(name[3:]))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        if name == "murmur3_32":
            one = lambda x: "%08x" % murmur3_32_bytes(x)
        elif name == "murmur3_128":
            one = lambda x: "%016x%016x" % murmur3_128_bytes(x)
        else:
            one = lambda x: getattr(hashlib, name[:7])(x, digest_size=int(name[7:]) // 8).hexdigest()
        return s.map(lambda x: None if x is None else one(bytes(x)))

    return run(data)


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """Channels of 0xRRGGBB from 0 to 1."""
    return tuple(F.shiftright(color, s).bitwiseAND(F.lit(255).cast("long")) / 255.0 for s in (16, 8, 0))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """M-30: hue in degrees, saturation, value."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    c = hi - lo
    hue = F.when(c == 0, 0.0).when(hi == r, F.pmod((g - b) / c, F.lit(6.0))).when(hi == g, (b - r) / c + 2).otherwise((r - g) / c + 4) * 60
    return hue, F.when(hi == 0, 0.0).otherwise(c / hi), hi


def hsl_to_hsv(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    """M-30: hue, saturation and value of hue, saturation and lightness; black has no saturation."""
    value = light + s * F.least(light, 1 - light)
    return h, F.when(value < 0.001, 0.0).otherwise(2 * (1 - light / value)), value


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """M-30: channels from 0 to 1 of a hue in degrees."""

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 60, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """M-30: relative luminance of the web accessibility guidelines."""
    lin = lambda c: F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def colormap(x: Column, stops: list[float]) -> Column:
    """M-31: linear interpolation between equidistant stops over [0, 1]."""
    at = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    i = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    a = F.array(*map(F.lit, stops))
    return F.element_at(a, i + 1) + (F.element_at(a, i + 2) - F.element_at(a, i + 1)) * (at - i)
