"""Queries on byte codings, words of digests, matrices, random sequences and small containers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import codec as C
from tidemark.functions import coding as B
from tidemark.functions import geo as G
from tidemark.functions import linalg as M
from tidemark.functions import sequences as S
from tidemark.functions import text as X
from tidemark.plans.common import POINTS_SQL, points, r6, read

#: Samples of a block of a coded stream: a block's bytes stay below 10 times as many.
BLOCK = 4096


def float_forms(spark, sf_dir):
    """S-34, S-37, S-40, M-02: bits of prices, their parts, byte order and exclusive or with the line before."""
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", B.float_bits(F.col("l_extendedprice")).alias("bits"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "bits")
    _, exponent, mantissa = B.float_parts(F.col("bits"))
    return d.select("l_orderkey", "l_linenumber", "bits", exponent.alias("exponent"), mantissa.alias("mantissa"), B.rot54(F.col("bits")).alias("turned"), C.xor_delta(F.col("bits"), w).alias("changed"))


def byte_codes(spark, sf_dir):
    """H-30, H-31, S-35: variable-length codes of numbers, and the numbers read back."""
    k = F.col("o_orderkey")
    big = k * k * 7919
    four = [k % 256, k, k * 300, F.col("o_custkey")]
    d = read(spark, sf_dir, "orders").select("o_orderkey", big.alias("big"), B.vbyte(big, True).alias("hi"), B.vbyte(big).alias("lo"), B.varint(big).alias("var"), B.group_varint(four).alias("grouped"))
    back = F.array_join(F.array(*B.ungroup_varint(F.col("grouped"))), ",")
    same = (B.unvbyte(F.col("hi"), True) == F.col("big")) & (B.unvbyte(F.col("lo")) == F.col("big")) & (B.unvarint(F.col("var")) == F.col("big"))
    return d.select("o_orderkey", F.hex("hi").alias("high"), F.hex("lo").alias("low"), F.octet_length("var").cast("long").alias("n_var"), back.alias("four"), same.alias("same"))


def block_streams(spark, sf_dir):
    """S-32, S-33, S-35, S-36, S-39, IO-66: each user's values as delta, zigzag, vbyte and deflated blocks, with the bytes of each stage."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    d = read(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("user_id", cents.alias("v"), F.row_number().over(w).alias("i"), C.zigzag(cents - F.lag(cents, 1, 0).over(w)).alias("u"))
    d = d.select("user_id", F.floor((F.col("i") - 1) / BLOCK).alias("block"), "i", F.hex(B.vbyte(F.col("u"), True)).alias("h"))
    packed = d.groupBy("user_id", "block").agg(F.count("*").alias("n"), F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")).alias("raw"))
    packed = packed.withColumn("deflated", B.deflate(F.col("raw"))).withColumn("back", B.inflate(F.col("deflated")))
    return packed.groupBy("user_id").agg(F.count("*").alias("blocks"), (8 * F.sum("n")).alias("number_bytes"), F.sum(F.octet_length("raw").cast("long")).alias("coded_bytes"), F.every(F.col("back") == F.col("raw")).alias("intact"))


def lzw(spark, sf_dir):
    """H-33: whole texts coded and read back."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("t")).withColumn("coded", B.lzw(F.col("t")))
    return d.select("doc_id", F.octet_length("t").cast("long").alias("bytes"), (B.unlzw(F.col("coded")) == F.col("t")).alias("same"))


def wire_messages(spark, sf_dir):
    """IO-70: customers as protocol-buffer messages."""
    m = B.proto_message(B.proto_field(1, "int", F.col("c_custkey")), B.proto_field(2, "text", F.col("c_name")), B.proto_field(3, "sint", F.round(F.col("c_acctbal") * 100).cast("long")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.hex(m).alias("message"))


def records(spark, sf_dir):
    """H-35, H-36: a fixed layout written and read, of either byte order."""
    r = B.record((F.col("l_orderkey"), 8), (F.col("l_linenumber").cast("long"), 2), (F.round(F.col("l_quantity")).cast("long") - 25, 4))
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    return d.select("l_orderkey", "l_linenumber", F.hex("r").alias("bytes"), B.read_number(F.col("r"), 0, 8).alias("order"), B.read_number(F.col("r"), 8, 2, False).alias("swapped"), B.read_number(F.col("r"), 10, 4, signed=True).alias("quantity"), B.bit_string(F.substring("r", 9, 2)).alias("bits"))


def uuids(spark, sf_dir):
    """T-10: digests as identifiers, written and parsed; a random one has the same form."""
    u = B.uuid_text(F.unhex(F.md5("c_name")))
    d = read(spark, sf_dir, "customer").select("c_custkey", u.alias("uuid"))
    return d.select("c_custkey", "uuid", F.lower(F.hex(B.parse_uuid(F.lower("uuid")))).alias("parsed"), B.parse_uuid(F.substring("uuid", 2, 40)).isNull().alias("short"), B.uuid_text(B.parse_uuid(F.uuid())).rlike("^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$").alias("random"))


def alphabets(spark, sf_dir):
    """T-08: order keys in seven alphabets."""
    return read(spark, sf_dir, "orders").select("o_orderkey", *[B.in_alphabet(F.col("o_orderkey"), a).alias(n) for n, a in B.ALPHABETS.items()])


def hexdumps(spark, sf_dir):
    """T-06."""
    return read(spark, sf_dir, "customer").select("c_custkey", B.hexdump(F.encode("c_name", "UTF-8")).alias("dump"))


def digest_words(spark, sf_dir):
    """H-11, T-16, T-17: folded digests, their six indices and one-time digits."""
    t = F.encode(F.col("text"), "UTF-8")
    d = read(spark, sf_dir, "documents").select("doc_id", X.fold_to_u64(F.sha2(t, 256)).alias("folded"), F.sha1(t).alias("sha1"))
    six, digits = B.six_indices(F.col("folded")), B.otp(F.col("sha1"))
    return d.select("doc_id", "folded", F.array_join(six, " ").alias("six"), (B.six_value(six) == F.col("folded")).alias("back"), digits[0].alias("decimal"), digits[1].alias("hexadecimal"))


def hash_registry(spark, sf_dir):
    """H-09, H-10: digests by all registered names, over whole texts."""
    t = F.encode(F.col("text"), "UTF-8")
    return read(spark, sf_dir, "documents").select("doc_id", *[X.digest(t, n).alias(n) for n in X.ALGORITHMS])


def matrices(spark, sf_dir):
    """M-10, M-11: 3 x 3 systems made from part keys: product with the transpose, solution and row swap."""
    k = F.col("p_partkey")
    a = M.matrix([[k % 7 + 10, k % 5, k % 3], [k % 4, k % 11 + 12, k % 2], [k % 6, k % 9, k % 13 + 16]])
    d = read(spark, sf_dir, "part").select("p_partkey", a.alias("a"), F.array(F.lit(1.0), F.lit(2.0), (k % 10).cast("double")).alias("b"))
    d = d.withColumn("x", M.solve("a", "b")).withColumn("f", M.lup("a"))
    gram = M.mat_mul(F.col("a"), M.transpose(F.col("a")))
    det = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.lit(1.0), lambda s, i: s * F.get(F.get(F.col("f.upper"), i), i))
    corner = M.submatrix(M.swap_rows(F.col("a"), 0, 2), 1, 1)
    return d.select("p_partkey", *[r6(F.get("x", F.lit(i)) + 1e-9, f"x{i}") for i in range(3)], r6(gram[0][1], "gram"), r6(F.abs(det), "det"), r6(corner[0][0] * 100 + corner[1][1], "corner"))


def rotations(spark, sf_dir):
    """M-12: points turned about three axes."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y, z = M.rotate_3d(lon, lat, F.lit(5.0), lat / 50, F.lit(0.5), lon / 70)
    return points(spark, sf_dir).select("id", r6(x, "x"), r6(y, "y"), r6(z, "z"))


def permutations(spark, sf_dir):
    """H-21: all orders of the first four letters of each region's name."""
    spark.udtf.register("tidemark_permutations", S.Permutations)
    read(spark, sf_dir, "region").select("r_regionkey", F.split(F.substring("r_name", 1, 4), "").alias("letters")).createOrReplaceTempView("tidemark_sets")
    return spark.sql("SELECT r_regionkey, array_join(items, '') AS word FROM tidemark_sets, LATERAL tidemark_permutations(letters)")


def random_draws(spark, sf_dir):
    """H-20: three draws of each generator, seeded by key, and one as a number from -1 to 1."""
    d = read(spark, sf_dir, "supplier").select("s_suppkey", *[S.random_numbers(F.col("s_suppkey"), 3, k).alias(k) for k in S.KINDS])
    return d.withColumn("between", S.in_range(F.col("xsh_rr")[0], -1.0, 1.0))


def color_forms(spark, sf_dir):
    """M-30: colours to hue, saturation and value and back; and those of a lightness."""
    c = (F.col("p_partkey") * 2654435 % 16777216).cast("long")
    d = read(spark, sf_dir, "part").select("p_partkey", *[x.alias(n) for n, x in zip("rgb", X.rgb(c), strict=True)])
    d = d.select("*", *[x.alias(n) for n, x in zip("hsv", X.hsv(*map(F.col, "rgb")), strict=True)])
    back = X.hsv_to_rgb(*map(F.col, "hsv"))
    _, s, v = X.hsl_to_hsv(F.col("h"), F.col("r"), F.col("g"))
    return d.select("p_partkey", *[r6(x + 0.0, n) for n, x in zip("rgb", back, strict=True)], r6(s, "sat"), r6(v, "val"))


def last_values(spark, sf_dir):
    """R-06, F-01: a ring of each user's last five values, and the ring mapped."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    d = read(spark, sf_dir, "events").select("event_id", F.collect_list(F.round(F.col("value") * 100).cast("long")).over(w).alias("ring"))
    return d.select("event_id", F.array_join("ring", ",").alias("ring"), F.array_join(F.transform("ring", lambda x: 2 * x + 1), ",").alias("mapped"))


def ordered_maps(spark, sf_dir):
    """R-05: an order's lines as a map in their order, the largest part of each; looked up and listed."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), F.col("part").alias("v"))))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    d = lines.groupBy("l_orderkey").agg(F.map_from_entries(entries).alias("m"))
    return d.select("l_orderkey", F.array_join(F.map_keys("m"), ",").alias("keys"), F.array_join(F.map_values("m"), ",").alias("parts"), F.try_element_at("m", F.lit(2).cast(d.schema["m"].dataType.keyType)).alias("second"))


def state_plane(spark, sf_dir):
    """C-08: points of a quarter of a degree about the centre of a state plane, projected and taken back."""
    d = points(spark, sf_dir).select("id", (42.0 + F.col("lat") / 340).alias("lat"), (-71.5 + F.col("lon") / 180).alias("lon"))
    d = d.select("*", *[c.alias(n) for n, c in zip(("x", "y"), G.state_plane(F.col("lat"), F.col("lon")), strict=True)])
    lat, lon = G.from_state_plane(F.col("x"), F.col("y"))
    return d.select("id", r6(F.col("x"), "x", 3), r6(F.col("y"), "y", 3), ((F.abs(lat - F.col("lat")) < 1e-7) & (F.abs(lon - F.col("lon")) < 1e-7)).alias("back"))


def _leb(v: str) -> str:
    n = f"greatest(1, (length(bin({v})) + 6) // 7)"
    return f"array_to_string(list_transform(range({n}), lambda i: printf('%02X', (({v}) >> (7 * i)) & 127 | CASE WHEN i < {n} - 1 THEN 128 ELSE 0 END)), '')"


_U64 = " , ".join(f"('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT AS p{i}" for i in range(4))
_SWAP = "('0x' || " + " || ".join(f"substr(printf('%016X', f), {i}, 2)" for i in range(15, 0, -2)) + ")::UBIGINT"
_SIX = [f"(u >> {s}) & 2047" for s in (53, 42, 31, 20, 9)] + ["((u & 511) << 2) | (list_sum(list_transform(range(0, 64, 2), lambda s: (u >> s::UBIGINT) & 3))::UBIGINT & 3)"]
_TURNED = " | ".join(f"(((bits >> {8 * i}) & 255) << {48 - 8 * i})" for i in range(7))
_D = G.MASSACHUSETTS

QUERIES = {
    "float_forms": (float_forms, f"""WITH e AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, floor(log2(l_extendedprice))::INT AS g FROM lineitem),
        c AS (SELECT *, CASE WHEN pow(2.0, g) > v THEN g - 1 WHEN pow(2.0, g + 1) <= v THEN g + 1 ELSE g END AS x FROM e),
        b AS (SELECT *, ((x + 1023)::BIGINT << 52) + ((v / pow(2.0, x) - 1) * 4503599627370496)::BIGINT AS bits FROM c)
        SELECT l_orderkey, l_linenumber, bits, bits >> 52 AS exponent, bits & 4503599627370495 AS mantissa, {_TURNED} AS turned, xor(bits, lag(bits, 1, 0::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, bits)) AS changed FROM b"""),
    "byte_codes": (byte_codes, f"""SELECT o_orderkey, array_to_string(list_transform(range(n), lambda i: printf('%02X', (big >> (7 * (n - 1 - i))) & 127 | CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), '') AS high, {_leb("big")} AS low,
        CASE WHEN big <= 240 THEN 1 WHEN big <= 2287 THEN 2 WHEN big <= 67823 THEN 3 ELSE 1 + greatest(3, (length(bin(big)) + 7) // 8) END AS n_var, (o_orderkey % 256) || ',' || o_orderkey || ',' || (o_orderkey * 300) || ',' || o_custkey AS four, true AS same
        FROM (SELECT *, greatest(1, (length(bin(big)) + 6) // 7) AS n FROM (SELECT *, o_orderkey * o_orderkey * 7919 AS big FROM orders))"""),
    "block_streams": (block_streams, f"""WITH v AS (SELECT user_id, ts, event_id, round(value * 100)::BIGINT AS v FROM events WHERE value IS NOT NULL),
        d AS (SELECT user_id, v - lag(v, 1, 0::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM v), z AS (SELECT user_id, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS z FROM d)
        SELECT user_id, (count(*) + {BLOCK - 1}) // {BLOCK} AS blocks, 8 * count(*) AS number_bytes, sum(greatest(1, (length(bin(z)) + 6) // 7))::BIGINT AS coded_bytes, true AS intact FROM z GROUP BY 1"""),
    "lzw_roundtrip": (lzw, "SELECT doc_id, strlen(text) AS bytes, true AS same FROM documents WHERE text IS NOT NULL"),
    "wire_messages": (wire_messages, f"SELECT c_custkey, '08' || {_leb('c_custkey')} || '12' || {_leb('strlen(c_name)')} || hex(encode(c_name)) || '18' || {_leb('z')} AS message FROM (SELECT *, CASE WHEN c < 0 THEN -2 * c - 1 ELSE 2 * c END AS z FROM (SELECT *, round(c_acctbal * 100)::BIGINT AS c FROM customer))"),
    "fixed_records": (records, """SELECT l_orderkey, l_linenumber, printf('%016X', l_orderkey) || printf('%04X', l_linenumber) || right(printf('%016X', q), 8) AS bytes, l_orderkey AS "order", l_linenumber::BIGINT * 256 AS swapped, q AS quantity, right(lpad(bin(l_linenumber), 16, '0'), 16) AS bits
        FROM (SELECT *, round(l_quantity)::BIGINT - 25 AS q FROM lineitem)"""),
    "uuids": (uuids, "SELECT c_custkey, regexp_replace(upper(md5(c_name)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid, md5(c_name) AS parsed, true AS short, true AS random FROM customer"),
    "number_alphabets": (alphabets, "SELECT o_orderkey, " + ", ".join(f"array_to_string(list_transform(range(greatest(0, floor(log(o_orderkey + 0.5) / log({len(a)})))::BIGINT, -1, -1), lambda i: substr('{a}', (o_orderkey // pow({len(a)}, i)::BIGINT % {len(a)} + 1)::BIGINT, 1)), '') AS {n}" for n, a in B.ALPHABETS.items()) + " FROM orders"),
    "hexdumps": (hexdumps, """SELECT c_custkey, array_to_string(list_transform(range(0, strlen(c_name), 16), lambda i: printf('%08X', i) || '  ' || rpad(regexp_replace(substr(hex(encode(c_name)), 2 * i + 1, 32), '(..)', '\\1 ', 'g'), 48, ' ') || ' |' || rpad(substr(c_name, i + 1, 16), 16, ' ') || '|' || chr(10)), '') AS dump FROM customer"""),
    "digest_words": (digest_words, f"""WITH p AS (SELECT doc_id, s, {_U64} FROM (SELECT doc_id, sha256(text) AS h, sha1(text) AS s FROM documents)), f AS (SELECT doc_id, s, xor(xor(p0, p1), xor(p2, p3)) AS f, ('0x' || right(s, 1))::INT AS o FROM p), u AS (SELECT *, {_SWAP} AS u FROM f)
        SELECT doc_id, CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS folded, {" || ' ' || ".join(f"({x})" for x in _SIX)} AS six, CASE WHEN u IS NOT NULL THEN true END AS back,
        (('0x' || substr(s, 2 * o + 1, 8))::BIGINT & 2147483647) % 1000000 || '' AS decimal, upper(substr(s, 2 * o + 3, 6)) AS hexadecimal FROM u"""),
    "hash_registry": (hash_registry, None),
    "matrices": (matrices, """WITH a AS (SELECT p_partkey, p_partkey % 7 + 10 AS a, p_partkey % 5 AS b, p_partkey % 3 AS c, p_partkey % 4 AS d, p_partkey % 11 + 12 AS e, p_partkey % 2 AS f, p_partkey % 6 AS g, p_partkey % 9 AS h, p_partkey % 13 + 16 AS i, p_partkey % 10 AS r FROM part),
        m AS (SELECT *, (a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))::DOUBLE AS det FROM a)
        SELECT p_partkey, round((1 * (e * i - f * h) - b * (2 * i - f * r) + c * (2 * h - e * r)) / det + 1e-9, 6) AS x0, round((a * (2 * i - f * r) - 1 * (d * i - f * g) + c * (d * r - 2 * g)) / det + 1e-9, 6) AS x1, round((a * (e * r - 2 * h) - b * (d * r - 2 * g) + 1 * (d * h - e * g)) / det + 1e-9, 6) AS x2,
        (a * d + b * e + c * f)::DOUBLE AS gram, round(abs(det), 6) AS det, (g * 100 + c)::DOUBLE AS corner FROM m"""),
    "rotations": (rotations, f"""WITH p AS (SELECT id, lon AS x, lat AS y, 5.0 AS z, lat / 50 AS a, 0.5 AS b, lon / 70 AS c FROM {POINTS_SQL}), q AS (SELECT id, x, y * cos(a) - z * sin(a) AS y, y * sin(a) + z * cos(a) AS z, b, c FROM p),
        r AS (SELECT id, x * cos(b) + z * sin(b) AS x, y, z * cos(b) - x * sin(b) AS z, c FROM q) SELECT id, round(x * cos(c) - y * sin(c), 6) AS x, round(x * sin(c) + y * cos(c), 6) AS y, round(z, 6) AS z FROM r"""),
    "permutations": (permutations, """WITH l AS (SELECT r_regionkey, i, substr(r_name, i::BIGINT, 1) AS c FROM region, range(1, 5) t(i))
        SELECT a.r_regionkey, a.c || b.c || d.c || e.c AS word FROM l a JOIN l b ON a.r_regionkey = b.r_regionkey AND a.i <> b.i JOIN l d ON a.r_regionkey = d.r_regionkey AND d.i NOT IN (a.i, b.i) JOIN l e ON a.r_regionkey = e.r_regionkey AND e.i NOT IN (a.i, b.i, d.i)"""),
    "random_draws": (random_draws, None),
    "color_forms": (color_forms, """WITH c AS (SELECT p_partkey, (k >> 16 & 255) / 255.0::DOUBLE AS r, (k >> 8 & 255) / 255.0::DOUBLE AS g, (k & 255) / 255.0::DOUBLE AS b FROM (SELECT p_partkey, p_partkey * 2654435 % 16777216 AS k FROM part)), v AS (SELECT *, g + r * least(g, 1 - g) AS v FROM c)
        SELECT p_partkey, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(CASE WHEN v < 0.001 THEN 0 ELSE 2 * (1 - g / v) END, 6) AS sat, round(v, 6) AS val FROM v"""),
    "last_values": (last_values, """SELECT event_id, array_to_string(list_filter(r, lambda x: x IS NOT NULL), ',') AS ring, array_to_string(list_transform(list_filter(r, lambda x: x IS NOT NULL), lambda x: 2 * x + 1), ',') AS mapped
        FROM (SELECT event_id, list(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS r FROM events)"""),
    "ordered_maps": (ordered_maps, "SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS keys, string_agg(l_partkey, ',' ORDER BY l_linenumber) AS parts, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS second FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1"),
    "state_plane": (state_plane, f"""WITH p AS (SELECT id, 42.0 + lat / 340 - {_D["lat"]} AS d, radians({_D["lon"]} - (-71.5 + lon / 180)) * sin(radians({_D["lat"]})) AS t FROM {POINTS_SQL}),
        u AS (SELECT id, t, d * ({_D["forward"][0]} + d * ({_D["forward"][1]} + d * ({_D["forward"][2]} + d * {_D["forward"][3]}))) AS u FROM p), e AS (SELECT id, t, u, ({_D["radius"]} - u) * sin(t) AS e FROM u)
        SELECT id, round({_D["east"]} - e, 3) AS x, round({_D["north"]} + u + e * tan(t / 2), 3) AS y, true AS back FROM e"""),
}
