"""Queries on sources, joins, sets and graphs (IO-*, J-*, U-*, N-*, L-*, F-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.plans.common import POINTS_SQL, micros, points, r6, read
from tidemark.sources import csv, geofiles, nmea


def _shared(spark) -> str:
    """A new folder that executors can write."""
    import uuid

    return f"{G.shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"


def csv_roundtrip(spark, sf_dir):
    """IO-01..IO-07: customers through a pipe-separated file and back."""
    path = _shared(spark)
    d = read(spark, sf_dir, "customer").withColumn("note", F.concat(F.lit('a "b"| c,'), F.col("c_custkey").cast("string")))
    csv.write_csv(d, path, "pipe")
    b = csv.read_csv(spark, path, "pipe", comment=None, multi_line=False)
    return b.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment", "note")


def csv_maps(spark, sf_dir):
    """IO-03, IO-04: rows as maps from header to field."""
    path = _shared(spark)
    csv.write_csv(read(spark, sf_dir, "nation"), path, "unix_tab")
    row = F.col("row")
    return csv.read_rows(spark, path, "unix_tab").select(row["n_nationkey"].cast("long").alias("k"), row["n_name"].alias("name"), F.array_join(F.sort_array(F.map_keys("row")), ",").alias("keys"))


def tokenizer(spark, sf_dir):
    """IO-06: fields at commas or semicolons outside quotes."""
    line = F.concat(F.col("c_name"), F.lit(',"x;y,'), F.col("c_custkey").cast("string"), F.lit('";'), F.col("c_mktsegment"))
    t = csv.tokens(line)
    return read(spark, sf_dir, "customer").select("c_custkey", F.size(t).cast("long").alias("n"), F.element_at(t, 2).alias("second"), F.element_at(t, 3).alias("third"))


def _gga(spark, sf_dir):
    p = points(spark, sf_dir)
    line = nmea.build_gga(F.col("id") * 7 % 86400, F.col("lat"), F.col("lon"), F.col("id") % 3, F.col("id") % 12, F.lit(1.5), (F.col("id") % 500).cast("double"), F.lit(-34.0))
    return p.select("id", "lat", "lon", line.alias("line"))


def nmea_build(spark, sf_dir):
    """IO-22, IO-24: sentences and their checksums."""
    return _gga(spark, sf_dir).select("id", F.length("line").cast("long").alias("length"), F.expr("right(line, 2)").alias("sum"), F.substring("line", 1, 13).alias("head"))


def nmea_roundtrip(spark, sf_dir):
    """IO-20..IO-25: sentences read back to positions."""
    d = nmea.gga(nmea.parsed(_gga(spark, sf_dir).select("id", "line")))
    return d.select("id", "checksum_ok", F.col("seconds").cast("long").alias("seconds"), r6(F.col("lat"), "lat", 5), r6(F.col("lon"), "lon", 5), "quality", "satellites", "hdop", "altitude")


def nmea_fixes(spark, sf_dir):
    """IO-27, J-02: each GGA with the latest ZDA of its stream; every tenth sentence is a ZDA."""
    zda = nmea.sentence(F.concat(F.lit("GPZDA,"), F.date_format(F.timestamp_seconds(1704067200 + F.col("id") * 10), "HHmmss.00,dd,MM,yyyy"), F.lit(",00,00")))
    d = _gga(spark, sf_dir).select("id", (F.col("id") % 7).alias("stream"), F.when(F.col("id") % 10 == 0, zda).otherwise(F.col("line")).alias("line"))
    return nmea.fixes(nmea.parsed(d), "id", ["stream"]).select("id", F.col("zda").cast("long").alias("zda"))


def position_reports(spark, sf_dir):
    """IO-34: reports as JSON, read back."""
    j = geofiles.tpv(F.lit(1704067200000000) + F.col("id") * 1_000_000, F.col("lat"), F.col("lon"), F.lit(12.5), F.lit(3.0))
    return points(spark, sf_dir).select("id", F.get_json_object(j, "$.class").alias("class"), F.get_json_object(j, "$.time").alias("time"), F.get_json_object(j, "$.lat").cast("double").alias("lat"))


def tile_merge(spark, sf_dir):
    """IO-51..IO-54, U-01: two tile packages merged, the later wins; distinct data by hash."""
    p = points(spark, sf_dir)
    t = lambda d, s: d.select((F.col("id") % 4).alias("zoom"), (F.col("id") % 32).alias("col"), (F.col("id") % 8).alias("row"), F.encode(F.concat(F.lit(s), (F.col("id") % 32).cast("string")), "UTF-8").alias("data")).distinct()
    m = geofiles.merge_tiles([t(p, "a"), t(p.where("id % 32 < 10"), "b")])
    return m.select("zoom", "col", "row", F.decode("data", "UTF-8").alias("data"))


def tags_and_fields(spark, sf_dir):
    """J-04, IO-60: tags and fields of measurements, full outer by name."""
    e = read(spark, sf_dir, "events")
    tags = e.where("event_type <> 'click'").groupBy("event_type").agg(F.countDistinct("user_id").alias("tags"))
    fields = e.where("event_type <> 'view'").groupBy("event_type").agg(F.count("*").alias("fields"))
    return tags.join(fields, "event_type", "full").select("event_type", F.coalesce("tags", F.lit(0)).alias("tags"), F.coalesce("fields", F.lit(0)).alias("fields"))


def track_points(spark, sf_dir):
    """J-05: tracks with their subtracks (orders with their lines)."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("points"), F.countDistinct("o_orderkey").alias("tracks"))


def zipped(spark, sf_dir):
    """J-01: two sequences in lockstep, by place: events of two types."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = lambda t, n: e.where(F.col("event_type") == t).select("user_id", F.row_number().over(w).cast("long").alias("k"), F.col("value").alias(n))
    return side("click", "a").join(side("view", "b"), ["user_id", "k"])


def retain_take(spark, sf_dir):
    """F-06, F-07: kept and taken rows by a predicate; a cast that may fail."""
    d = read(spark, sf_dir, "part").withColumn("n", F.substring("p_brand", 7, 2).try_cast("int"))
    side = F.when(F.coalesce(F.col("n") > 20, F.lit(False)), "taken").otherwise("kept")
    return d.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def point_order(spark, sf_dir):
    """L-01, L-07: all points with their ranks by x, then y: a range sort, and within each part the ranks of the parts before."""
    path = _shared(spark)
    points(spark, sf_dir).orderBy("lon", "lat", "id").select("id", "lon", "lat", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    d = spark.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    before, start = 0, []
    for r in d.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # a row for each part
        start.append((r.part, before))
        before += r.n
    first = F.broadcast(spark.createDataFrame(start, "part long, before long"))
    return d.join(first, "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"), "id", "lon", "lat")


def range_steps(spark, sf_dir):
    """F-04: values from each part's size to 50 by 7, by a generator."""
    d = read(spark, sf_dir, "part").where("p_size <= 50").select("p_partkey", F.explode(F.sequence(F.col("p_size").cast("long"), F.lit(50).cast("long"), F.lit(7).cast("long"))).alias("v"))
    return d


def keyed_union(spark, sf_dir):
    """U-02, U-03: first rows by key of two tables."""
    a = read(spark, sf_dir, "nation").where("n_nationkey < 15").select("n_nationkey", F.concat(F.lit("a "), "n_name").alias("name"))
    b = read(spark, sf_dir, "nation").where("n_nationkey > 9").select("n_nationkey", F.concat(F.lit("b "), "n_name").alias("name"))
    return G.merged(a, b, "n_nationkey")


def _edges(spark, sf_dir):
    n, s, c = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    of = lambda d, x, k, y, v, cost: d.select(F.concat(F.lit(x), F.col(k).cast("string")).alias("src"), F.concat(F.lit(y), F.col(v).cast("string")).alias("dst"), F.lit(True).alias("directed"), cost.cast("double").alias("cost"))
    return of(n, "r", "n_regionkey", "n", "n_nationkey", F.lit(1)).unionByName(of(s, "n", "s_nationkey", "s", "s_suppkey", F.col("s_suppkey") % 5 + 1)).unionByName(of(c, "n", "c_nationkey", "c", "c_custkey", F.col("c_custkey") % 7 + 1))


_EDGES = "(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 1.0::DOUBLE AS cost FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, (s_suppkey % 5 + 1)::DOUBLE FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, (c_custkey % 7 + 1)::DOUBLE FROM customer)"


def graph_bfs(spark, sf_dir):
    """N-03, J-03."""
    b = G.bfs(_edges(spark, sf_dir), spark.range(2).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id")))
    return b.select("id", "level", F.array_join("path", ">").alias("path"))


def graph_roots(spark, sf_dir):
    """N-02, N-06: terminal nodes of the graph and of the inverted one."""
    e = _edges(spark, sf_dir)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    a = G.roots(nodes, e).withColumn("kind", F.lit("root"))
    return a.unionByName(G.roots(nodes, G.inverted(e)).withColumn("kind", F.lit("leaf")))


def graph_updown(spark, sf_dir):
    """N-07: all above and below two nations."""
    return G.updown(_edges(spark, sf_dir), spark.range(3, 5).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id")))


def graph_apsp(spark, sf_dir):
    """N-05: distances and next hops from all regions and nations."""
    e = _edges(spark, sf_dir)
    s = e.select(F.col("src").alias("id")).distinct()
    return G.shortest_paths(e, s)


def graph_dfs(spark, sf_dir):
    """N-04."""
    return G.depth_first(_edges(spark, sf_dir), "r1")


def graph_layers(spark, sf_dir):
    """N-10: a layered placement below the regions."""
    e = _edges(spark, sf_dir)
    return G.layered_layout(G.bfs(e, e.where("src like 'r%'").select(F.col("src").alias("id"))))


def dot_graph(spark, sf_dir):
    """IO-68."""
    return geofiles.dot_lines(_edges(spark, sf_dir))


def coded_series(spark, sf_dir):
    """IO-65, S-30, S-31: a series through a Parquet file and back."""
    path = _shared(spark)
    d = read(spark, sf_dir, "events").select(micros(F.col("ts")).alias("us"), "event_id", "value")
    d.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


_DM = lambda v, d: f"printf('%0{d}d%02d.%05d', u_{v} // 6000000, u_{v} // 100000 % 60, u_{v} % 100000)"
_GGA_SQL = f"""SELECT id, length(body) + 4::BIGINT AS length, printf('%02X', list_reduce(list_transform(range(1, length(body) + 1), lambda i: ascii(body[i])::BIGINT), lambda x, y: xor(x, y))) AS sum, left('$' || body, 13) AS head FROM
    (SELECT id, 'GPGGA,' || printf('%02d%02d%02d.00', s // 3600, s // 60 % 60, s % 60) || ',' || {_DM('lat', 2)} || CASE WHEN lat < 0 THEN ',S,' ELSE ',N,' END || {_DM('lon', 3)} || CASE WHEN lon < 0 THEN ',W,' ELSE ',E,' END
      || (id % 3) || ',' || lpad((id % 12)::VARCHAR, 2, '0') || ',1.5,' || (id % 500) || '.0,M,-34.0,M,,' AS body FROM
    (SELECT id, lat, lon, id * 7 % 86400 AS s, round(abs(lat) * 6000000)::BIGINT AS u_lat, round(abs(lon) * 6000000)::BIGINT AS u_lon FROM {POINTS_SQL}))"""
QUERIES = {
    "csv_roundtrip": (csv_roundtrip, "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, 'a \"b\"| c,' || c_custkey AS note FROM customer"),
    "csv_maps": (csv_maps, "SELECT n_nationkey::BIGINT AS k, n_name AS name, 'n_name,n_nationkey,n_regionkey' AS keys FROM nation"),
    "tokenizer": (tokenizer, "SELECT c_custkey, 3::BIGINT AS n, '\"x;y,' || c_custkey || '\"' AS second, c_mktsegment AS third FROM customer"),
    "nmea_build": (nmea_build, _GGA_SQL),
    "nmea_roundtrip": (nmea_roundtrip, f"""SELECT id, true AS checksum_ok, id * 7 % 86400 AS seconds, round(sign(lat) * round(abs(lat) * 6000000) / 6000000, 5) AS lat, round(sign(lon) * round(abs(lon) * 6000000) / 6000000, 5) AS lon,
        (['invalid', 'gps', 'dgps'])[(id % 3 + 1)::INT] AS quality, (id % 12)::INT AS satellites, 1.5::DOUBLE AS hdop, (id % 500)::DOUBLE AS altitude FROM {POINTS_SQL}"""),
    "nmea_fixes": (nmea_fixes, "SELECT id, zda FROM (SELECT o_orderkey AS id, last_value(CASE WHEN o_orderkey % 10 = 0 THEN 1704067200 + o_orderkey * 10 END IGNORE NULLS) OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zda FROM orders) WHERE id % 10 <> 0"),
    "position_reports": (position_reports, f"SELECT id, 'TPV' AS class, strftime(TIMESTAMP '2024-01-01' + id * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.000Z') AS time, lat FROM {POINTS_SQL}"),
    "tile_merge": (tile_merge, "SELECT DISTINCT o_orderkey % 4 AS zoom, o_orderkey % 32 AS col, o_orderkey % 8 AS row, CASE WHEN o_orderkey % 32 < 10 THEN 'b' ELSE 'a' END || (o_orderkey % 32) AS data FROM orders"),
    "tags_and_fields": (tags_and_fields, "SELECT event_type, CASE WHEN event_type <> 'click' THEN count(DISTINCT user_id) ELSE 0 END AS tags, CASE WHEN event_type <> 'view' THEN count(*) ELSE 0 END AS fields FROM events GROUP BY event_type"),
    "track_points": (track_points, "SELECT o_custkey, count(*) AS points, count(DISTINCT o_orderkey) AS tracks FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"),
    "zipped": (zipped, "WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT a.user_id, a.k, a.value AS a, b.value AS b FROM s a JOIN s b ON a.user_id = b.user_id AND a.k = b.k AND a.event_type = 'click' AND b.event_type = 'view'"),
    "retain_take": (retain_take, "SELECT CASE WHEN coalesce(TRY_CAST(substring(p_brand, 7, 2) AS INT) > 20, false) THEN 'taken' ELSE 'kept' END AS side, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1"),
    "point_order": (point_order, f"SELECT id, lon, lat, row_number() OVER (ORDER BY lon, lat, id) AS rank FROM {POINTS_SQL}"),
    "range_steps": (range_steps, "SELECT p_partkey, unnest(range(p_size::BIGINT, 51, 7)) AS v FROM part WHERE p_size <= 50"),
    "keyed_union": (keyed_union, "SELECT n_nationkey, CASE WHEN n_nationkey < 15 THEN 'a ' ELSE 'b ' END || n_name AS name FROM nation"),
    "graph_bfs_levels": (graph_bfs, f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), b AS (SELECT 'r0' AS id, 0::BIGINT AS level, 'r0' AS path UNION ALL SELECT 'r1', 0, 'r1' UNION ALL SELECT e.dst, b.level + 1, b.path || '>' || e.dst FROM b JOIN e ON e.src = b.id) SELECT * FROM b"""),
    "graph_roots": (graph_roots, f"WITH e AS (SELECT * FROM {_EDGES}) SELECT DISTINCT src AS id, 'root' AS kind FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT DISTINCT dst, 'leaf' FROM e WHERE dst NOT IN (SELECT src FROM e)"),
    "graph_updown": (graph_updown, f"WITH e AS (SELECT * FROM {_EDGES}) SELECT id FROM (SELECT 'n3' AS id UNION SELECT 'n4' UNION SELECT dst FROM e WHERE src IN ('n3', 'n4') UNION SELECT src FROM e WHERE dst IN ('n3', 'n4'))"),
    "graph_apsp": (graph_apsp, f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), b AS (SELECT DISTINCT src, src AS dst, 0.0::DOUBLE AS cost, NULL::VARCHAR AS hop FROM e UNION ALL SELECT b.src, e.dst, b.cost + e.cost, coalesce(b.hop, e.dst) FROM b JOIN e ON e.src = b.dst) SELECT src, dst, cost, hop FROM b"""),
    "graph_dfs": (graph_dfs, f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), b AS (SELECT 'r1' AS id, 'r1' AS path UNION ALL SELECT e.dst, b.path || '!' || e.dst FROM b JOIN e ON e.src = b.id)
        SELECT id, row_number() OVER (ORDER BY path) - 1 AS place FROM b"""),
    "graph_layers": (graph_layers, f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES}), b AS (SELECT DISTINCT src AS id, 0::BIGINT AS y FROM e WHERE src LIKE 'r%' UNION ALL SELECT e.dst, b.y + 1 FROM b JOIN e ON e.src = b.id) SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY id) - 1 AS x FROM b"""),
    "dot_graph": (dot_graph, f"SELECT '\"' || src || '\" -> \"' || dst || '\" [label=' || cost::DECIMAL(9, 1) || '];' AS line FROM {_EDGES}"),
    "coded_series": (coded_series, "SELECT epoch_us(ts) AS us, event_id, value FROM events"),
}
