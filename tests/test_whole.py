"""Registered queries against brute force on values longer than those of the tables."""

import hashlib
import hmac

import numpy as np

from tidemark.plans import registry


def run(spark, name, tmp_path, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return registry.queries()[name](spark, str(tmp_path)).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_hmac(spark, tmp_path):
    texts = {1: "x" * 200 + "a", 2: "x" * 200 + "b", 3: "", 4: "é" * 500}
    got = {r.doc_id: r for r in run(spark, "hmac", tmp_path, "documents", list(texts.items()), "doc_id long, text string")}
    for k, t in texts.items():
        assert got[k].agree and (got[k].sha256, got[k].sha512) == tuple(hmac.new(b"key", t.encode(), h).hexdigest() for h in (hashlib.sha256, hashlib.sha512))


def test_edit_distance(spark, tmp_path):
    rows = [(1, "p" * 70 + "kitten", "p" * 70 + "sitting"), (2, "", "é"), (3, None, "a")]
    got = {r.p_partkey: r.distance for r in run(spark, "edit_distance", tmp_path, "part", rows, "p_partkey long, p_name string, p_type string")}
    assert got == {k: None if a is None else distance(a.encode(), b.encode()) for k, a, b in rows}


def test_match_score(spark, tmp_path):
    rows = [(1, "abc" * 300 + "z", "web z"), (2, "é" * 100, "é"), (3, None, "a"), (4, "", "a")]
    got = {r.doc_id: (r.own, r.source) for r in run(spark, "char_match_score", tmp_path, "documents", rows, "doc_id long, text string, source string")}
    score = lambda a, b: sum(x == y for x in a.encode() for y in b.encode())
    assert got == {k: (None, None) if t is None else (score(t, t), score(t, s)) for k, t, s in rows}


def test_array_forms(spark, tmp_path):
    rows = [(1, [i / 100 for i in range(64)]), (2, [0.5]), (3, [])]
    got = {r.vec_id: r for r in run(spark, "array_forms", tmp_path, "embeddings", rows, "vec_id long, embedding array<double>")}
    for k, e in rows:
        e, r = [round(x * 100) for x in e], got[k]
        s = [str(x) for x in e]
        assert r.joined == ", ".join(s) and r.reversed == ",".join(s[::-1]) and r.padded == ",".join([*s, "0", "0"])
        assert r.looped == ",".join(s[i % len(s)] for i in range(len(s) + 3) if s)
        assert r.chunks == "|".join("+".join(s[i : i + 2]) for i in range(0, len(s), 2)) and r.pretty == "[" + ",".join(s) + "]"


def test_array_forms_floats(spark, tmp_path):
    import duckdb

    ties = [x for x in np.arange(0.105, 0.6, 0.01).astype("float32") if float(x) * 100 != float(x * np.float32(100))]  # the product rounds to a half only as a float
    rows = [(1, [float(x) for x in ties]), (2, [-float(x) for x in ties]), (3, [None, None, 0.5, None, 1.25]), (4, [None]), (5, None), (6, []), (7, [-0.004, 0.005, 0.015, -0.005])]
    got = run(spark, "array_forms", tmp_path, "embeddings", rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert len(ties) > 3 and sorted(map(tuple, got)) == con.sql(registry.oracle_sql()["array_forms"] + " ORDER BY vec_id").fetchall()


def place(k):
    return (k * 7919 % 17000) / 100 - 85, (k * 104729 % 36000) / 100 - 180


def test_near_pairs(spark, tmp_path):
    ids = [*range(1, 1200), 17000 * 36 + 2]  # the last is where 2 is: ids of equal parity
    got = sorted((r.a, r.b) for r in run(spark, "near_pairs", tmp_path, "orders", [(k,) for k in ids], "o_orderkey long"))
    near = lambda a, b: (place(a)[0] - place(b)[0]) ** 2 + (place(a)[1] - place(b)[1]) ** 2 <= 9
    assert got == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(a, b)] and (2, ids[-1]) in got


def moved(plan):
    """Rows that a plan's exchanges have shuffled or broadcast."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return moved(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return moved(plan.plan())
    below, found = plan.children(), plan.metrics().get("shuffleRecordsWritten" if plan.nodeName() == "Exchange" else "numOutputRows")
    return (found.get().value() if "Exchange" in plan.nodeName() and found.isDefined() else 0) + sum(moved(below.apply(i)) for i in range(below.size()))


def test_near_pairs_copies(spark, tmp_path):
    """Copies at one place are paired, not tested or sent to the neighbours one by one; lists end at their block; no null and no id twice makes a pair."""
    period = 17000 * 36
    ids = [k + i * period for k in (1, 2, 3, 36000) for i in [*range(120), 1023, 1024, 5000]] + [None, None, 7, 7]
    spark.createDataFrame([(k,) for k in ids], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    df = registry.queries()["near_pairs"](spark, str(tmp_path))
    got = sorted((r.a, r.b) for r in df.collect())
    near = lambda a, b: (place(a)[0] - place(b)[0]) ** 2 + (place(a)[1] - place(b)[1]) ** 2 <= 9
    known = sorted(k for k in ids if k is not None)
    assert got == [(a, b) for i, a in enumerate(known) for b in known[i + 1 :] if a < b and near(a, b)] and (1, 1 + 5000 * period) in got
    assert moved(df._jdf.queryExecution().executedPlan()) < 3 * len(ids)


def nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        return nodes(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return nodes(plan.plan())
    below = plan.children()
    return [plan] + [x for i in range(below.size()) for x in nodes(below.apply(i))]


def test_near_pairs_once(spark, tmp_path):
    """A pair is made once, not in both orders, and the generated code that holds the pairs of an input row starts from two places, not from two cells."""
    period = 17000 * 36
    ids = [k for k in range(period) if max(map(abs, place(k))) < 2]
    ids += [k + period for k in ids] + [ids[0] + i * period for i in (127, 128, 129)]
    spark.createDataFrame([(k,) for k in ids], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    df = registry.queries()["near_pairs"](spark, str(tmp_path))
    got = sorted((r.a, r.b) for r in df.collect())
    near = lambda a, b: (place(a)[0] - place(b)[0]) ** 2 + (place(a)[1] - place(b)[1]) ** 2 <= 9
    assert got == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near(a, b)] and len(got) > 20 * len(ids)
    plan = nodes(df._jdf.queryExecution().executedPlan())
    names, made = [x.nodeName() for x in plan], [x.metrics().get("numOutputRows").get().value() for x in plan if x.nodeName() == "Generate"]
    assert made[0] <= len(got) + 2 * len(ids)
    assert "Coalesce" in names[: names.index("SortMergeJoin")]


def test_tile_cover(spark, tmp_path):
    from math import asinh, floor, pi, radians, tan

    want = set()
    for k in range(1, 120):
        lat, lon = place(k)
        y = lambda p, n: (1 - asinh(tan(radians(p))) / pi) / 2 * n
        for z in range(3, 7):
            n = 2**z
            for i in range(max(floor((lon + 180) / 360 * n), 0), min(floor((lon + 184) / 360 * n), n - 1) + 1):
                want |= {(k, z, i, j) for j in range(max(floor(y(lat + 2, n)), 0), min(floor(y(lat - 2, n)), n - 1) + 1)}
    got = run(spark, "tile_cover", tmp_path, "orders", [(k,) for k in range(1, 120)], "o_orderkey long")
    assert sorted((r.id, r.zoom, r.x, r.y) for r in got) == sorted(want) and all(r.path == f"{r.zoom}/{r.x}/{r.y}" for r in got)


def test_point_order(spark, tmp_path):
    ids = [*range(1, 900), 17000 * 36 + 2]
    got = run(spark, "point_order", tmp_path, "orders", [(k,) for k in ids], "o_orderkey long")
    want = sorted(ids, key=lambda k: (place(k)[1], place(k)[0], k))
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got) == list(range(1, len(ids) + 1))
