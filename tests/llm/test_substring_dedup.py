"""Operator 10 against plain Python; a full sketch changes nothing."""

import random

import pytest

from tidemark.llm import chunks
from tidemark.llm import substring_dedup as S


def brute(rows):
    ws = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in ws:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            least[k] = min(least.get(k, 1 << 70), 1 << 63 if d is None else d)
    out = []
    for d, w in ws:
        own = 1 << 63 if d is None else d
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < own for j in range(i, i + 13)}
        out.append((repr(d), len(w), len(gone), " ".join(x.decode() for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passages = [new(60), new(13), new(12), ["a"] * 40]
    out = [(1, None), (2, ""), (3, " \t"), (None, " ".join(passages[0])), (None, "é " + " x ".join(passages[1]))]
    for d in range(10, 80):
        w = new(rng.randrange(0, 50))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            i, k = rng.randrange(0, len(p)), rng.randrange(0, len(w) + 1)
            w[k:k] = p[:i] if rng.random() < 0.3 else p
        out.append((d, "  ".join(w)))
    out += [(5, out[30][1]), (30, out[30][1]), (30, out[40][1]), (90, " ".join(passages[0] * 300))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [1 << 24, 500])
def test_against_plain_python(spark, rows, chunk, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, did int, AT binary").repartition(6)
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(df).collect())
    assert got == brute(rows)


def test_saturated_sketch_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "width_of", lambda n: 64)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(df).collect()) == brute(rows)


@pytest.mark.parametrize("n", [60, 600])
def test_sketch_filters_at_any_size(spark, n):
    """Windows that pass are near those that are repeated, for blocks of one size, and texts stay where they are."""
    import numpy as np

    rng = random.Random(n)
    passage = [f"p{i}" for i in range(40)]
    docs = [(d, " ".join([f"u{rng.randrange(10**9)}" for _ in range(500)] + (passage if d % 10 == 0 else []))) for d in range(n)]
    table = S.chunked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    size = sum(len(t) for _, t in docs)
    found = S.repeats(table, size)
    seen = sum(len(np.frombuffer(r.pos, np.int32)) for r in found.select("pos").collect())
    repeated = n // 10 * 28
    assert repeated <= seen <= 1.6 * repeated + 0.04 * 500 * n  # windows at the passage's edge have its minimizers
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert not any("Exchange" in x and "text" in x for x in plan.split("\n"))


def test_rows_with_colliding_32_bit_hashes(spark):
    a, b = "shared line\nA18054", "B10682"
    w = " ".join(f"w{i}" for i in range(20))
    rows = [(1, w), (None, f"{a} {w}"), (None, b), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(df).collect())
    assert got == brute(rows)


def test_a_long_text(spark):
    w = [f"w{i}" for i in range(100_000)]
    rows = [(1, " ".join(w[50_000:50_030])), (2, " ".join(w)), (3, " ".join(w[:20] * 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in S.substring_dedup(df).collect()) == brute(rows)


def test_empty(spark):
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
