"""Operator 4: targets against the clamping loop, taken words against targets."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing as M


def loop(sizes, weights=(1, 2, 3), most=3):
    """Clamp what is above its cap, share the rest by weight, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    rows, sizes = [], {}
    for s in ["a", "b", "c", "é", "d", "zz", None, "B"]:
        for i in range(rng.choice([1, 3, 40, 300])):
            n = rng.randrange(0, 40)
            rows.append((len(rows), s, " ".join(["w"] * n) if n or i % 2 else None, 1))
            sizes[s] = sizes.get(s, 0) + n
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, Size int").repartition(3)
    got = M.mixing(df).collect()
    want, taken = loop(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        s = by[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
        assert sum(1 for r in got if by[r.doc_id] == s and r["size"] and r.taken % r["size"]) <= 1  # one document a source is cut
    assert sorted(map(tuple, M.mixing(df.repartition(5)).collect())) == sorted(map(tuple, got))


def test_stage_takes_what_the_query_says(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0], "x y z " * (i % 5), "e") for i in range(200)] + [(None, None, None, "n")], "doc_id long, source string, text string, copy string")
    got = M.mixing_stage(spark, df, "")
    assert got.columns == ["doc_id", "source", "text", "copy", "copy_", "taken"]
    per = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert per == {r.doc_id: r.taken for r in M.mixing(df).collect() if r.taken}
    assert all(len((r.text or "").split()) == r.taken for r in got.collect())


def test_cut_texts_keep_their_white_space(spark):
    texts = {1: "\n  a\tb\n\nc  d e f  \n", 2: "one two\n three", 3: " x\n"}
    df = spark.createDataFrame([(i, "s" if i < 3 else "t", t) for i, t in texts.items()], "doc_id long, source string, text string")
    cut = [r for r in M.mixing_stage(spark, df, "").collect() if r.taken < len(texts[r.doc_id].split())]
    for r in cut:
        assert texts[r.doc_id].startswith(r.text) and r.text.split() == texts[r.doc_id].split()[: r.taken] and not r.text[-1].isspace()
    assert cut


def test_rows_without_ids(spark):
    """All rows of a source share the id's hash, so one bin and one finer bin hold them all; equal rows share one key."""
    rows = [(None, "a", "w " * (i % 9)) for i in range(300)] + [(7, "b", "v v v")] * 40 + [(i, None, "u " * 30) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.mixing(df).collect()
    sizes = {"a": sum(i % 9 for i in range(300)), "b": 120, None: 1500}
    by_size = {r.source_size: r.target for r in got}
    want = loop(sizes)
    for s, n in sizes.items():
        assert by_size[n] == pytest.approx(want[s])
        assert abs(sum(r.taken for r in got if r.source_size == n) - want[s]) <= 40


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mixing(df).count() == 0
    zero = spark.createDataFrame([(1, "a", None), (2, "b", "")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in M.mixing(zero).collect()] == [(0.0, 0), (0.0, 0)]
