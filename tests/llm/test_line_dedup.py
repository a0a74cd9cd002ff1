"""Operator 5 against plain Python, with runs that cross partitions and batches."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup as L

WS = " \t\n\x0b\x0c\r"


def key(x):
    return x.strip(WS).translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least):
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    bad = {k for k, v in docs.items() if k and len(v) >= least}
    return [(d, [x for x in (t or "").split("\n")], [key(x) not in bad for x in (t or "").split("\n")]) for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    common = [f" Line {i} É\r" for i in range(12)]
    out = [(None, "line 0 É\nx"), (None, "LINE 0 É"), (3, None), (4, ""), (5, "\n\n"), (6, "Line 1 é\n Line 0 É")]
    for d in range(10, 90):
        out.append((d, "\n".join(rng.choice(common[: 1 + d % 12]) if rng.random() < 0.6 else f"own {rng.randrange(200)}" for _ in range(rng.randrange(1, 12)))))
    return out + [out[20], (30, "other text\nline 0 É"), (91, "Line 0 É\n" * 3000)]


@pytest.mark.parametrize(("least", "parts", "batch"), [(10, 7, 10000), (3, 25, 3), (40, 4, 1)])
def test_against_plain_python(spark, rows, least, parts, batch):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, h int, Kind string").repartition(6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = L.applied(df.select("doc_id", "text"), least).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    mine = sorted((repr(r.doc_id), r.text or "", r._dropped or 0, r.text or "" if r._kept is None else r._kept) for r in got)
    want = sorted((repr(d), "\n".join(x), keep.count(False), "\n".join(a for a, k in zip(x, keep) if k)) for d, x, keep in brute(rows, least))
    assert mine == want


def test_rows_with_colliding_32_bit_hashes(spark):
    line = "shared line"
    rows = [(None, f"{line}\nA18054"), (None, "B10682"), *[(d, line) for d in range(1, 12)]]
    got = {r.text: (r._dropped, r._kept) for r in L.applied(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()}
    assert got["B10682"] == (None, None) and got[f"{line}\nA18054"] == (1, "A18054")


def test_a_million_equal_lines_in_few_documents(spark, monkeypatch):
    """Rows of one document don't pile up: all but HELD wait in the output, and stay or go by the run's documents."""
    import pandas as pd

    monkeypatch.setattr(L, "HELD", 1000)
    n, size = 1_000_000, 10_000

    def batches(docs):
        for i in range(0, n, size):
            did = np.arange(i, i + size) * docs // n
            yield pd.DataFrame({"h": 5, "g": 6, "did": did, "tag": did, "tag2": did, "pos": np.int32(1), "lines": np.int32(1)})

    for docs in (1, 9, 10):
        out = pd.concat([x[["kind", "docs"]] for x in L._stream(10)(batches(docs))])
        assert (out["kind"] == L.SEEN).sum() == 1 and out["docs"].max() == docs
        assert (out["kind"] != L.SEEN).sum() == n and (out["kind"] == L.DROP).any() == (docs == 10)


def test_spilled_runs(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "HELD", 0)
    test_against_plain_python(spark, rows, 10, 5, 7)


def test_bitmaps(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.did: r for r in L.bitmaps(df, 10).collect()}
    want = {d: keep for d, _, keep in brute(rows, 10)}
    assert 91 in got and 3 not in got
    bits = np.unpackbits(np.frombuffer(zlib.decompress(got[91].bitmap), np.uint8), count=got[91].lines)
    assert bits.astype(bool).tolist() == want[91] and len(got[91].bitmap) < 100


def test_stage_keeps_columns_and_rows(spark, rows):
    df = spark.createDataFrame([(1, d, t) for d, t in rows], "did long, doc_id long, text string")
    out = L.line_stage(spark, df, "")
    assert out.columns == df.columns and out.count() == len(rows)
    assert L.line_stage(spark, df.limit(0), "").count() == 0
    assert [r.text for r in out.where("doc_id = 3").collect()] == [None]
