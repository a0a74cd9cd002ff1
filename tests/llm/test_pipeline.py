"""The pipeline over a small folder of tables, stage by stage against brute force."""

import random

import corpus_pipeline
import pytest
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as near_brute
from test_quality_rules import base

from tidemark.llm import mixing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("sf")
    word = lambda: rng.choice("bcdfghjkl") + rng.choice("aeiou") + rng.choice("mnprst") + rng.choice(["", "a", "o"])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(25) for _ in range(4)]
    rows = [(i, text(rng.randrange(60, 120)) + "\nshared boilerplate line\n" + text(20), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s1", 0) for i in range(6)]
    rows += [(110 + i, rows[10 + i][1] + " tail", "en", None, 0) for i in range(4)]
    rows += [(120 + i, text(60) + "\n" + items[i] + "\n" + text(30), "en", "s2", 0) for i in range(4)]
    rows += [(130, "too short", "en", "s0", 0), (131, None, None, None, None), (132, "a b c " * 100, "en", "s0", 0), (133, " ".join(w + "### $$$" for w in text(80).split()), "en", "s0", 0), (134, "", "en", "s0", 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, Extra string")
    df.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(130)] + [(133, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d), df, rows


def test_stages(spark, folder):
    sf, docs, rows = folder
    text = {r[0]: r[1] for r in rows}
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and len(after) == docs.count()
        if name == "quality rules":
            want = {i for i in before if not base(before[i])[-1]} - {133}
            assert set(after) == want and 133 in before
        elif name == "line dedup":
            want = {i: "\n".join(x for x, k in zip(ls, keep) if k) for i, ls, keep in lines_brute(list(before.items()), 10)}
            assert after == want and "shared boilerplate line" not in "".join(after.values())
        elif name == "near-dedup":
            comp = near_brute(sorted(before.items()))
            assert set(after) == {i for i, (_, c) in comp.items() if c == i}
            assert not set(range(100, 114)) & set(after)
        elif name == "decontamination":
            assert set(before) - set(after) == {120, 121, 122, 123}
            assert all(text[i].startswith(after[i].split("\n")[0]) for i in after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    want = {r.doc_id: r.taken for r in mixing.mixing(docs).collect()}
    got = {}
    for r in last:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.taken
    assert got == {k: v for k, v in want.items() if v}


def test_run_is_the_stages(spark, folder):
    sf, _, _ = folder
    a = sorted((r.doc_id, r.copy, r.text) for r in corpus_pipeline.run(spark, sf).collect())
    assert a and {x[0] for x in a} <= set(range(60))
