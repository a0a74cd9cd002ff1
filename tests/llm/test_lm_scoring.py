"""Operator 6 against the same formulas in plain Python, and the models as distributions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import chunks
from tidemark.llm import lm_scoring as M


def toks(t):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]


class Model:
    """Counts of words, contexts and bigrams of texts over a vocabulary; None is the unknown word."""

    def __init__(self, texts, vocabulary):
        self.v, self.one, self.two, self.context = vocabulary, Counter(), Counter(), Counter()
        for w in texts:
            w = [x if x in vocabulary else None for x in w]
            self.one.update(w)
            self.two.update(zip(w, w[1:]))
            self.context.update(w[:-1])

    def less(self, other):
        new = Model([], self.v)
        for name in ("one", "two", "context"):
            getattr(new, name).update(getattr(self, name))
            getattr(new, name).subtract(getattr(other, name))
        return new

    def p(self, w, v=0):
        p = (self.one[w] + 1) / (sum(self.one.values()) + len(self.v) + 1)
        return p if v == 0 else (self.two[v, w] + M.KAPPA * p) / (self.context[v] + M.KAPPA)


def brute(rows, trusted):
    ws = [toks(t) for _, t in rows]
    count = Counter(x for (d, _), w in zip(rows, ws) if d in trusted for x in w)
    vocabulary = {w for w, c in count.items() if c >= M.MIN_COUNT}
    models = [Model([w for (d, _), w in zip(rows, ws) if d in trusted], vocabulary), Model(ws, vocabulary)]
    out = []
    for (d, _), w in zip(rows, ws):
        own = Model([w], vocabulary)
        t, b = models[0].less(own) if d in trusted else models[0], models[1].less(own)
        w = [x if x in vocabulary else None for x in w]
        each = [round(1e6 * (math.log(b.p(x, v)) - math.log(t.p(x, v)))) for v, x in zip([0, *w], w)]
        out.append((repr(d), len(w), sum(x is not None for x in w), sum(each) / len(w) / 1e6 if w else None))
    return sorted(out, key=repr), models


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 3)
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 80)))) for i in range(80)] + [(None, "a b a b"), (90, None), (91, ""), (92, "zz ZZ qq")]
    return [*rows, rows[3], (3, "a other text"), (95, "a b " * 30_000)], {i for i in range(80) if i % 3 == 0 and i % 9}


@pytest.mark.parametrize("size", [1 << 24, 300])
def test_against_plain_python(spark, case, size, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", size)
    rows, trusted = case
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 9 == 0)) for i in range(80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, OWN int").repartition(5)
    got = sorted(((repr(r.doc_id), r.n_tokens, r.n_listed, r.score) for r in M.cross_entropy_difference(df, labels).collect()), key=repr)
    want, _ = brute(rows, trusted)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=3e-6)


def test_models_are_distributions(case):
    """Over the vocabulary and the unknown word P(w), and P(w | v) for each v, add up to 1, also without a document's own counts."""
    rows, trusted = case
    _, models = brute(rows[:60], trusted)
    own = Model([toks(rows[3][1])], models[0].v)
    for m in (*models, models[1].less(own)):
        words = [*m.v, None]
        assert math.isclose(sum(m.p(w) for w in words), 1)
        for v in words:
            c, n = np.array([m.one[w] for w in words]), sum(m.one.values())
            p = M.probabilities(c, n, len(m.v), np.array([m.two[v, w] for w in words]), m.context[v], np.ones(len(words), bool))
            assert math.isclose(p.sum(), 1)
            assert p == pytest.approx([m.p(w, v) for w in words])


def test_no_broadcast_of_models_and_no_shuffle_of_texts(spark, case):
    rows, _ = case
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    d = M.cross_entropy_difference(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert not any("Exchange" in x and "text" in x for x in plan.split("\n"))


def test_without_trusted_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.score) for r in M.cross_entropy_difference(docs, labels).collect()) == [(1, 2, 0.0), (2, 0, None)]
    assert M.cross_entropy_difference(docs.limit(0), labels).count() == 0
