"""Operator 9: the forward algorithm against all segmentations, held-out accuracy, edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import language_id as L

VOCAB = ["▁", "a", "b", "ab", "ba", "▁a", "aba", "c"]


def all_segmentations(w, p):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        parts, start = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(w[start:i])
                start = i
        total += math.prod(p.get(x, L.UNKNOWN if len(x) == 1 else 0.0) for x in parts)
    return total


def test_forward_sums_all_segmentations():
    lattice, rng = L.Lattice(VOCAB), np.random.default_rng(0)
    p = rng.dirichlet(np.ones(len(VOCAB)), 2).T
    words = ["a", "abab", "baab", "cab", "zab", "abaaba", "zzz"]
    got = L.word_scores(words, lattice, p)
    for g in range(2):
        table = dict(zip(VOCAB, p[:, g]))
        assert got[:, g] == pytest.approx([math.log(all_segmentations("▁" + w, table)) for w in words])


def test_long_words_are_scored_whole():
    """Words of 60 and 5,000 letters score as the whole forward sum, here in exact fractions of large integers."""
    from fractions import Fraction

    lattice, rng = L.Lattice(VOCAB), np.random.default_rng(3)
    p = rng.dirichlet(np.ones(len(VOCAB)), 2).T
    for n in (60, 5000):
        w = "▁" + "".join(rng.choice(list("abcz"), n))
        got = L.word_scores([w[1:]], lattice, p)[0]
        for g in range(2):
            table = {x: Fraction(float(y)) for x, y in zip(VOCAB, p[:, g])}
            a, scale = [Fraction(1)], 0.0
            for i in range(1, len(w) + 1):
                parts = [(k, w[i - k : i]) for k in range(1, min(4, i) + 1)]
                new = sum(a[-k] * (table.get(x, Fraction(L.UNKNOWN) if len(x) == 1 else 0)) for k, x in parts)
                a = [Fraction(float(x / new)) for x in a[-4:]] + [Fraction(1)]
                scale += math.log(new)
            assert got[g] == pytest.approx(scale, rel=1e-9)


def test_long_and_short_variables_agree():
    lattice, rng = L.Lattice(VOCAB), np.random.default_rng(5)
    p = rng.dirichlet(np.ones(len(VOCAB)), 2).T
    x = L._probabilities(lattice.ids(["▁abzbabac" * 3, "▁cabababa" * 3]), p)
    assert L.log_forward(x) == pytest.approx(np.log(L.forward(x)))
    assert L.log_backward(x) == pytest.approx(np.log(L.backward(x)))


def test_fit_learns_from_whole_words():
    w = "ab" * 40 + "c" * 10
    _, p = L.fit({"x": {"▁" + w: 3}, "y": {"▁" + w[:40]: 3}}, VOCAB, 3)
    c = VOCAB.index("c")
    assert p[c, 0] > 10 * p[c, 1]
    with pytest.raises(FileNotFoundError):
        L.pieces("/nowhere/no.model")


def test_backward_agrees_and_em_raises_likelihood():
    lattice = L.Lattice(VOCAB)
    x = L._probabilities(lattice.ids(["▁abab", "▁baab"]), np.full((len(VOCAB), 1), 1 / len(VOCAB)))
    assert L.forward(x)[:, -1] == pytest.approx(L.backward(x)[:, 0])
    counts = {"x": {"▁abab": 5, "▁ba": 2}, "y": {"▁c": 3}}
    ll = []
    for rounds in (1, 2, 4):
        _, p = L.fit(counts, VOCAB, rounds)
        s = L.word_scores(["abab", "ba"], lattice, p)[:, 0]
        ll.append(5 * s[0] + 2 * s[1])
    assert ll == sorted(ll)


def _text(rng, lang, n):
    syll = {"en": ["the", "ing", "and", "er", "th"], "de": ["sch", "ung", "ein", "ich", "der"], "es": ["ción", "ado", "ll", "que", "os"]}[lang]
    return " ".join("".join(rng.choice(syll) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(4)
    rows = [(i, _text(rng, g, rng.randrange(3, 60)), g, 1) for i, g in enumerate(rng.choice(["en", "de", "es"]) for _ in range(240))]
    odd = [(900, None, "en", 1), (901, "", None, 1), (902, "12 !? 3_4", "de", 1), (None, "the thing", "en", 1), (903, "z" * 5000 + " the", None, 1), (904, "日本", None, 1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, Score int").repartition(4)
    got = {r.doc_id: r for r in L.languages(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (r in held) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[None].held_out is False and got[None].lang_pred == "en" and got[904].lang_pred in ("de", "en", "es")
    assert L.languages(df.limit(0)).count() == 0
    assert {r.lang_pred for r in L.languages(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
