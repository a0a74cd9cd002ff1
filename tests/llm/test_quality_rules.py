"""Operator 1 against plain Python, hashes included."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from tidemark.llm import quality_rules as Q

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
MARKS = re.compile(r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+)")


def base(text):
    t = text or ""
    w = [x for x in SPLIT.split(t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def grams(text, buckets):
    k = [x for x in SPLIT.split(MARKS.sub(r" \1 ", text or "")) if x]
    h = lambda *xs: __import__("functools").reduce(lambda seed, x: xxhash.xxh64_intdigest(x.encode(), seed), xs, 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(h(x)) % buckets for x in k] + [signed(h(x, y)) % buckets for x, y in zip(k, k[1:])]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "x,", "y.", "Zeta"]) + rng.choice(["", "", "s", "!"])
    out = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b"), (5, "same line\n" * 30), (6, "### $$ | <> " * 20), (7, "w " * 60), (8, " ".join("abc") + " b c " * 40)]
    out += [(i, " ".join(word() for _ in range(rng.randrange(1, 300)))) for i in range(10, 60)]
    out += [(60, out[-1][1]), (60, out[-1][1]), (None, "the end " * 3), (61, " ".join(f"t{i}" for i in range(20_000)))]
    return out


def test_against_plain_python(spark, rows):
    df = spark.createDataFrame([(d, t, "N", 9) for d, t in rows], "doc_id long, text string, n_words string, Kept int")
    labels = spark.createDataFrame([(i, i % 2, 0 if i % 3 else None) for i in range(0, 60)] + [(None, 1, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(60) if i % 2 == 1}
    n, raw, target = 512, Counter(), Counter()
    for d, t in rows:
        g = grams(t, n)
        raw.update(g)
        if d in trusted:
            target.update(g)
    shift = math.log(sum(raw.values()) + n) - math.log(sum(target.values()) + n)
    weights = [round(1000 * (math.log(target[b] + 1) - math.log(raw[b] + 1) + shift)) for b in range(n)]
    got = Q.quality(df, labels, threshold=-100, buckets=n).collect()
    want = []
    for d, t in rows:
        f, g = base(t), grams(t, n)
        llr = sum(weights[b] for b in g) / len(g) if g else None
        want.append((d, *f, None if llr is None else llr / 1000, not f[-1] and llr is not None and llr >= -100))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.llr in (None, 0.0) and r.kept == (not r.base_failed) for r in Q.quality(df, labels).collect())
    assert Q.quality(df.limit(0), labels).count() == 0
