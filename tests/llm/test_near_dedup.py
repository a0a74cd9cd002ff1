"""Operator 3 against all pairs by brute force."""

import random

import pytest

from tidemark.llm import core, near_dedup


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def drifting(rng, n, size, rate):
    """A chain of copies, each of another with some words changed."""
    base = [[rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(size)]]
    for _ in range(n - 1):
        w = list(rng.choice(base))
        for _ in range(rate):
            w[rng.randrange(len(w))] = "x" + str(rng.randrange(10**6))
        base.append(w)
    return [" ".join(w) for w in base]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "One  two\tthree four", "one two three four five", "é É", "É É"]
    texts += drifting(rng, 60, 60, 3) + drifting(rng, 30, 9, 1) + drifting(rng, 20, 200, 4)
    texts += [texts[20]] * 30 + ["a b c d e " * 400, "a b c d e " * 401]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, TEXT string").repartition(5)
    got = {r.did: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_blocks_do_the_whole_job(spark, rows, monkeypatch):
    for name in ("BLOCK", "MEMBERS"):
        monkeypatch.setattr(near_dedup, name, 2)
    monkeypatch.setattr(near_dedup, "neighbours", lambda m: m.limit(0).selectExpr("rep AS u", "rep AS v"))
    df = spark.createDataFrame([r for r in rows if r[0] % 2], "doc_id long, text string")
    got = {r.did: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute([r for r in rows if r[0] % 2])


def test_bound_rules_out_parts_of_a_large_group(spark, monkeypatch):
    """Documents that hold 70 % of a large group's text beside words of their own meet no member of it: few pairs, the same result."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(10**8)}"
    base, rows = [word() for _ in range(150)], []
    for d in range(300):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(150)] = word()
        rows.append((d, " ".join(w)))
    for d in range(300, 500):
        rows.append((d, " ".join(base[: rng.randrange(115, 125)] + [word() for _ in range(28)])))
    seen = []
    real = near_dedup.bounded
    monkeypatch.setattr(near_dedup, "bounded", lambda *a: seen.append(real(*a)) or seen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.did: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert seen and sum(d.where("out").count() for d in seen) < 20


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b"), (4, "a b"), (9, None)], "doc_id long, text string")
    got = sorted((r.did, r.component) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(4, 4), (4, 4), (9, 9), (core.NO_ID, 4), (core.NO_ID, 4)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_an_id_links_nothing(spark):
    a, b, c = ("a b c d e f g h i j k", "l m n o p q r s t u v", "w x y z 1 2 3 4 5 6 7")
    df = spark.createDataFrame([(None, a), (None, b), (1, a), (2, b), (2, c), (3, c), (None, c + " 8 9 10 11 12")], "doc_id long, text string")
    got = sorted((r.did, r.component) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 2), (2, 2), (3, 2), (core.NO_ID, 1), (core.NO_ID, 2), (core.NO_ID, core.NO_ID)]
    kept = sorted((r.doc_id or 0, r.text) for r in near_dedup.near_stage(spark, df, "").collect())
    assert kept == [(0, c + " 8 9 10 11 12"), (1, a), (2, b), (2, c)]


def pair(rng, same, left, right):
    """Two sets of hashes with `same` in common, and more of each one's own."""
    import numpy as np

    s = np.unique(rng.integers(0, 1 << 64, same + left + right, np.uint64, endpoint=False))
    rng.shuffle(s)
    return np.sort(s[: same + left]), np.sort(np.concatenate([s[:same], s[same + left :]]))


def test_cut_keeps_pairs_at_the_threshold(spark):
    """Pairs at exactly three quarters pass the estimate's cut, at any size from which it holds."""
    import numpy as np
    from pyspark.sql import functions as F

    rng, lost = np.random.default_rng(11), []
    sizes = [(54, 9, 9), (54, 18, 0), (66, 11, 11), (90, 30, 0), (210, 35, 35), (900, 150, 150)]
    cuts = spark.createDataFrame([(i, same + min(l, r)) for i, (same, l, r) in enumerate(sizes)], "i int, n long").orderBy("i").select(near_dedup.cut(F.col("n"), 0.75).alias("c")).collect()
    for (same, left, right), c in zip(sizes, cuts, strict=True):
        for _ in range(1500):
            p, q = (near_dedup.registers(s) for s in pair(rng, same, left, right))
            chance = near_dedup.collisions(np.array([same + left], float), np.array([same + right], float))[0]
            if ((p == q).mean() - chance) / (1 - chance) < c.c:
                lost.append((same, left, right))
    assert not lost


def test_small_pairs(spark):
    """Sets of 3 to 12 shingles at exactly three quarters: all found."""
    rng, rows = random.Random(5), []
    for k in range(40):
        for same, extra in ((3, 1), (6, 2), (9, 3), (12, 4)):
            w = [f"w{rng.randrange(10**9)}" for _ in range(same + extra + 4)]
            rows += [(len(rows) * 3 + 1, " ".join(w)), (len(rows) * 3 + 2, " ".join(w[: same + 4]))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.did: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(df).collect()} == brute(rows)


def test_recall_by_similarity(spark):
    """All links of the driver's small table, by an inverted index over full sets; prints how many there are by similarity."""
    import collections

    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, index = {}, collections.defaultdict(list)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    classes = {s: min(d for d in sets if sets[d] == s) for s in set(sets.values()) if s}
    for s, d in classes.items():
        for x in s:
            index[x].append(d)
    both = collections.Counter()
    for ds in index.values():
        ds.sort()
        both.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    component = {r.did: r.component for r in near_dedup.near_duplicates(docs).collect()}
    found = collections.defaultdict(lambda: [0, 0])
    for (a, b), n in both.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= 0.75:
            band = found[min(int(j * 20), 19) / 20]
            band[0] += component[a] == component[b]
            band[1] += 1
    print("links found and present, by similarity from", dict(sorted(found.items())))
    assert found and all(x == y for x, y in found.values())
    root = {d: d for d in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert component == {d: find(classes[s]) if s else d for d, s in sets.items()}


def test_registers_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.8):
        u = np.unique(rng.integers(0, 1 << 63, 4000, np.int64).astype(np.uint64) * np.uint64(2))
        n = int(len(u) * j)
        both, a, b = u[:n], u[n : n + (len(u) - n) // 2], u[n + (len(u) - n) // 2 :]
        p, q = (near_dedup.registers(np.sort(np.concatenate([both, x]))) for x in (a, b))
        chance = near_dedup.collisions(np.array([3000.0]), np.array([3000.0]))[0]
        assert abs(((p == q).mean() - chance) / (1 - chance) - j) < 0.16
        assert 0 <= chance < 0.01
