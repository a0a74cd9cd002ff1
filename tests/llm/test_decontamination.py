"""Operator 2: verbatim, re-parameterised and inconsistent questions; clean documents; a plain Python check of coverage."""

import random
from collections import defaultdict

import pytest
import regex

from tidemark.llm import decontamination as D

ITEM = "A farmer named Maria sells 12 apples and 30 pears for 45 dollars, then Maria buys 12 more plums at the market near Lyon."
SAME = "some words before it. " + ITEM + " and after."
OTHER = "Well. A farmer named Sofia sells 17 apples and 8 pears for 99 dollars, then Sofia buys 17 more plums at the market near Oslo. Done."
UPPER = OTHER.replace("Well.", "Well:")
MIXED = OTHER.replace("then Sofia buys 17", "then Sofia buys 18")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, 0), (2, "Short one here.", 0), (3, None, 0), (4, "", 0), (5, "5 10 15 20 25 30 35 40 45 50", 0), (None, "the long unrelated sentence about rivers and hills and forests and lakes", 0)], "item_id long, text string, h int")


def test_cases(spark, bench):
    texts = {1: SAME, 2: OTHER, 3: MIXED, 4: None, 5: "", 6: "1 2 3 4 5 6 7 8 9 10 11 12", 7: ITEM.upper(), 8: "a short one here, that is all", 9: "A farmer sells apples.", 10: "clean text " * 50, 11: ITEM[: len(ITEM) // 3], 12: UPPER}
    rows = [(k, t, "x") for k, t in texts.items()] + [(1, "another text under one id", "x"), (None, SAME, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Items string").repartition(4)
    got = [(r.doc_id, r["items"], r.kept) for r in D.decontaminate(df, bench).collect()]
    hits = {d for d, items, _ in got if items}
    assert hits == {1, 2, 7, 8, 12, None}
    assert sorted(k for d, _, k in got if d == 1) == [False, True]
    assert {d: i for d, i, _ in got if d in (2, 8)} == {2: [1], 8: [2]}
    out = D._joined(df, D.contaminated(df, bench), "left_anti")
    assert out.columns == df.columns and out.count() == 8


def test_template_words_stand_for_words(spark):
    from pyspark.sql import functions as F

    from tidemark.llm import core

    texts = ["In May Bob paid $3.50 for 2 kg, 5km and 7%!", "— , . 12", "\x01 \x02", "He said: Anna. Then left", "x y 3 m", ITEM, "3 Kg 4 of"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", D.template(F.col("t")).alias("c"), core.words(F.col("t")).alias("w"))
    rows = df.collect()
    assert all(len(r.c) == len(r.w) for r in rows)
    assert rows[0].c == ["\x04in", "\x03", "\x03", "paid", "\x01", "for", "\x01", "\x02", "\x01\x02", "and", "\x01\x02"]


EGGS = "Janet picks 16 eggs each day. Janet eats 3 eggs for breakfast. Janet sells the rest for 2 dollars each. Janet earns how much?"
LONG = " ".join(f"literal{i} word{i * 7}" for i in range(80))


def test_names_that_begin_sentences_drift_and_excerpts(spark):
    bench = spark.createDataFrame([(1, EGGS), (2, ITEM), (3, LONG), (4, "lonely")], "item_id long, text string")
    new = EGGS.replace("Janet", "Maria").replace("16", "20").replace(" 3 ", " 5 ").replace(" 2 ", " 4 ")
    drifted = OTHER.replace("Sofia", "Mary").replace("farmer named Mary", "farmer there named Mary").replace("8 pears", "8 ripe pears")
    words = LONG.split()
    texts = {1: new, 2: new.replace("Maria earns", "Peter earns").replace("Maria sells", "Peter sells"), 3: drifted, 4: "see " + " ".join(words[30:75]) + " end", 5: " ".join(words[:30]), 6: "a lonely word", 7: EGGS.lower(), 8: "JANET " + EGGS}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in D.decontaminate(df, bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [3], 5: [], 6: [], 7: [1], 8: [1]}


def template(text):
    """Words and template words by the same patterns, in plain Python."""
    t = regex.sub("[\x01-\x04]", "?", text)
    for pattern, to in ((D.NAME, D.NAMED), (D.BEGIN, D.FIRST + r"\g<0>"), (D.NUMBER, D.NUM), (rf"(\x01[\x20\x09-\x0D]*)(?:{D.UNITS})(?![\p{{L}}\p{{N}}])", r"\g<1>" + D.UNIT), (D.EDGE, "")):
        t = regex.sub(pattern, to, t)
    return [x for x in regex.split(r"[\x20\x09-\x0D]+", t.lower()) if x]


def brute(docs, items):
    """{row of docs: sorted items it holds}, window by window."""
    split = lambda t: [x for x in regex.split(r"[\x20\x09-\x0D]+", t) if x]
    views = {False: lambda w: tuple(x.lstrip(D.FIRST) for x in w), True: lambda w: tuple(D.NAMED if x[0] == D.FIRST else x for x in w)}
    found = {}
    for row, text in enumerate(docs):
        dw, dr, held = template(text or ""), split(text or ""), set()
        for item, own in items:
            iw, ir = template(own or ""), split(own or "")
            k = min(D.WINDOW, len(iw))
            if k < D.MIN_WORDS:
                continue
            index, hits = defaultdict(set), set()
            for i in range(len(iw) - k + 1):
                for v, view in views.items():
                    w = view(iw[i : i + k])
                    marks = sum(any(c in x for c in "\x01\x02\x03") or (v and x == D.NAMED) for x in w)
                    if k - marks >= max(D.MIN_LITERAL * k, D.MIN_WORDS) and (not v or w != views[False](iw[i : i + k])):
                        index[w].add(i)
            for j in range(len(dw) - k + 1):
                plain = views[False](dw[j : j + k])
                hits |= {(False, i, j) for i in index[plain]}
                if (free := views[True](dw[j : j + k])) != plain:
                    hits |= {(True, i, j) for i in index[free]}
            for v in (False, True):
                lines = defaultdict(set)
                for u, i, j in hits:
                    if v or not u:
                        for band in ((0, j - i), (1, (j - i) // D.DRIFT), (2, (j - i + D.DRIFT // 2) // D.DRIFT)):
                            lines[band].add((i, j))
                for (mode, _), at in lines.items():
                    cover = {i + x for i, _ in at for x in range(k)}
                    run = max(next(n for n in range(1, len(cover) + 1) if c + n not in cover) for c in cover)
                    if len(cover) < D.MIN_COVER * len(iw) and not (mode == 0 and run >= D.MIN_RUN):
                        continue
                    slots = {(i + x, j + x) for i, j in at for x in range(k) if any(c in iw[i + x] for c in ("\x01\x02\x03\x04" if v else "\x01\x02\x03"))}
                    bare = lambda x: regex.sub(D.EDGE, "", x.lower())
                    pairs = {(bare(ir[i]), bare(dr[j])) for i, j in slots}
                    if len({i for i, _ in pairs}) == len(pairs):
                        held.add(item)
        found[row] = sorted(held)
    return found


def test_against_plain_python(spark):
    rng = random.Random(12)
    names, nouns = ["Anna", "Ben", "Mary Ann", "O'Hara"], ["apples", "km", "dollars", "books", "the", "of", "sells", "buys", "near", "then"]

    def sentence():
        w = [rng.choice([rng.choice(names), str(rng.randrange(30)), rng.choice(nouns), rng.choice(nouns), f"word{rng.randrange(40)}"]) for _ in range(rng.randrange(3, 14))]
        return " ".join(w) + rng.choice([".", "!", ":", ""])

    items = [(i, " ".join(sentence() for _ in range(rng.randrange(1, 8)))) for i in range(25)] + [(25, None), (26, "5 6 7 8"), (27, "The end"), (28, LONG)]
    docs = [None, "", "the end of it", LONG[100:700], "x " * 20_000 + items[3][1]]
    for _ in range(120):
        text = rng.choice(items)[1] or ""
        for a, b in rng.sample([("Anna", "Carla"), ("Ben", "Mary Ann"), ("apples", "pears"), (" 1", " 2"), ("near", "not near"), ("The", "the")], rng.randrange(0, 3)):
            text = text.replace(a, b, rng.choice([1, -1]))
        docs.append(" ".join([sentence(), text, sentence()]))
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    want = brute(docs, items)
    got = sorted((repr(r.doc_id), r["items"]) for r in D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((repr(i if i % 7 else None), want[i]) for i in want)
    assert 20 < sum(map(bool, want.values())) < len(docs) - 5


def test_empty_tables(spark, bench):
    df = spark.createDataFrame([(1, SAME)], "doc_id long, text string")
    assert D.decontaminate(df.limit(0), bench).count() == 0
    assert [r.kept for r in D.decontaminate(df, bench.limit(0)).collect()] == [True]
