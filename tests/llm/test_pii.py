"""Operator 7: patterns against the plain regular expressions, disclosure against counting by hand."""

import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def plain(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in P.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in P.CARD.finditer(t):
        d = re.sub(r"[ -]", "", m[0])
        if 12 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in P.PHONE.finditer(t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


SAMPLES = [
    "a@b.c%d@e.f", "@@a@b", "x@y.z.@q.r", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111 1111 1111 1111", "4111-1111 1111-1112", "+1 (555) 123-4567 x", "++49 30 1234567", "é@é.x a.b@c-d.e-f.", "1..2.3.4.5", "+", "12" * 40,
    "4111 1111 1111 1111 1", "+49 4111 1111 1111 1111",
]


def test_samples():
    for t in SAMPLES:
        assert P.base_spans(t) == plain(t), t


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ09.@%-+ ()4é\n", max_size=60))
def test_random(t):
    assert P.base_spans(t) == plain(t)


def test_long_runs_end_soon():
    t = "a" * 200_000 + " x@y.zz " + "1" * 200_000 + " " + "1." * 50_000
    assert [s[1] for s in P.base_spans(t) if s[1] == 0] == [0]


def test_digits_that_touch_their_dots_end_soon():
    import time

    began = time.time()
    assert P.base_spans("1" * 200_000 + "...") == P.base_spans("1" * 200_000 + ".2.3..") == []
    assert P.base_spans("7." * 50_000)[:2] == [(0, 1, 7), (8, 1, 15)]
    assert time.time() - began < 1


def test_many_addresses_and_terms_of_one_document(spark):
    """Thousands of both in one document, and the same in two copies: classes are paired, not names."""
    one = " ".join(f"u{i}@x.org term{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}q{'klmnopqrst'[i // 260 % 10]}{chr(97 + i // 2600)}" for i in range(5000))
    two = " ".join(f"v{i}@y.org" for i in range(500)) + " Quagga Zorilla"
    rows = [(1, one), (2, two), (None, two), *[(10 + i, f"plain text {i}") for i in range(100)]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    x, entities, terms, has, _ = P._disclosed(P.chunks.chunked(df.select("text")))
    assert has.count() == 2 and x.count() == 1 and entities.count() == 500 and sorted(r.name for r in terms.collect()) == ["quagga", "zorilla"]
    out = {r.doc_id: r for r in P.personal_data(df).collect()}
    assert out[1].n_email == 5000 and "term" in out[1].sanitised
    assert all("uagga" not in out[d].sanitised and out[d].n_email == 500 for d in (2, None))


def brute_terms(rows):
    """{doc: {(term, entity)}} that disclose enough, by counting."""
    docs = {}
    for d, t in rows:
        docs.setdefault(d, []).append(t or "")
    meet, ent, df = {}, {}, {}
    for d, ts in docs.items():
        seen = set()
        for t in ts:
            for m in P.TERM.findall(t):
                if len(m) >= P.MIN_TERM:
                    seen.add(m.lower())
            for e, terms in P.beside(t, plain(t)):
                ent.setdefault(e, set()).add(d)
                for x, _, _ in terms:
                    meet.setdefault((e, x), set()).add(d)
        for x in seen:
            df[x] = df.get(x, 0) + 1
    n = len(rows)
    return {k: math.log2(n * len(v) / (len(ent[k[0]]) * df[k[1]])) / math.log2(n / len(ent[k[0]])) for k, v in meet.items() if len(v) >= P.MIN_TOGETHER}


def test_disclosures(spark):
    rng = random.Random(1)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = []
    for i in range(300):
        t = " ".join(rng.choice(words) for _ in range(20))
        if i % 30 == 0:
            t += "\nThe Zebrafish lives at joe@x.org and word"
        if i % 25 == 0:
            t += "\nword +49 30 1234567 commonly"
        if i % 5 == 0:
            t += " commonly"
        rows.append((i, t))
    rows += [(None, None), (301, ""), (302, "joe@x.org")]
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id long, text string, Entity string").repartition(4)
    want = {k: v for k, v in brute_terms([r for r in rows]).items() if v >= P.GENERALISE}
    got = {(r.entity, r.term): r.share for r in P.disclosures(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert ("email:joe@x.org", "zebrafish") in got
    out = {r.doc_id: r for r in P.personal_data(df).collect()}
    assert "Zebrafish" not in out[0].sanitised and "joe@x.org" not in out[0].sanitised and "[EMAIL]" in out[0].sanitised
    assert out[1].spans == "" and out[1].sanitised == rows[1][1] and out[None].sanitised == ""
    assert P.personal_data(df.limit(0)).count() == 0


def test_terms_of_other_lines_and_short_ones(spark):
    rows = [(i, f"plain words number {i}") for i in range(200)] + [(200 + i, "Ann Zebrafish\nstreet 5\nann@x.org\nCall Ann, 李, soon.") for i in range(2)] + [(200, "Ann without the address")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.entity, r.term) for r in P.disclosures(df).collect()}
    assert {("email:ann@x.org", x) for x in ("ann", "zebrafish", "李")} <= got
    out = [r.sanitised for r in P.personal_data(df).collect() if r.doc_id in (200, 201)]
    assert len(out) == 3 and out.count("Ann without the address") == 1
    assert all("Ann" not in x and "李" not in x and "[EMAIL]" in x for x in out if "EMAIL" in x)
