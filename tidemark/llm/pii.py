"""Operator 7, personal data: patterns find protected entities (mail addresses, IP addresses, cards, phone numbers); then
information-theoretic sanitisation finds what else reveals them.

For an entity e and a term t of the same document, over the documents of the corpus: the information of e is
IC(e) = log2(N / n(e)), and t discloses PMI(e, t) = log2(N n(e, t) / (n(e) n(t))) of it. A term that meets e in
MIN_TOGETHER documents or more and discloses at least GENERALISE of IC(e) is generalised, from REMOVE on removed, wherever it stands in
a document with e. Terms are runs of MIN_TERM letters or more, lower-cased. All counts are over all documents; a document is a row.

Plan: texts are written once in chunks (chunks.py), which number the rows. Scan 1 finds entities and, in documents with any, the terms, a row for
each. Entities with the same documents are one class, and so are terms; only classes that meet are paired, so that a document with
thousands of addresses and terms of its own makes no pairs of them. Entities of one document go at once, and pairs whose term is too
frequent to reach the share are dropped in the join, exactly. Scan 2 counts the documents of the candidate terms, combined within the task.
Scan 3 marks the spans: what is to be marked meets its chunk's texts, which stay. Candidate terms travel by broadcast within a checked size;
beyond, scan 2 counts all terms.

Cases: a null text is empty. Null doc_ids and rows that repeat a doc_id are documents of their own.
Without entities no term is marked. Empty tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, core, text

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
_NOT = bytes(i for i in range(256) if chr(i) not in "0123456789@")
MIN_TERM, MIN_TOGETHER = 1, 2
GENERALISE, REMOVE = 0.8, 0.95
#: Candidate terms up to which they are broadcast.
MAX_BROADCAST = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, leftmost and not overlapping, in linear time: from each '@', the local part before it
    reaches back as far as it can, at most to the end of the match before."""
    done, at = 0, t.find("@")
    while at >= 0:
        begin = done + len(t[done:at].rstrip(LOCAL)) if at > done else at
        m = DOMAIN.match(t, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def _ips(run: str) -> Iterator[tuple[int, int]]:
    """As IP finds them in a run of digits and dots, leftmost and not overlapping, in linear time: of numbers with one dot between them each
    four are one."""
    at = 0
    for group in run.split(".."):  # an empty number between two dots parts what stands before from what stands after
        begin, held = at, []
        for number in group.split("."):
            if number:
                held.append((begin, begin + len(number)))
                if len(held) == 4:
                    if all(len(run[i:j].lstrip("0")) < 4 and int(run[i:j]) <= 255 for i, j in held):
                        yield held[0][0], held[3][1]
                    held = []
            else:
                held = []
            begin += len(number) + 1
        at += len(group) + 2


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(begin, kind, end) of the protected entities, sorted."""
    few = t.encode().translate(None, _NOT)  # only digits and '@' are left
    found = []
    if b"@" in few:
        found += [(i, 0, j) for i, j in _emails(t)]
    if len(few) > few.count(b"@"):
        for run in DOTTED.finditer(t):
            if run[0].count(".") >= 3:
                found += [(run.start() + i, 1, run.start() + j) for i, j in _ips(run[0])]
        for m in CARD.finditer(t):
            digits = re.sub(r"[ -]", "", m[0]) if len(m[0]) < 64 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in t:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def entity(t: str, span: tuple[int, int, int]) -> str:
    """The same for all spellings of one entity."""
    i, kind, j = span
    own = t[i:j].lower() if kind < 2 else re.sub(r"[^0-9]", "", t[i:j])
    return f"{KINDS[kind]}:{own}"


def free_terms(t: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """The terms (term, begin, end) of a text that overlap no span."""
    terms, k = [], 0
    for m in TERM.finditer(t):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if m.end() - m.start() >= MIN_TERM and not (k < len(spans) and spans[k][0] < m.end()):
            terms.append((m[0].lower(), m.start(), m.end()))
    return terms


def beside(t: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """For each span its entity and the terms of the text."""
    terms = free_terms(t, spans)
    for span in spans:
        yield entity(t, span), terms


NAMES = "s long, r int, kind int, name string"
ENTITY, WORD = 0, 1


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (s, r, text) with an entity: each entity and each term once."""
    schema = pa.schema([("s", pa.int64()), ("r", pa.int32()), ("kind", pa.int32()), ("name", pa.string())])
    for b in batches:
        for s, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if t and (spans := base_spans(t)):
                names = [sorted({entity(t, x) for x in spans}), sorted({x for x, _, _ in free_terms(t, spans)})]
                n = sum(map(len, names))
                yield pa.RecordBatch.from_arrays([pa.array([s] * n, pa.int64()), pa.array([r] * n, pa.int32()), pa.array([ENTITY] * len(names[0]) + [WORD] * len(names[1]), pa.int32()), pa.array(names[0] + names[1], pa.string())], schema=schema)


def _term_counts(wanted):
    """(term, n): documents with the term, summed over what the task reads; only wanted terms, all if None."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = None if wanted is None else wanted.value
        for b in batches:
            count: dict[str, int] = {}
            for _, _, data, off in text.portions(b.column(1)):
                starts, ends, first = text.words(data, off)
                h = text.word_hashes(data, starts, ends)
                _, at, inv = np.unique(h, return_index=True, return_inverse=True)
                ids: dict[str, int] = {}
                pair_word, pair_term = [], []
                for k, i in enumerate(at):  # each distinct word once
                    for m in TERM.findall(data[starts[i] : ends[i]].tobytes().decode()):
                        x = m.lower()
                        if len(m) >= MIN_TERM and (terms is None or x in terms):
                            pair_word.append(k)
                            pair_term.append(ids.setdefault(x, len(ids)))
                if not ids:
                    continue
                w, t = np.array(pair_word), np.array(pair_term)
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                cut = np.searchsorted(w, np.arange(len(at) + 1))
                many = (cut[1:] - cut[:-1])[inv]
                row = np.repeat(doc, many)
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                seen = np.unique(row.astype(np.int64) * len(ids) + t[np.repeat(cut[inv], many) + within])
                n = np.bincount(seen % len(ids), minlength=len(ids))
                for x, k in ids.items():
                    count[x] = count.get(x, 0) + int(n[k])
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], schema=schema)

    return run


ROW = ["s", "r"]


def _classes(names: DataFrame, least: int) -> DataFrame:
    """(name, c, n): names of `least` rows or more, their class and number of rows. Names with the same rows have the same class."""
    prints = [F.sum(F.xxhash64(F.lit(i), *ROW).cast("decimal(38,0)")) for i in (1, 2)]
    n = names.groupBy("name").agg(F.count("*").alias("n"), *[x.alias(f"p{i}") for i, x in enumerate(prints)]).where(F.col("n") >= least)
    return n.select("name", F.xxhash64("n", "p0", "p1").alias("c"), "n")


def _disclosed(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(e, t, nt, share): classes t of terms with nt documents each that disclose `share` >= GENERALISE of a class e of entities; (name, e) of
    the entities; (name, t, nt) of the terms; rows (s, r, e, ne) with these entities and (s, r, name) with terms."""
    spark = table.sparkSession
    names = core.stash(table.select(*ROW, "text").mapInArrow(_names, NAMES), "names")
    total = float(table.count())
    entities, terms = (names.where(F.col("kind") == k).select(*ROW, "name") for k in (ENTITY, WORD))
    ec = core.stash(_classes(entities, MIN_TOGETHER).withColumnsRenamed({"c": "e", "n": "ne"}), "entity_classes")
    has = core.stash(entities.join(ec, "name").select(*ROW, "e", "ne").distinct(), "rows_of_entities")
    near = core.stash(terms.join(has.select(*ROW).distinct(), ROW, "left_semi"), "terms_near")
    tc = core.stash(_classes(near, MIN_TOGETHER).withColumnsRenamed({"c": "t", "n": "least"}), "term_classes")
    of = core.stash(near.join(tc, "name").select(*ROW, "t", "least").distinct(), "rows_of_terms")
    # a term's documents number at least those with repeated entities: what can't reach the share is out, exactly
    most = lambda net: F.col(net) * F.pow(F.lit(total) / F.col("ne"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    both = has.join(of, ROW).where(F.col("least") <= most("ne")).groupBy("e", "t").agg(F.count("*").alias("net"), F.first("ne").alias("ne"), F.first("least").alias("least"))
    both = core.stash(both.where((F.col("net") >= MIN_TOGETHER) & (F.col("least") <= most("net"))), "class_meetings")
    wanted = core.stash(tc.join(both.select("t").distinct(), "t").select("name", "t"), "wanted")
    few = wanted.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    found = spark.sparkContext.broadcast(frozenset(wanted.select("name").toArrow()["name"].to_pylist())) if few else None
    n = table.select(F.col("s").alias("did"), "text").mapInArrow(_term_counts(found), "term string, n long").groupBy("term").agg(F.sum("n").alias("nt"))
    counted = core.stash(wanted.join(n.withColumnRenamed("term", "name"), "name"), "counted")  # terms of a class may differ in it
    share = F.log2(F.lit(total) * F.col("net") / (F.col("ne") * F.col("nt"))) / F.log2(F.lit(total) / F.col("ne"))
    x = both.join(counted.select("t", "nt").distinct(), "t").where(F.col("ne") < total).withColumn("share", share).where(F.col("share") >= GENERALISE)
    return core.stash(x.select("e", "t", "nt", "share"), "disclosures"), ec.select("name", "e"), counted, has, near


def disclosures(docs: DataFrame) -> DataFrame:
    """(entity, term, share): terms that disclose `share` >= GENERALISE of an entity's information."""
    x, entities, terms, *_ = _disclosed(chunks.chunked(core.pick(docs, "text")))
    return x.join(entities.withColumnRenamed("name", "entity"), "e").join(terms.withColumnRenamed("name", "term"), ["t", "nt"]).select("entity", "term", "share")


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, sanitised string"


def _mark(key: tuple, chunk: pa.Table, told: pa.Table) -> pa.Table:  # noqa: ARG001
    """The chunk's documents with their spans; told: the terms (r, name, share) to mark in each."""
    shares: dict[int, dict[str, float]] = {}
    for r, name, share in zip(*(told[c].to_pylist() for c in ("r", "name", "share")), strict=True):
        shares.setdefault(r, {})[name] = share
    out = []
    for did, r, t in zip(*(chunk[c].to_pylist() for c in ("doc_id", "r", "text")), strict=True):
        t, own = t or "", shares.get(r, {})
        spans = base_spans(t)
        n = [sum(k == i for _, k, _ in spans) for i in range(4)]
        base = ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in spans)
        new = {(i, k, j): f"[{KINDS[k].upper()}]" for i, k, j in spans}
        if own:
            new |= {(i, 4, j): "" if own[x] >= REMOVE else "[TERM]" for x, i, j in free_terms(t, spans) if x in own}
        every = sorted(new)
        clean, at = [], 0
        for i, k, j in every:
            if i >= at:
                clean += [t[at:i], new[i, k, j]]
            at = max(at, j)
        out.append((did, *n, base, ",".join(f"{KINDS[k]}:{i}:{j}" for i, k, j in every), "".join(clean) + t[at:]))
    types = [*[pa.int64()] * 5, *[pa.string()] * 3]
    cols = zip(*out, strict=True) if out else [[]] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, base and all spans (kind:begin:end), and the sanitised text."""
    d = core.pick(docs, "doc_id", "text")
    table = chunks.chunked(d.withColumn("doc_id", F.col("doc_id").cast("long")))
    x, _, terms, has, near = _disclosed(table)
    mine = has.join(x.select("e", "t", "nt", "share"), "e").groupBy(*ROW, "t", "nt").agg(F.max("share").alias("share"))
    mine = near.join(terms, "name").join(mine, [*ROW, "t", "nt"]).select(*ROW, "name", "share")
    return table.groupBy("s").cogroup(mine.groupBy("s")).applyInArrow(_mark, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = personal_data(core.read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
