"""Operator 5, line dedup: hashes of lines are range-partitioned with a secondary sort by document and position, streamed
once, and the answer is a compressed keep bitmap for each document that loses lines, not text.

Ranges are cut on (hash, document), so that a line that a third of all documents hold is spread over many tasks. A
stream knows the verdict of every run of equal hashes that begins and ends in its partition; of the first and the last
it reports how many documents it saw, and rows that hang on the sum wait for it in the output. Rows of a run with fewer than `min_docs`
documents are held, up to HELD of them; more wait in the output as well, and the run reports its documents when it ends. So
a task holds one batch and HELD rows, also where one document has a line a million times. Hashes are of 128 bits.

Cases: a null or empty text is one empty line; empty keys are never dropped. Rows that repeat a doc_id count as one document, and each
gets its own bitmap, by 128 bits of its text (core.tags); null doc_ids count as one document. Empty tables give empty results.
Extra columns don't matter, and lines that a document repeats all share one verdict.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import core

MIN_DOCS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
DROP, WAIT, SEEN = 0, 1, 2
ROW = ["did", "tag", "tag2"]
OUT = "kind byte, h long, g long, docs long, did long, tag long, tag2 long, pos int, lines int"
#: Rows of an open run that a task holds, and reports of runs (24 bytes) up to which they are broadcast.
HELD, MAX_BROADCAST = 100_000, 500_000


def key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACES)), UPPER, LOWER)


def marked(docs: DataFrame) -> DataFrame:
    """(did, tag, tag2, text): what tells rows apart in all steps, and the text."""
    return docs.select(F.coalesce("doc_id", F.lit(core.NO_ID)).alias("did"), *core.tags(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def line_hashes(docs: DataFrame) -> DataFrame:
    d = marked(docs).select(*ROW, F.split("text", "\n").alias("a"))
    d = d.select(*ROW, F.size("a").alias("lines"), F.posexplode("a").alias("pos", "line"))
    d = d.select(*ROW, "lines", "pos", key(F.col("line")).alias("k")).where("k != ''")
    return d.select(F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("g"), *ROW, "pos", "lines")


def _stream(min_docs: int):
    """Over one partition sorted by (h, g, did, ...): rows to drop, rows that wait, and what the outer runs saw."""

    def rows(kind: int, p: pd.DataFrame, docs: int = 0) -> pd.DataFrame:
        return p.assign(kind=np.int8(kind), docs=np.int64(docs))[["kind", "h", "g", "docs", *ROW, "pos", "lines"]]

    def seen(h: int, g: int, docs: int) -> pd.DataFrame:
        none = {c: [0] for c in ROW} | {c: np.int32([0]) for c in ("pos", "lines")}
        return pd.DataFrame({"kind": np.int8([SEEN]), "h": [h], "g": [g], "docs": [docs], **none})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the open run, while it has fewer than min_docs documents
        spilled = False  # whether some of its rows wait in the output
        at: tuple | None = None  # its key
        n, last, outer = 0, None, True  # its documents, the latest of them, whether it is the partition's first

        def hold(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal spilled
            held.append(p)
            if sum(map(len, held)) > HELD:
                yield from (rows(WAIT, x) for x in held)
                held.clear()
                spilled = True

        def closed(end: bool) -> Iterator[pd.DataFrame]:
            if outer or end or spilled:
                yield seen(*at, n)
                if n < min_docs:
                    yield from (rows(WAIT, x) for x in held)
            held.clear()

        for p in batches:
            if not len(p):
                continue
            h, g, did = p["h"].to_numpy(), p["g"].to_numpy(), p["did"].to_numpy()
            new = np.empty(len(p), bool)
            new[0] = True
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            doc = new.copy()
            doc[1:] |= did[1:] != did[:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(p))
            docs = np.add.reduceat(doc.astype(np.int64), begin)
            first, lo = 0, 0
            if at == (h[0], g[0]):  # the open run goes on
                docs[0] += n - (did[0] == last)
                if docs[0] >= min_docs:
                    yield from (rows(DROP, x) for x in held)
                    held.clear()
                    yield rows(DROP, p.iloc[: end[0]])
                else:
                    yield from hold(p.iloc[: end[0]].copy())
                n, last, first, lo = int(docs[0]), did[end[0] - 1], 1, end[0]
            if first == len(begin):
                continue
            if at is not None:
                yield from closed(False)
                outer = False
            inner = slice(first, len(begin) - 1)  # runs that begin and end here
            if at is None and len(begin) > 1:  # but for the partition's first
                yield seen(h[0], g[0], int(docs[0]))
                if docs[0] < min_docs:
                    yield rows(WAIT, p.iloc[: end[0]])
            drop = np.repeat(docs[inner] >= min_docs, (end - begin)[inner])
            if at is None and len(begin) > 1 and docs[0] < min_docs:
                drop[: end[0]] = False
            if drop.any():
                yield rows(DROP, p.iloc[lo : begin[-1]][drop])
            outer = at is None and len(begin) == 1
            tail = p.iloc[begin[-1] :]
            at, n, last, spilled = (h[-1], g[-1]), int(docs[-1]), did[-1], False
            if n >= min_docs:
                yield rows(DROP, tail)
            else:
                yield from hold(tail.copy())
        if at is not None:
            yield from closed(True)

    return run


def verdicts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(did, tag, tag2, pos, lines) of every line that goes."""
    spark = docs.sparkSession
    lines = core.stash(line_hashes(core.pick(docs, "doc_id", "text")), "line_hashes")  # read twice: ranges are cut on a sample
    ranged = lines.repartitionByRange(core.parts(spark), "h", "g", "did").sortWithinPartitions("h", "g", *ROW, "pos")
    out = core.stash(ranged.mapInPandas(_stream(min_docs), OUT), "line_verdicts")
    total = out.where(f"kind = {SEEN}").groupBy("h", "g").agg(F.sum("docs").alias("docs")).where(f"docs >= {min_docs}").select("h", "g")
    few = total.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST  # two a partition, and one for each HELD rows at most
    late = out.where(f"kind = {WAIT}").join(F.broadcast(total) if few else total, ["h", "g"], "left_semi")
    return out.where(f"kind = {DROP}").unionByName(late).select(*ROW, "pos", "lines")


@F.pandas_udf(T.BinaryType())
def _bitmap(at: pd.Series, lines: pd.Series) -> pd.Series:
    def one(p, n):
        keep = np.ones(n, bool)
        keep[np.asarray(p)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(p, n) for p, n in zip(at, lines, strict=True)], dtype=object)


def bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The operator's result: (did, tag, tag2, lines, dropped, bitmap), bit i of the zlib-compressed bitmap set if line i stays;
    documents that keep all their lines have no row."""
    by = verdicts(docs, min_docs).groupBy(*ROW).agg(F.collect_set("pos").alias("p"), F.max("lines").alias("lines"))
    return by.select(*ROW, "lines", F.size("p").alias("dropped"), _bitmap("p", "lines").alias("bitmap"))


@F.pandas_udf(T.StringType())
def _keep(text: pd.Series, bitmap: pd.Series, n: pd.Series) -> pd.Series:
    def one(t, b, n):
        if b is None:
            return None
        lines = t.split("\n")
        if len(lines) != n:
            raise ValueError(f"a bitmap of {int(n)} lines meets a text of {len(lines)}")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines))
        return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)

    return pd.Series([one(t, b, k) for t, b, k in zip(text, bitmap, n, strict=True)], dtype=object)


def applied(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the columns _dropped (null if none) and _kept (the text that stays, null if all of it does)."""
    b = bitmaps(docs, min_docs).select(*[F.col(c).alias(f"_{c}") for c in ROW], "dropped", "bitmap", F.col("lines").alias("_lines"))
    own = [F.coalesce(docs["doc_id"], F.lit(core.NO_ID)), *core.tags(docs["text"])]
    d = docs.join(b, [x == b[f"_{c}"] for c, x in zip(ROW, own, strict=True)], "left")
    d = d.withColumn("_kept", _keep(F.when(F.col("bitmap").isNotNull(), docs["text"]), F.col("bitmap"), F.col("_lines")))
    return d.withColumnRenamed("dropped", "_dropped").drop(*[f"_{c}" for c in ROW], "_lines", "bitmap")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = applied(core.pick(core.read(spark, sf_dir, "documents"), "doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    return d.select(
        "doc_id", lines.cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("_kept", text).cast("binary"), 256).alias("kept_sha256"),
    )


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that go; all rows and columns stay."""
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    i, j = own.index("doc_id"), own.index("text")
    d = applied(plain.withColumnsRenamed({f"c{i}": "doc_id", f"c{j}": "text"}))
    d = d.withColumn("text", F.coalesce("_kept", "text"))
    return d.select(*["doc_id" if k == i else "text" if k == j else f"c{k}" for k in range(len(own))]).toDF(*own)


ORACLE_SQL = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE b.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad b ON k.key = b.key GROUP BY doc_id
"""
