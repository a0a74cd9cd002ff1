"""Operator 10, substring dedup with a count-min prefilter: words within a 13-word window that also starts in a document
with a smaller doc_id go.

Rows are written once to a table of chunks (chunks.py): (s, r) is the chunk and the row in it, and the table is bucketed by s, so that what
is found out about a chunk meets its texts without moving them.

Pass 1 sketches, for each chunk, in how many documents windows occur; the chunks' sketches are merged block by
block, and each block tells every chunk which of the chunk's cells reached 2. So the sketch is nowhere held as a whole: it grows with the
corpus, some 8 cells a key in each of two rows, at some 2 bytes of traffic a word. A window is sketched by its minimizer, the least
hash of its 6-word parts: equal windows have equal minimizers, so the estimate is never below a window's count, and four times fewer
keys fill the sketch.

Pass 2 groups exactly, by 96-bit hashes, the windows estimated at 2 or more. Each chunk first combines its own: of a
window's documents within a chunk all but the least surely lose it, so a window that a third of all documents hold is sent
once a chunk, not once a document. Windows travel packed, by ranges of their hash, each of some GROUP windows; positions go back to their chunks.

Cases: null or empty texts have no words. Null doc_ids count as one document, after all others. Rows that repeat a doc_id
are one document for the comparison, and each loses words by its own positions. Empty tables give empty results. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, core, text

WINDOW, PART = 13, 6
#: Windows that are grouped at once, on average.
GROUP = 1 << 20
#: Cells a byte of text in each row: 8 for each of some 0.22 minimizers a word of some 6 bytes.
CELLS_PER_BYTE = 0.3
MIN_WIDTH = 1 << 16


def _rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    n = len(h) - k + 1
    w = np.full(n, seed, np.uint64)
    for i in range(k):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407) + h[i : i + n]
    return text.mix(w)


def _windows(data: np.ndarray, off: np.ndarray):
    """Of all windows within texts: number of the text, position in it, first word's index, word hashes, minimizers."""
    starts, ends, first = text.words(data, off)
    h = text.word_hashes(data, starts, ends)
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, h, h[:0]
    n = len(h) - WINDOW + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))[:n]
    at = np.flatnonzero(first[doc + 1] - np.arange(n) >= WINDOW)
    low = _rolling(h, PART, 1)
    for step in (1, 2, 4):  # the least of 8 parts
        low = np.minimum(low[:-step], low[step:])
    return doc[at], at - first[doc[at]], at, h, low[at]


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """Cells of both rows, the second after the first."""
    mask = np.uint64(width - 1)
    return np.stack([keys & mask, (text.mix(keys ^ np.uint64(0x9E6C63D0876A9A47)) & mask) + np.uint64(width)])


def chunked(docs: DataFrame) -> DataFrame:
    """(s, r, doc_id, text), written once and bucketed by s."""
    return chunks.chunked(core.pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")))


def _sketch(width: int, bits: int):
    """Of each chunk, for each block of cells: the cells that its documents count up (once), and those that more than one does (twice)."""
    schema = pa.schema([("block", pa.int32()), ("s", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])

    def flushed(s: int, held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(_cells(np.concatenate(held), width).ravel())
        new = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        cells, two = cells[new], np.diff(np.append(new, len(cells))) > 1
        block = (cells >> np.uint64(bits)).astype(np.int32)
        low = (cells & np.uint64((1 << bits) - 1)).astype(np.uint32)
        cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
        pairs = list(zip(cut[:-1], cut[1:], strict=True))
        once = [low[i:j].tobytes() for i, j in pairs]
        twice = [low[i:j][two[i:j]].tobytes() for i, j in pairs]
        return pa.RecordBatch.from_arrays([pa.array(block[cut[:-1]]), pa.array(np.full(len(pairs), s)), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            ss = b.column(0).to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], ss[1:] != ss[:-1]])), len(ss)) if len(ss) else []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if ss[lo] != at:
                    if held:
                        yield flushed(at, held)
                    at, held = int(ss[lo]), []
                for _, _, data, off in text.portions(b.column(1).slice(lo, hi - lo)):
                    doc, _, _, _, keys = _windows(data, off)
                    if not len(keys):
                        continue
                    order = np.lexsort((keys, doc))  # a document counts once
                    doc, keys = doc[order], keys[order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                    held.append(keys[new])
        if held:
            yield flushed(at, held)

    return run


def _merge(bits: int):
    """Over rows sorted by block: for each chunk its cells of the block (block, s, hot) that two documents or more count up."""
    schema = pa.schema([("block", pa.int32()), ("s", pa.int64()), ("hot", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, one, two = None, [], np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)

        def answers() -> Iterator[pa.RecordBatch]:
            found = [(s, x[two[x]]) for s, x in held]
            found = [(s, x) for s, x in found if len(x)]
            for _, x in held:
                one[x] = False
                two[x] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], schema=schema)

        for b in batches:
            for block, s, once, twice in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if block != at:
                    yield from answers()
                    at, held = block, []
                x = np.frombuffer(once, np.uint32)
                two[x[one[x]]] = True
                one[x] = True
                two[np.frombuffer(twice, np.uint32)] = True
                held.append((s, x))
        yield from answers()

    return run


def hot_cells(table: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(block, s, hot): the merged sketch's answers to the chunks, for blocks of 2^bits cells; bits."""
    spark = table.sparkSession
    bits = 16
    while bits < 24 and (2 * width >> bits + 1) >= 4 * core.parts(spark):
        bits += 1
    partial = table.select("s", "text").mapInArrow(_sketch(width, bits), "block int, s long, once binary, twice binary")
    merged = partial.repartition(core.parts(spark), "block").sortWithinPartitions("block").mapInArrow(_merge(bits), "block int, s long, hot binary")
    return merged, bits


def width_of(n: int) -> int:
    """Cells of a row of the sketch for so many bytes of text."""
    width = MIN_WIDTH
    while width < n * CELLS_PER_BYTE:
        width *= 2
    return width


PACKED = "part int, s long, h binary, h2 binary, did binary, r binary, pos binary"


def _repeats(width: int, bits: int, groups: int):
    """Of a chunk's texts and the sketch's answers: windows estimated to be repeated, packed by part (range of the hash), of each one
    its least document here; and, without hashes, the rows and positions that a smaller document of this chunk settles."""
    schema = pa.schema([("part", pa.int32()), ("s", pa.int64()), *[(c, pa.binary()) for c in ("h", "h2", "did", "r", "pos")]])

    def packed(s: int, part: np.ndarray, *cols: np.ndarray | None) -> list[pa.RecordBatch]:
        if not len(part):
            return []
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        m = len(cut) - 1
        own = [pa.nulls(m, pa.binary()) if x is None else pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in cols]
        return [pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]], pa.int32()), pa.array(np.full(m, s)), *own], schema=schema)]

    def run(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        s, none = key[0].as_py(), schema.empty_table()
        if not answers.num_rows:
            return none
        hot = [np.frombuffer(x, np.uint32) + (np.uint64(k) << np.uint64(bits)) for k, x in zip(answers["block"].to_pylist(), answers["hot"].to_pylist(), strict=True)]
        hot = np.sort(np.concatenate(hot).astype(np.uint64))
        dids, rs, held = chunk["did"].to_numpy(), chunk["r"].to_numpy(), []
        for i, _, data, off in text.portions(chunk["text"].combine_chunks()):
            doc, pos, at, h, keys = _windows(data, off)
            if not len(keys):
                continue
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # neighbours share their minimizer
            ok = np.ones(len(new), bool)
            for c in _cells(keys[new], width):
                ok &= hot[np.minimum(np.searchsorted(hot, c), len(hot) - 1)] == c
            ok = np.repeat(ok, np.diff(np.append(new, len(keys))))
            if ok.any():
                at, doc = at[ok], doc[ok] + i
                w2 = (_rolling(h, WINDOW, 3)[at] >> np.uint64(32)).astype(np.uint32)
                held.append((_rolling(h, WINDOW, 2)[at], w2, dids[doc], rs[doc], pos[ok].astype(np.int32)))
        if not held:
            return none
        h, h2, did, r, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((did, h2, h))
        h, h2, did, r, pos = h[order], h2[order], did[order], r[order], pos[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
        gone = did > did[np.flatnonzero(new)][np.cumsum(new) - 1]
        part = lambda x: ((x >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)  # noqa: E731  in the order of x
        keep = ~gone
        out = packed(s, part(h[keep]), h[keep], h2[keep], did[keep], r[keep], pos[keep])
        out += packed(s, np.full(gone.sum(), s % groups, np.int32), None, None, None, r[gone], pos[gone])
        return pa.Table.from_batches(out, schema)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by part: (s, r, pos), packed by chunk, of windows that a smaller document holds as well."""
    schema = pa.schema([("s", pa.int64()), ("r", pa.binary()), ("pos", pa.binary())])

    def lost(held: list) -> Iterator[pa.RecordBatch]:
        s = np.repeat([x[0] for x in held], [len(x[1]) for x in held])
        h, h2, did, r, pos = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        order = np.lexsort((did, h2, h))
        a, b, d = h[order], h2[order], did[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        gone = np.sort(order[d > d[np.flatnonzero(new)][np.cumsum(new) - 1]])  # in the order of chunks again
        if len(gone):
            s, r, pos = s[gone], r[gone], pos[gone]
            cut = np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s))
            own = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (r, pos)]
            yield pa.RecordBatch.from_arrays([pa.array(s[cut[:-1]]), *own], schema=schema)

    at, held = None, []
    for b in batches:
        for part, s, h, h2, did, r, pos in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
            if part != at:
                if held:
                    yield from lost(held)
                at, held = part, []
            if h is None:
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([r], pa.binary()), pa.array([pos], pa.binary())], schema=schema)
            else:
                held.append((s, np.frombuffer(h, np.uint64), np.frombuffer(h2, np.uint32), np.frombuffer(did, np.int64), np.frombuffer(r, np.int32), np.frombuffer(pos, np.int32)))
    if held:
        yield from lost(held)


def repeats(table: DataFrame, n: int) -> DataFrame:
    """Windows of the chunks that pass the sketch (PACKED), for n bytes of text."""
    width = width_of(n)
    hot, bits = hot_cells(table, width)
    groups = max(core.parts(table.sparkSession), int(n / 6 / GROUP))
    own = table.select("s", "r", F.coalesce("doc_id", F.lit(core.NO_ID)).alias("did"), "text")
    return own.groupBy("s").cogroup(hot.groupBy("s")).applyInArrow(_repeats(width, bits, groups), PACKED)


def removals(table: DataFrame) -> DataFrame:
    """(s, r, pos): rows of chunks and positions of their windows that a smaller document holds as well, as packed int32 arrays."""
    n = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeats(table, n).repartition(core.parts(table.sparkSession), "part").sortWithinPartitions("part")
    return found.mapInArrow(_grouped, "s long, r binary, pos binary")


CUT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(key: tuple, chunk: pa.Table, lost: pa.Table) -> pa.Table:  # noqa: ARG001
    """The chunk's texts without what is lost."""
    r, pos = (np.frombuffer(b"".join(lost[c].to_pylist()), np.int32) for c in ("r", "pos"))
    order = np.argsort(r, kind="stable")
    r, pos = r[order], pos[order]
    at, n, gone, kept = chunk["r"].to_numpy(), [], [], []
    first, last = np.searchsorted(r, at), np.searchsorted(r, at, "right")
    for t, i, j in zip(chunk["text"].to_pylist(), first, last, strict=True):
        ws = t.encode().split() if t else []
        left = ws
        if i < j:
            step = np.zeros(len(ws) + 1, np.int64)
            own = np.unique(pos[i:j])
            step[own] += 1
            step[own + WINDOW] -= 1
            left = list(compress(ws, np.cumsum(step)[:-1] == 0))
        n.append(len(ws))
        gone.append(len(ws) - len(left))
        kept.append(b" ".join(left).decode())
    return pa.table({"doc_id": chunk["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.string())})


def substring_dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    table = chunked(docs)
    return table.groupBy("s").cogroup(removals(table).groupBy("s")).applyInArrow(_cut, CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup(core.read(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM x),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
r AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN m ON s.k = m.k WHERE m.least < s.doc_id),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
z AS (SELECT t.doc_id, count(*) AS n_words, count(r.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE r.p IS NULL), '') AS kept
      FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.p = r.p GROUP BY t.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN z ON d.doc_id = z.doc_id
"""
