"""Operator 3, near-duplicates by HyperMinHash: one hash a shingle; its top bits choose a bucket, and of each bucket's least
hash the register keeps the count of leading zeros (6 bits) and the mantissa after them (10 bits).

1. Rows with the same shingle set form a class (128-bit fingerprint), which the text of its row with the least doc_id represents. All below
   is about classes (64-bit numbers, `rep`), so exact copies are never paired.
2. Empty buckets borrow the register of another in a fixed random order; 32 bands of 4 registers (64 bits), half of all, are the keys.
3. First round: in each band bucket all members are paired with the least, and with their neighbours in the order of the bands that follow.
   The Jaccard estimate of the registers, less the share expected to collide by chance, drops what is far below the threshold; what is
   left is confirmed on full shingle sets.
4. A bound for what is in buckets (without their least member) that hold more than one component yet: `most`, the number of a member's
   shingles that stand in any member of another component. It is exact, counted on full sets, and no link to another component can
   share more. Documents that hold a part of a large group's text and words of their own beside it are ruled out by it at once,
   all together, in one pass over their shingles instead of a test against each member of the group.
5. What the bound leaves outside its bucket's largest component is tested, on full sets, against all members of such buckets: in
   blocks of such documents, each with an index from shingles to documents that counts a member's shared shingles with the whole
   block at once. Only links come out, no pairs. Each pair that shares a bucket was then tested, ruled out by the bound, or
   is in one component. Nothing is capped.
6. Connected components over confirmed links (graph.py).

A pair at the threshold of 0.75 shares a band with probability 1 - (1 - 0.75^4)^32 = 0.999995. The estimate's cut lies SIGMAS standard
deviations below the threshold; the deviation follows from the registers that the smaller set fills by itself. Pairs with a
set of fewer than LEAST_SET shingles are tested without it; a pair that it rules out falsely meets again in step 5.
Texts, not sets, travel to the verification: they are smaller. Only those of documents that share a bucket do.

Cases: texts without words are linked with nothing. Fewer than five words are one shingle. Null doc_ids: a component_id is null if no
member has an id. Rows that repeat a doc_id, or have none, are judged by their own text: a document's id links nothing. Empty tables give empty results.
Extra columns don't matter. Exact ties (three quarters) are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import core, graph, text

SHINGLE, PERCENT = 5, 75
BUCKET_BITS, BAND, BANDS = 8, 4, 32
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
#: How far below the threshold registers rule a pair out, in standard deviations, and the sets for which they don't at all.
SIGMAS, LEAST_SET = 6.0, 64
#: Shingles that a task holds before it passes them on, and that a slot of the bound has on average.
HELD, SLOT = 1 << 20, 1 << 19
#: Documents and shingles of a block, and the members that one task holds against it, on average.
BLOCK, BLOCK_SHINGLES, MEMBERS = 1024, 1 << 20, 4096
#: Rows (at most 32 bytes of numbers) up to which they are broadcast to pick texts; beyond, texts are shuffled.
MAX_BROADCAST = 500_000
_PROBE = np.argsort(np.random.Generator(np.random.PCG64(5)).random((BUCKETS, BUCKETS)), axis=1)
ROW = ["did", "tag", "tag2"]
FEATURES = pa.schema([*[(c, pa.int64()) for c in ROW], ("n", pa.int64()), ("f", pa.int64()), ("g", pa.int64()), ("bands", pa.list_(pa.int64()))])


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) in portions."""
    for i, _, data, off in text.portions(texts):
        starts, ends, first = text.words(data, off)
        h = text.word_hashes(data, starts, ends, lower=True)
        w, at = text.windows(h, first, SHINGLE)
        cut = np.searchsorted(at, first)
        sets = []
        for k in range(len(off) - 1):
            n = first[k + 1] - first[k]
            if 0 < n < SHINGLE:
                short, _ = text.windows(h[first[k] : first[k + 1]], np.array([0, n]), int(n))
                sets.append(text.mix(short + np.uint64(n)))
            else:
                sets.append(np.unique(w[cut[k] : cut[k + 1]]))
        yield i, sets


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted non-empty set of hashes."""
    bucket = (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = s[at] << np.uint64(BUCKET_BITS)
    top = np.where(least > 0, 63 - np.floor(np.log2(np.maximum(least >> np.uint64(11), np.uint64(1)).astype(np.float64))).astype(np.int64) - 11, 63)
    zeros = np.clip(top, 0, 63 - BUCKET_BITS)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out, full = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[bucket[at]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    full[bucket[at]] = True
    if len(at) < BUCKETS:
        from_ = _PROBE[np.arange(BUCKETS), full[_PROBE].argmax(axis=1)]
        out = np.where(full, out, out[from_])
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [b.column(k).cast(pa.int64()) for k in range(3)]
        for i, sets in shingle_sets(b.column(3)):
            n = np.array([len(s) for s in sets], np.int64)
            f = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            g = np.array([text.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            regs = [registers(s) if len(s) else np.zeros(0, np.uint16) for s in sets]
            bands = [r.view(np.int64) for r in regs]
            yield pa.RecordBatch.from_arrays([*[x.slice(i, len(sets)) for x in own], pa.array(n), pa.array(f), pa.array(g), pa.array(bands, pa.list_(pa.int64()))], schema=FEATURES)


def rows_of(docs: DataFrame) -> DataFrame:
    return core.pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(core.NO_ID)).alias("did"), *core.tags(F.col("text")), "text")


def features(docs: DataFrame) -> DataFrame:
    """(did, tag, tag2, n, f, g, bands): size and fingerprint of the shingle set, and the registers, four to a number."""
    return rows_of(docs).mapInArrow(_features, "did long, tag long, tag2 long, n long, f long, g long, bands array<long>")


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance, for sets of n and m shingles that share nothing: two least hashes
    of one bucket agree in leading zeros and mantissa. With x = n / buckets and y = m / buckets it is the sum over register
    cells of the products of their probabilities."""
    x, y = np.maximum(n, 1)[:, None] / BUCKETS, np.maximum(m, 1)[:, None] / BUCKETS
    lo = 0.5 ** np.arange(1, 41)[None, :]  # a cell of leading zeros z holds least hashes from 2^-(z+1) to 2^-z
    px, py = (np.exp(-v * lo) - np.exp(-v * 2 * lo) for v in (x, y))
    return (px * py).sum(axis=1) / (1 << MANTISSA)


@F.pandas_udf(T.DoubleType())
def estimate(a, b, n, m):  # noqa: ANN001, ANN201
    """Jaccard estimate from two rows' registers, corrected for chance collisions."""
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="float64")
    p, q = (np.stack(x.to_numpy()).astype(np.int64).view(np.uint16) for x in (a, b))
    same, chance = (p == q).mean(axis=1), collisions(n.to_numpy(float), m.to_numpy(float))
    return pd.Series(np.clip((same - chance) / (1 - chance), 0, 1))


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for b in batches:
            left = (s for _, sets in shingle_sets(b.column(2)) for s in sets)
            right = (s for _, sets in shingle_sets(b.column(3)) for s in sets)
            ok = []
            for p, q in zip(left, right, strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    return run


def _of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of table whose rep is among ids."""
    few = ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return table.join(F.broadcast(ids) if few else ids, "rep", "left_semi")


def cut(n: Column, mean: float) -> Column:
    """The least share of registers that agree in pairs at the threshold, where `mean` of them do on average and the
    smaller set has n shingles; nothing (0) for small sets."""
    filled = BUCKETS * (1 - F.exp(-n / float(BUCKETS)))
    return F.when(n < LEAST_SET, 0.0).otherwise(mean - SIGMAS * F.sqrt(mean * (1 - mean) / filled))


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) that are links: by the registers' estimate first, then on full sets."""
    r = reps.select("rep", "n", "bands")
    p = pairs.join(r.toDF("u", "nu", "bu"), "u").join(r.toDF("v", "nv", "bv"), "v")
    p = p.where((100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (estimate("bu", "bv", "nu", "nv") >= cut(F.least("nu", "nv"), percent / 100))).select("u", "v")
    p = core.stash(p, "likely")
    t = _of(texts, p.select(F.explode(F.array("u", "v")).alias("rep")).distinct())
    both = p.join(t.toDF("u", "tu"), "u").join(t.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")
    return core.stash(both.mapInArrow(_verify(percent), "u long, v long"), "links")


def member_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, text) of the rows (rep, did, tag, tag2): one text each, also where a row is repeated."""
    n = ids.count()
    t = core.stash(rows_of(docs).join(F.broadcast(ids) if n <= MAX_BROADCAST else ids, ROW).select("rep", "text"), "member_texts")
    return t if t.count() == n else core.stash(t.dropDuplicates(["rep"]), "member_texts")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: did, tag, tag2 (core.tags), n_shingles, and the least (did, tag, tag2) of its component."""
    feats = core.stash(features(docs), "features")
    classes = feats.where("n > 0").groupBy("f", "g", "n").agg(F.min(F.struct(*ROW)).alias("own"), F.first("bands").alias("bands"))
    classes = core.stash(classes.withColumn("rep", F.xxhash64("f", "g", "n")), "classes")
    keys = classes.select("rep", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "key"), "bands")
    after = [F.get("bands", F.pmod(F.col("band") + i, F.lit(BANDS))).alias(f"k{i}") for i in (1, 2, 3)]
    keys = keys.select("rep", "band", "key", *after)
    many = keys.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1")
    members = core.stash(keys.join(many, ["band", "key"]), "members")
    ids = core.stash(members.select("rep").distinct(), "member_ids")
    reps = core.stash(_of(classes.select("rep", "own", "n", "bands"), ids), "member_registers")
    texts = member_texts(docs, reps.select("rep", "own.*"))
    star = members.where("rep != least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    links = confirmed(star.unionByName(neighbours(members)).distinct(), reps, texts, percent)
    comp = core.stash(graph.components(links), "components")
    m = open_buckets(members.where("size > 2 and rep != least").select("band", "key", "rep"), comp)
    if not m.isEmpty():
        links = core.stash(matched(bounded(with_bound(m, reps, texts), percent), texts, percent), "block_links")
        if not links.isEmpty():
            old = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comp = core.stash(graph.components(old.unionByName(links)), "components")
    least = comp.join(classes.select(F.col("rep").alias("node"), "own"), "node").groupBy("component").agg(F.min("own").alias("least"))
    comp = comp.join(least, "component").select(F.col("node").alias("rep"), "least")
    named = classes.select("f", "g", "n", "rep", "own").join(comp, "rep", "left").select("f", "g", "n", F.coalesce("least", "own").alias("least"))
    return feats.select(*ROW, "n", "f", "g").join(named, ["f", "g", "n"], "left").select(*ROW, F.col("n").alias("n_shingles"), F.coalesce("least", F.struct(*ROW)).alias("least"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: did, n_shingles, component (the least did reachable)."""
    return groups(docs, percent).select("did", "n_shingles", F.col("least.did").alias("component"))


def _next_to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows (band, key, rep): consecutive members of a bucket as pairs."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        band, key, rep = (np.asarray(b.column(i)) for i in range(3))
        if last is not None:
            band, key, rep = (np.concatenate([x[None].astype(y.dtype), y]) for x, y in zip(last, (band, key, rep), strict=True))
        last = band[-1], key[-1], rep[-1]
        same = (band[1:] == band[:-1]) & (key[1:] == key[:-1]) & (rep[1:] != rep[:-1])
        u, v = np.maximum(rep[1:], rep[:-1])[same], np.minimum(rep[1:], rep[:-1])[same]
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)


def neighbours(members: DataFrame) -> DataFrame:
    """Pairs of members next to each other in their bucket's order by the bands that follow: likely the most similar, so
    that copies of copies link in the first round. Ranges are cut within buckets too; pairs across a cut aren't needed."""
    d = members.where("size > 2").select("band", "key", "rep", "k1", "k2", "k3")
    d = d.repartitionByRange(core.parts(members.sparkSession), "band", "key", "k1", "k2").sortWithinPartitions("band", "key", "k1", "k2", "k3", "rep")
    return d.select("band", "key", "rep").mapInArrow(_next_to, "u long, v long")


def open_buckets(left: DataFrame, comp: DataFrame) -> DataFrame:
    """Members (band, key, rep, c) of the buckets whose members aren't in one component c yet, with the component that most of
    the bucket is in."""
    at = ["band", "key"]
    m = left.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*at, "rep", F.coalesce("component", "rep").alias("c"))
    per = m.groupBy(*at, "c").agg(F.count("*").alias("k"))
    bulk = per.groupBy(*at).agg(F.max(F.struct("k", "c")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
    return core.stash(m.join(bulk.select(*at, F.col("x.c").alias("bulk")), at), "open_buckets")


FOREIGN = "slot int, kind int, s binary, c binary, many binary"


def _shingles_by_slot(slots: int):
    """Of documents (rep, c, asks, text): for each slot of shingles a row of kind 0, the shingles with a component that holds them
    and whether another here does, and a row of kind 1, the shingles (s) of documents (c) that ask and can't tell yet. What is shared
    within the task needs no answer: it is counted at once, in rows of kind 2 (documents s, counts c)."""
    schema = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("s", pa.binary()), ("c", pa.binary()), ("many", pa.binary())])

    def rows(kind: int, slot: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
        """One row a slot, of columns that are sorted by slot."""
        at = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in cols]
        packed += [pa.nulls(len(at) - 1, pa.binary())] * (3 - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(slot[at[:-1]], pa.int32()), pa.array(np.full(len(at) - 1, kind, np.int32)), *packed], schema=schema)

    def flushed(held: list) -> Iterator[pa.RecordBatch]:
        s, rep, c, asks = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(s, kind="stable")
        s, rep, c, asks = s[order], rep[order], c[order], asks[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        low = np.minimum.reduceat(c, at)
        many = low != np.maximum.reduceat(c, at)
        slot = lambda x: ((x >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int32)  # noqa: E731  in the order of x
        yield rows(0, slot(s[at]), s[at], low, many.astype(np.uint8))
        known = np.repeat(many, np.diff(np.append(at, len(s))))
        open_ = asks & ~known
        if open_.any():
            yield rows(1, slot(s[open_]), s[open_], rep[open_])
        if (asks & known).any():
            who, n = np.unique(rep[asks & known], return_counts=True)
            to = (text.mix(who.view(np.uint64)) % np.uint64(slots)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            yield rows(2, to[order], who[order], n[order].astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            rep, c, asks = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, sets in shingle_sets(b.column(3)):
                for k, s in enumerate(sets, i):
                    held.append((s, np.full(len(s), rep[k]), np.full(len(s), c[k]), np.full(len(s), asks[k])))
                    n += len(s)
                if n >= HELD:
                    yield from flushed(held)
                    held, n = [], 0
        if n:
            yield from flushed(held)

    return run


def _foreign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by slot and kind: (rep, most), parts of the number of a document's shingles that another component holds."""
    schema = pa.schema([("rep", pa.int64()), ("most", pa.int64())])
    at, held, shared = None, [], None

    def merged() -> list:
        s, c, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(s, kind="stable")
        s, c, many = s[order], c[order], many[order]
        i = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        low = np.minimum.reduceat(c, i)
        return [(s[i], low, np.maximum.reduceat(many, i) | (low != np.maximum.reduceat(c, i)))]

    for b in batches:
        for slot, kind, s, c, many in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if slot != at:
                at, held, shared = slot, [], None
            if kind == 0:
                held.append((np.frombuffer(s, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(many, np.uint8)))
                if sum(len(x[0]) for x in held[1:]) > max(HELD, len(held[0][0])):
                    held = merged()
                continue
            if kind == 1:
                if shared is None:
                    held = merged()
                    shared, held = held[0][0][held[0][2] > 0], []
                x, rep = np.frombuffer(s, np.uint64), np.frombuffer(c, np.int64)
                i = np.searchsorted(shared, x)
                hit = np.zeros(len(x), bool) if not len(shared) else shared[np.minimum(i, len(shared) - 1)] == x
                who, n = np.unique(rep[hit], return_counts=True)
            else:
                who, n = np.frombuffer(s, np.int64), np.frombuffer(c, np.int64)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], schema=schema)


def with_bound(m: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """m with n and `most`: for members outside their buckets' largest components, the number of their shingles that a member of
    another component holds, n for others. Slots follow the shingles: a task holds the distinct ones of a slot, and a shingle that many
    documents share is sent once a task."""
    spark = m.sparkSession
    who = m.groupBy("rep").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("bulk")).alias("asks"))
    who = core.stash(who.join(reps.select("rep", "n"), "rep"), "bound_of")
    slots = max(core.parts(spark), (who.agg(F.sum("n")).first()[0] or 0) // SLOT)
    d = who.join(texts, "rep").select("rep", "c", "asks", "text")
    got = d.mapInArrow(_shingles_by_slot(slots), FOREIGN).repartition(core.parts(spark), "slot").sortWithinPartitions("slot", "kind")
    got = got.mapInArrow(_foreign, "rep long, most long").groupBy("rep").agg(F.sum("most").alias("most"))
    got = who.join(got, "rep", "left").select("rep", "n", F.when(F.col("asks"), F.coalesce("most", F.lit(0).cast("long"))).otherwise(F.col("n")).alias("most"))
    return m.join(got, "rep")


def fits(shared, n, m, percent: int):  # noqa: ANN001, ANN201
    """Whether sets of n and m members may be a link if they share so many."""
    return (100 + percent) * shared >= percent * (n + m)


def bounded(m: DataFrame, percent: int) -> DataFrame:
    """(bulk, rep, c, n, most, out): of buckets, known by their largest component, the members that may have a link to another component,
    and whether they are outside. Of what a member may be linked with in its bucket, a set as large as all it can share,
    or the bucket's smallest set if that is larger, makes the most of it."""
    at = ["band", "key"]
    out = F.col("c") != F.col("bulk")
    low = m.groupBy(*at).agg(F.min("n").alias("low"))
    m = m.join(low, at).where(~out | fits(F.col("most"), F.col("n"), F.greatest("most", "low"), percent))
    still = m.groupBy(*at).agg(F.max(out).alias("any")).where("any").select(*at)
    return core.stash(m.join(still, at).select("bulk", "rep", "c", "n", "most", out.alias("out")).distinct(), "bounded")


def matched(d: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members outside and all members of their buckets. Those outside, per largest component, are dealt into
    blocks, and the members into salts, so that no task holds more than a block: a member goes to each block, a block to each salt."""
    of = d.groupBy("bulk").agg(
        F.greatest(F.ceil(F.count(F.when(F.col("out"), 1)) / BLOCK), F.ceil(F.sum(F.when(F.col("out"), F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("long").alias("blocks"),
        F.ceil(F.count("*") / MEMBERS).cast("long").alias("salts"),
    )
    d = d.join(of, "bulk")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block, salt = (F.pmod(F.xxhash64("rep", F.lit(i)), F.col(c)) for i, c in enumerate(("blocks", "salts")))
    rows = ["bulk", "block", "salt", "kind", "rep", "c", "n", "most"]
    asks = d.where("out").withColumn("block", block).withColumn("salt", upto("salts")).withColumn("kind", F.lit(0)).select(*rows)
    told = d.withColumn("salt", salt).withColumn("block", upto("blocks")).withColumn("kind", F.lit(1)).select(*rows)
    both = asks.unionByName(told).join(texts, "rep").select(*rows, "text")
    both = both.repartition(core.parts(d.sparkSession), "bulk", "block", "salt").sortWithinPartitions("bulk", "block", "salt", "kind")
    return both.mapInArrow(_match(percent), "u long, v long")


def _match(percent: int):
    """Over rows sorted by block, salt and kind: each member (kind 1) against all documents of the block (kind 0) at once."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def index(block: list) -> tuple:
        rep, c, n, most = (np.array(x, np.int64) for x in list(zip(*block, strict=True))[:4])
        s, of = np.concatenate([x[4] for x in block]), np.repeat(np.arange(len(block)), n)
        order = np.argsort(s, kind="stable")
        s, of = s[order], of[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return rep, c, n, most, s[at], np.append(at, len(s)), of

    def links(block: tuple, rep: int, c: int, n: int, most: int, s: np.ndarray) -> np.ndarray:
        reps, cs, ns, mosts, keys, at, of = block
        may = (cs != c) & fits(np.minimum(mosts, most), ns, n, percent) & (100 * np.minimum(ns, n) >= percent * np.maximum(ns, n))
        if not may.any():
            return reps[:0]
        i = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        i = i[keys[i] == s]
        size = at[i + 1] - at[i]
        posts = np.repeat(at[i] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        shared = np.bincount(of[posts], minlength=len(reps))
        return reps[may & fits(shared, ns, n, percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for b in batches:
            bulk, blk, salt, kind, rep, c, n, most = (b.column(i).to_numpy().tolist() for i in range(8))
            u, v = [], []
            for i, sets in shingle_sets(b.column(8)):
                for k, s in enumerate(sets, i):
                    if (bulk[k], blk[k], salt[k]) != at:
                        at, held, block = (bulk[k], blk[k], salt[k]), [], None
                    if kind[k] == 0:
                        held.append((rep[k], c[k], n[k], most[k], s))
                    elif held or block:
                        if block is None:
                            block, held = index(held), []
                        for x in links(block, rep[k], c[k], n[k], most[k], s).tolist():
                            u.append(max(x, rep[k]))
                            v.append(min(x, rep[k]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(core.read(spark, sf_dir, "documents"))
    i, c = (F.when(F.col(x) != core.NO_ID, F.col(x)) for x in ("did", "component"))
    return d.select(i.alias("doc_id"), "n_shingles", c.alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each component: the one with its least doc_id. Rows that are identical in id and text all stay or go."""
    found = groups(docs).where(F.struct(*ROW) == F.col("least")).select(*[F.col(c).alias(f"_{c}") for c in ROW]).distinct()
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    mine = [F.coalesce(plain[f"c{own.index('doc_id')}"], F.lit(core.NO_ID)), *core.tags(plain[f"c{own.index('text')}"])]
    on = [x == found[f"_{c}"] for c, x in zip(ROW, mine, strict=True)]
    return plain.join(found, on, "left_semi").toDF(*own)
