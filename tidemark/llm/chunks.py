"""Chunks: rows written once, bucketed by chunk, so that what other tasks find out about a chunk meets its texts without moving them.

A chunk asks about sorted keys, a row for each block (range of keys); the block's task adds up what all chunks say of a key and answers
with the sums alone, in the order of the keys: the chunk's rows are fixed, so that it finds the same keys again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import core

#: Bytes of text of a chunk, on average; a longer text is a chunk of its own.
CHUNK = 10 << 20


def _numbered(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s, r, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            t = b.column("text").cast(pa.large_string())
            ss, rs = [], []
            for n in np.diff(np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]).tolist():
                if held >= size:
                    s, r, held = s + 1, 0, 0
                ss.append(s)
                rs.append(r)
                r += 1
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(ss, pa.int64()), pa.array(rs, pa.int32()), *b.columns], names=["s", "r", *b.schema.names])

    return run


def chunked(df: DataFrame, size: int | None = None) -> DataFrame:
    """df, which has a column text, with the number s of each row's chunk and the row's number r in it."""
    d = df.mapInArrow(_numbered(size or CHUNK), f"s long, r int, {', '.join(f'`{n}` {t}' for n, t in df.dtypes)}")
    return core.bucketed(d, "chunks", "s", core.parts(df.sparkSession))


def blocks(df: DataFrame) -> int:
    return 4 * core.parts(df.sparkSession)


ASKED, ANSWERED = "block int, s long, keys binary, bytes int, n binary", "block int, s long, bytes int, n binary, total array<long>"
_SIZES = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}


def _packed(n: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in as many bytes as the largest needs."""
    size = next(k for k in _SIZES if k == 8 or n.max(initial=0) < 1 << 8 * k)
    return size, n.astype(_SIZES[size]).tobytes()


def asked(s: int, keys: np.ndarray, n: np.ndarray, blocks: int) -> pa.Table:
    """Rows of ASKED: sorted keys (uint64) and numbers of each (a row of n)."""
    block = ((keys >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
    cut = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
    pairs = list(zip(cut[:-1], cut[1:], strict=True))
    packed = [_packed(n[i:j]) for i, j in pairs]
    return pa.table({
        "block": pa.array(block[cut[:-1]], pa.int32()), "s": pa.array(np.full(len(pairs), s), pa.int64()), "keys": pa.array([keys[i:j].tobytes() for i, j in pairs], pa.binary()),
        "bytes": pa.array([size for size, _ in packed], pa.int32()), "n": pa.array([x for _, x in packed], pa.binary()),
    })


def _answers(total):
    """Over rows of ASKED sorted by block: sums of n by key, for each chunk; and total(sums) of each block, in a row without a chunk."""
    names = [x.split()[0] for x in ANSWERED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def answers(block: int, held: list) -> pa.RecordBatch:
        keys = np.concatenate([k for _, k, _ in held])
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        sums = np.add.reduceat(np.concatenate([x.astype(np.int64) for *_, x in held])[order], np.flatnonzero(new), axis=0)
        own = np.empty((len(keys), sums.shape[1]), np.int64)
        own[order] = sums[np.cumsum(new) - 1]
        cut = np.cumsum([0, *[len(k) for _, k, _ in held]])
        rows = [(block, s, *_packed(own[i:j]), None) for (s, *_), i, j in zip(held, cut[:-1], cut[1:], strict=True)]
        if total:
            rows.append((block, None, None, None, total(sums)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for block, s, keys, size, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if block != at:
                    if held:
                        yield answers(at, held)
                    at, held = block, []
                k = np.frombuffer(keys, np.uint64)
                held.append((s, k, np.frombuffer(n, _SIZES[size]).reshape(len(k), -1)))
        if held:
            yield answers(at, held)

    return run


def answered(rows: DataFrame, total=None) -> DataFrame:
    """ANSWERED: sums of what chunks asked (rows of ASKED)."""
    d = rows.repartition(core.parts(rows.sparkSession), "block").sortWithinPartitions("block")
    return d.mapInArrow(_answers(total), ANSWERED)


def sums(answers: pa.Table, columns: int) -> np.ndarray:
    """The answers to all keys that a chunk asked about, in their order: int64, a row a key."""
    rows = sorted(zip(*(answers[c].to_pylist() for c in ("block", "bytes", "n")), strict=True))
    found = [np.frombuffer(n, _SIZES[size]).astype(np.int64) for _, size, n in rows]
    return np.concatenate(found).reshape(-1, columns) if found else np.zeros((0, columns), np.int64)
