"""Operator 6, cross-entropy difference of two matched n-gram models.

Target model: all trusted documents. Background model: the whole corpus. Both share one vocabulary, the words that the target has
MIN_COUNT times or more; all other words are one, the unknown word. With c the counts, N the tokens, V the vocabulary's size, and c(v .)
the times that v has a word after it:
  P(w) = (c(w) + 1) / (N + V + 1), P(w | v) = (c(v w) + KAPPA P(w)) / (c(v .) + KAPPA).
Both are proper distributions over the vocabulary and the unknown word, for each v, the unknown word included. The first word of a text
scores by P(w). A document is scored by what the rest of the corpus holds: its own counts are taken from the background's and, if it is
trusted, from the target's. Its score is the mean over its tokens of target loss less background loss; the lower, the closer it is to the
target. Losses are whole micro-nats, so that sums don't depend on their order.

Plan (chunks.py): texts are written once in chunks. Each chunk sends its distinct words with their counts to blocks of the hash space, which
add them up and answer each chunk's own words; then its distinct bigrams likewise; then it scores its documents with the answers. No model is held
or broadcast as a whole, at any size: a task holds a chunk or a block, and a frequent n-gram is sent once a chunk.

Cases: null and empty texts have no tokens and a null score. Without trusted documents all words are unknown and scores are 0.
Rows that repeat a doc_id are rows of their own; all rows of a trusted id are trusted, null ids aren't. Empty tables give empty
results. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chunks, core, text
from tidemark.llm.quality_rules import trusted

MIN_COUNT, KAPPA = 2, 8.0
#: Trusted ids (8 bytes) up to which they are broadcast; beyond, documents are shuffled to them.
MAX_BROADCAST = 500_000
#: Stands for the hash of all words outside the vocabulary.
UNKNOWN = np.uint64(0x9B1D5F0A7C3E2468)


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, of each word its row from there, whether one of its text is before it, its hash), in portions."""
    for i, j, data, off in text.portions(texts):
        starts, ends, first = text.words(data, off)
        row = np.repeat(np.arange(j - i), np.diff(first))
        after = np.zeros(len(row), bool)
        after[1:] = row[1:] == row[:-1]
        yield i, j - i, row, after, text.word_hashes(data, starts, ends)


def _pair(v: np.ndarray, u: np.ndarray) -> np.ndarray:
    return text.mix((v ^ (v >> np.uint64(29))) * np.uint64(0xA24BAED4963EE407) + u)


def _counted(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of them are true in each of the masks."""
    keys = np.concatenate([k for k, _ in held])
    masks = [np.concatenate(m) for m in zip(*[m for _, m in held], strict=True)]
    order = np.argsort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    return keys[order][at], np.stack([np.add.reduceat(m[order].astype(np.int64), at) for m in masks], 1)


def _words(blocks: int):
    """Of a chunk: its words with ct, cb (occurrences in target and corpus) and xt, xb (those with a word after them)."""

    def run(key: tuple, chunk: pa.Table) -> pa.Table:
        own, held = chunk["own"].to_numpy(), []
        for i, _, row, after, h in _tokens(chunk["text"].combine_chunks()):
            told, context = own[row + i], np.append(after[1:], False)
            held.append((h, [told, np.ones(len(h), bool), told & context, context]))
        keys, n = _counted(held) if any(len(k) for k, _ in held) else (np.zeros(0, np.uint64), np.zeros((0, 4), np.int64))
        return chunks.asked(key[0].as_py(), keys, n, blocks)

    return run


def _totals(n: np.ndarray) -> list[int]:
    """Of a block's words: those in the vocabulary, their four counts, and the counts of all."""
    listed = n[n[:, 0] >= MIN_COUNT]
    return [len(listed), *listed.sum(axis=0).tolist(), *n.sum(axis=0).tolist()]


class Chunk:
    """A chunk's words and their answers: tokens as hashes in which all unknown words are one."""

    def __init__(self, table: pa.Table, answers: pa.Table):
        self.texts = table["text"].combine_chunks()
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for *_, h in _tokens(self.texts)]]))
        self.n = chunks.sums(answers, 4)
        self.known = self.n[:, 0] >= MIN_COUNT

    def tokens(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """As _tokens, with each token's place among the words (-1 for unknown ones)."""
        for i, rows, row, after, h in _tokens(self.texts):
            at = np.searchsorted(self.words, h)
            known = self.known[at]
            yield i, rows, row, after, np.where(known, h, UNKNOWN), np.where(known, at, -1)


def _pairs(blocks: int):
    """Of a chunk: its bigrams with their counts in target and corpus."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        own, held = table["own"].to_numpy(), []
        for i, _, row, after, h, _ in Chunk(table, answers).tokens():
            k = np.flatnonzero(after)
            held.append((_pair(h[k - 1], h[k]), [own[row[k] + i], np.ones(len(k), bool)]))
        keys, n = _counted(held) if any(len(k) for k, _ in held) else (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
        return chunks.asked(key[0].as_py(), keys, n, blocks)

    return run


def _own(row: np.ndarray, x: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
    """For each token how many tokens of its row have the same x (only those where count is true), by 64-bit hashes of both."""
    if not len(x):
        return np.zeros(0, np.int64)
    key = text.mix(x.astype(np.int64).view(np.uint64) if x.dtype != np.uint64 else x) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    n = np.add.reduceat(np.ones(len(x), np.int64) if count is None else count[order].astype(np.int64), np.flatnonzero(new))
    out = np.empty(len(x), np.int64)
    out[order] = n[np.cumsum(new) - 1]
    return out


def probabilities(c: np.ndarray, n: np.ndarray, size: int, c2: np.ndarray, x: np.ndarray, after: np.ndarray) -> np.ndarray:
    """P of tokens from the counts of the word, of all tokens, of the bigram and of the word before as context, own ones taken off."""
    p = (c + 1) / (n + size + 1)
    return np.where(after, (c2 + KAPPA * p) / (x + KAPPA), p)


SCORED = "doc_id long, n_tokens long, n_listed long, score double"


def _scored(total: list[int]):
    """Of a chunk's documents, from the answers to its words (kind 1) and bigrams (kind 2): tokens, those in the vocabulary, score."""
    size, listed, every = total[0], total[1:5], total[5:]
    rest = [a - b for a, b in zip(every, listed, strict=True)]  # of the unknown word

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:  # noqa: ARG001
        kind = answers["kind"].to_numpy()
        chunk, pairs = Chunk(table, answers.filter(pa.array(kind == 1))), chunks.sums(answers.filter(pa.array(kind == 2)), 2)
        own, m = table["own"].to_numpy(), table.num_rows
        n, known, loss = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
        counts = np.concatenate([chunk.n, [rest]])  # -1, the unknown word, is the last
        parts, keys = list(chunk.tokens()), np.zeros(0, np.uint64)
        pair = [_pair(h[np.flatnonzero(after) - 1], h[after]) for *_, after, h, _ in parts]
        keys = np.unique(np.concatenate([keys, *pair]))
        for (i, rows, row, after, h, at), p in zip(parts, pair, strict=True):
            if not len(h):
                continue
            size_of = np.bincount(row, minlength=rows)
            before, k = np.roll(at, 1), np.flatnonzero(after)
            two = np.zeros((len(h), 2), np.int64)
            two[k] = pairs[np.searchsorted(keys, p)]
            mine2 = np.zeros(len(h), np.int64)
            mine2[k] = _own(row[k], p)
            mine1, context = _own(row, at), np.append(after[1:], False)
            minex = np.roll(_own(row, at, context), 1)
            each = []
            for model, off in ((0, own[row + i].astype(np.int64)), (1, 1)):
                c, x = counts[at, model] - off * mine1, counts[before, 2 + model] - off * minex
                each.append(np.log(probabilities(c, every[model] - off * size_of[row], size, two[:, model] - off * mine2, x, after)))
            micro = np.rint(1e6 * (each[1] - each[0])).astype(np.int64)
            n[i : i + rows] = size_of
            known[i : i + rows] = np.bincount(row, at >= 0, rows).astype(np.int64)
            np.add.at(loss, row + i, micro)
        score = np.where(n > 0, loss / np.maximum(n, 1) / 1e6, np.nan)
        return pa.table({"doc_id": table["doc_id"], "n_tokens": n, "n_listed": known, "score": pa.array(score, from_pandas=True)})

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_tokens, n_listed (tokens in the vocabulary), score (nats per token, null without tokens)."""
    ids = trusted(labels).withColumn("own", F.lit(True))
    ids = F.broadcast(ids) if ids.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else ids
    d = core.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    table = chunks.chunked(d.join(ids, "doc_id", "left").select("doc_id", F.coalesce("own", F.lit(False)).alias("own"), "text"))
    blocks = chunks.blocks(table)
    words = core.stash(chunks.answered(table.groupBy("s").applyInArrow(_words(blocks), chunks.ASKED), _totals), "word_counts")
    total = words.agg(*[F.coalesce(F.sum(F.get("total", F.lit(i))), F.lit(0).cast("long")) for i in range(9)]).first()
    words = words.where("s is not null").drop("total").withColumn("kind", F.lit(1))
    told = words.groupBy("s")
    pairs = chunks.answered(table.groupBy("s").cogroup(told).applyInArrow(_pairs(blocks), chunks.ASKED)).drop("total").withColumn("kind", F.lit(2))
    return table.groupBy("s").cogroup(words.unionByName(pairs).groupBy("s")).applyInArrow(_scored(list(total)), SCORED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "labels"))
