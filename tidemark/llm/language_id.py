"""Operator 9, language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language; a word's likelihood is the sum over all its
segmentations into pieces (forward algorithm), a text's the product over its words. The probabilities come from
expectation maximisation over all segmentations (forward and backward), never from a best one.

Fit: labelled rows of the folds to learn from; of each language some FIT_DOCS by a hash threshold, with all their words, so that the fit
is bounded by its rows. Prediction covers every word of every text: words are lower-cased, freed of
what isn't a letter, and scored whole, once a task and word, in numpy batches; long words by forward variables that are scaled at each step.

The vocabulary is the file `path` (VOCABULARY): a SentencePiece model of a public tokenizer, whose pieces alone are taken, not its scores.

Cases: a null text or one without letters is 'und' with score 0. A null doc_id is neither held out nor learned from. Without
labelled rows all is 'und'. Ties go to the first language by code point. Repeated rows, empty tables and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import core, text

#: Where the vocabulary is unless languages() is told: piece_bpe_32k.model (see README).
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
FIT_DOCS, ROUNDS = 400, 4
MAX_PIECE = 12
#: Characters up to which the plain forward variables can't underflow: UNKNOWN to this power is far above the least number.
PLAIN = 32
UNKNOWN, SMOOTH = 1e-8, 0.01
#: Words whose scores a task keeps; beyond, it starts anew.
CACHE = 400_000
SLOTS = 1 << 21


def pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces of letters of the vocabulary, in lower case and without repeats; '\\u2581' marks a word's begin."""
    import os

    import sentencepiece

    if not os.path.isfile(path):
        raise FileNotFoundError(f"language identification needs a SentencePiece vocabulary; there is none at {path}")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return sorted({p for p in found if 0 < len(p) <= MAX_PIECE and all(c.isalpha() or c == "▁" for c in p)})


class Lattice:
    """All pieces in words of one length at once: ids[b, i, l - 1] of the piece of l characters from i on, or -1."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        self.longest = max(map(len, vocabulary))
        self.base = 0xA24BAED4963EE407
        hashes = np.array([self._hash(p) for p in vocabulary], np.uint64)
        self.hashes = hashes
        self.first, self.second = np.full(SLOTS, -1, np.int32), np.full(SLOTS, -1, np.int32)
        for salt in range(100):  # until no three pieces share a slot
            self.salt = np.uint64(2 * salt + 1)
            slot = self._slot(hashes)
            _, n = np.unique(slot, return_counts=True)
            if n.max() <= 2:
                break
        for i, s in enumerate(slot):
            (self.first if self.first[s] < 0 else self.second)[s] = i

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.base + ord(c)) % (1 << 64)
        return h

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((text.mix(h * self.salt)) >> np.uint64(43)).astype(np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        n = len(words[0])
        c = np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        out = np.full((len(words), n, min(n, self.longest)), -1, np.int32)
        h = np.zeros_like(c)
        for k in range(out.shape[2]):
            h = h[:, : n - k] * np.uint64(self.base) + c[:, k:]
            s = self._slot(h)
            for table in (self.first, self.second):
                i = table[s]
                hit = (i >= 0) & (self.hashes[i] == h)
                out[:, : n - k, k][hit] = i[hit]
        return out


def _probabilities(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(words, i, l, languages); single characters that are no piece have the probability UNKNOWN."""
    x = np.where(ids[..., None] >= 0, p[ids], 0.0)
    x[:, :, 0][ids[:, :, 0] < 0] = UNKNOWN
    return x


def forward(x: np.ndarray) -> np.ndarray:
    """a[:, i]: the probability of the first i characters, summed over segmentations."""
    b, n, m, g = x.shape
    a = np.zeros((b, n + 1, g))
    a[:, 0] = 1
    for i in range(1, n + 1):
        for k in range(1, min(i, m) + 1):
            a[:, i] += a[:, i - k] * x[:, i - k, k - 1]
    return a


def backward(x: np.ndarray) -> np.ndarray:
    b, n, m, g = x.shape
    z = np.zeros((b, n + 1, g))
    z[:, n] = 1
    for i in range(n - 1, -1, -1):
        for k in range(1, min(n - i, m) + 1):
            z[:, i] += z[:, i + k] * x[:, i, k - 1]
    return z


def log_forward(x: np.ndarray) -> np.ndarray:
    """log a[:, i] of forward(), for any length: the last variables are kept in units of the newest one."""
    b, n, m, g = x.shape
    out, last = np.zeros((b, n + 1, g)), np.zeros((m, b, g))
    last[0] = 1
    for i in range(1, n + 1):
        new = sum(last[k - 1] * x[:, i - k, k - 1] for k in range(1, min(i, m) + 1))
        out[:, i] = out[:, i - 1] + np.log(new)
        last[1:] = last[:-1] / new
        last[0] = 1
    return out


def log_backward(x: np.ndarray) -> np.ndarray:
    """log z[:, i] of backward(): the forward variables of the reversed word."""
    b, n, m, g = x.shape
    turned = np.zeros_like(x)
    for k in range(m):
        turned[:, : n - k, k] = x[:, : n - k, k][:, ::-1]
    return log_forward(turned)[:, ::-1]


def _by_length(words: list[str]) -> Iterator[np.ndarray]:
    n = np.array([len(w) for w in words])
    order = np.argsort(n, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
        step = max(1, (1 << 16) // max(PLAIN, int(n[same[0]])) if len(same) else 1)
        for i in range(0, len(same), step):
            yield same[i : i + step]


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and p[piece, language], by expectation maximisation over the words' counts."""
    langs, lattice = sorted(counts), Lattice(vocabulary)
    words = sorted(set().union(*counts.values()))
    n = np.array([[counts[g].get(w, 0) for g in langs] for w in words], float).reshape(len(words), len(langs))
    p = np.full((lattice.n, len(langs)), 1 / lattice.n)
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for rows in _by_length(words):
            ids = lattice.ids([words[i] for i in rows])
            x = _probabilities(ids, p)
            long = ids.shape[1] > PLAIN
            a, z = (log_forward(x), log_backward(x)) if long else (forward(x), backward(x))
            for k in range(ids.shape[2]):
                m = ids.shape[1] - k
                i = ids[:, :m, k]
                ok = i >= 0
                if not ok.any():
                    continue
                w = np.nonzero(ok)[0]
                before, here, then, whole = a[:, :m][ok], x[:, :m, k][ok], z[:, k + 1 : k + 1 + m][ok], a[w, -1]
                e = here * (np.exp(before + then - whole) if long else before * then / whole) * n[rows][w]
                for g in range(len(langs)):
                    seen[:, g] += np.bincount(i[ok], e[:, g], lattice.n)
        p = (seen + SMOOTH) / (seen + SMOOTH).sum(axis=0)
    return langs, p


def normal(word: str) -> str:
    return "".join(filter(str.isalpha, word.lower()))


def word_scores(words: list[str], lattice: Lattice, p: np.ndarray) -> np.ndarray:
    """Log-likelihoods (words, languages) of normalised words; 0 for empty ones."""
    some = [i for i, w in enumerate(words) if w]
    whole = ["▁" + words[i] for i in some]
    out, own = np.zeros((len(words), p.shape[1])), np.array(some, np.int64)
    for rows in _by_length(whole) if whole else ():
        x = _probabilities(lattice.ids([whole[i] for i in rows]), p)
        out[own[rows]] = log_forward(x)[:, -1] if x.shape[1] > PLAIN else np.log(forward(x)[:, -1])
    return out


def _predict(model):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, langs, p = model.value
        lattice, known = Lattice(vocabulary), {}
        table, size = np.zeros((1 << 16, len(langs) + 1)), 0
        for b in batches:
            for i, j, data, off in text.portions(b.column(1)):
                starts, ends, first = text.words(data, off)
                h = text.word_hashes(data, starts, ends)
                u, at, inv = np.unique(h, return_index=True, return_inverse=True)
                keys = u.tolist()
                new = [k for k, x in enumerate(keys) if x not in known]
                if size + len(new) > CACHE:
                    known, size, new = {}, 0, list(range(len(keys)))
                if new:
                    ws = [normal(data[starts[at[k]] : ends[at[k]]].tobytes().decode()) for k in new]
                    while len(table) < size + len(new):
                        table = np.concatenate([table, np.zeros_like(table)])
                    table[size : size + len(new), :-1] = word_scores(ws, lattice, p)
                    table[size : size + len(new), -1] = [w != "" for w in ws]
                    known.update(zip([keys[k] for k in new], range(size, size + len(new)), strict=True))
                    size += len(new)
                s = table[np.array([known[k] for k in keys], np.int64)] if keys else np.zeros((0, len(langs) + 1))
                total = np.zeros((len(off) - 1, len(langs) + 1))
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                for g in range(len(langs) + 1):
                    total[:, g] = np.bincount(doc, s[inv, g], len(off) - 1)
                some = total[:, -1] > 0
                pred, score = [None] * len(some), np.zeros(len(some))
                if langs:
                    ll = total[:, :-1]
                    best = ll.argmax(axis=1)
                    score = np.where(some, 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                    pred = [langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                else:
                    pred = ["und"] * len(some)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score)], schema=schema)

    return run


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def word_counts(docs: DataFrame, fit_docs: int = FIT_DOCS) -> dict[str, dict[str, int]]:
    """Of each language: the normalised words of its rows in the bounded sample, with '\\u2581' before them."""
    d = core.pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    n = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for g, k in n.items() for x in (g, min(1.0, fit_docs / k))])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    w = d.where(u < F.get(F.array(share), F.lit(0))[F.col("lang")]).select("lang", F.explode(core.words(F.lower("text"))).alias("w"))
    found: dict[str, dict[str, int]] = {g: {} for g in n}
    for b in w.groupBy("lang", "w").agg(F.count("*").alias("n")).toArrow().to_batches():  # words of some fit_docs rows a language
        for g, word, k in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if x := normal(word):
                found[g]["▁" + x] = found[g].get("▁" + x, 0) + k
    return {g: c for g, c in found.items() if c}


def languages(docs: DataFrame, path: str = VOCABULARY, **kw) -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score (the posterior of lang_pred under equal priors)."""
    spark = docs.sparkSession
    counts, vocabulary = word_counts(docs, **kw), pieces(path)
    langs, p = fit(counts, vocabulary) if counts else ([], np.zeros((len(vocabulary), 0)))
    model = spark.sparkContext.broadcast((vocabulary, langs, p))  # pieces times languages
    d = core.pick(docs, "doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return d.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(core.read(spark, sf_dir, "documents"))
