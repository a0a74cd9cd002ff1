"""Operator 1, quality rules [native]: rules on the text itself, then a hashed n-gram log-likelihood ratio between the
multinomials of a trusted target and of the raw corpus, length-normalised, with a fixed threshold for every document.

Plan: two scans of the text and no shuffle of it. The first counts hashed n-grams (map-side combined to at most
`buckets` rows a task); the model that comes out has `buckets` integers whatever the corpus holds, and goes into the second scan as a
constant. All arithmetic on scores is on integers (milli-nats), so sums don't depend on their order.

Cases: a null or empty text has no words, fails the base rules and isn't kept. Null or repeated doc_ids: each row is
judged by its own text. A null label counts as not trusted. An empty table gives an empty result; without trusted rows
every ratio is 0 and the base rules alone decide. Extra columns of the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import core

BUCKETS = 16384
#: Trusted documents: labelled rows of the best quality that aren't toxic; at most so many, by least hash of the id.
MAX_TRUSTED = 20_000
#: Kept from this mean log-likelihood ratio on, in milli-nats per n-gram.
THRESHOLD = -300
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Tokens: runs of ASCII punctuation, or of anything else but white space.
MARKS = r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+)"


def tokens(text: Column) -> Column:
    return core.words(F.regexp_replace(text, MARKS, " $1 "))


def _pairs(tokens: Column, buckets: int) -> Column:
    ones = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
    twos = F.transform(
        F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda t, i: F.pmod(F.xxhash64(F.get(tokens, i), t), F.lit(buckets)).cast("int"),
    )
    return F.concat(ones, twos)


def model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log-likelihood ratio of each bucket in milli-nats: add-one smoothed target share over corpus share."""
    ids = F.broadcast(core.pick(trusted, "doc_id").where("doc_id is not null").distinct().withColumn("t", F.lit(1)))
    grams = core.pick(docs, "doc_id", "text").join(ids, "doc_id", "left").select("t", tokens(F.col("text")).alias("k"))
    grams = grams.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(_pairs(F.col("k"), buckets)).alias("b"))
    rows = grams.groupBy("b").agg(F.count("*").alias("n"), F.sum("t").alias("t")).collect()  # `buckets` rows at most
    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r.b], target[r.b] = r.n, r.t
    if not sum(target):
        return [0] * buckets
    shift = math.log(sum(raw) + buckets) - math.log(sum(target) + buckets)
    return [round(1000 * (math.log(t + 1) - math.log(n + 1) + shift)) for n, t in zip(raw, target, strict=True)]


def repeated_words(ws: Column) -> Column:
    """Words within 3-word windows that the text has twice or more. Sorts (window, position), takes what equals a
    neighbour, and adds up what each window covers beyond the one before: n log n, however often windows repeat."""
    wins = F.transform(F.slice(ws, F.lit(3), F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), w))

    def covered(wins: Column) -> Column:
        both = F.sort_array(F.transform(wins, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        same = lambda both: F.filter(both, lambda x, i: F.get(both, i - 1)["w"].eqNullSafe(x["w"]) | F.get(both, i + 1)["w"].eqNullSafe(x["w"]))
        at = F.sort_array(F.transform(core.let(both, same), lambda x: x["i"]))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda a: a["n"])

    some = F.size(ws) >= 4
    return F.when(some, core.let(wins, lambda w: F.when(F.size(w) > F.size(F.array_distinct(w)), covered(w)).otherwise(F.lit(0)))).otherwise(F.lit(0)).cast("long")


def base(text: Column) -> Column:
    """The rules on a text itself: a struct of the contract's figures. Arrays are bound once (core.let): the optimizer may
    move a column into a filter above or below, and would work out an array named in a lambda again for each element."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(text, SPACES, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dups = core.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    counts = core.let(core.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    failed = lambda c: (c["n"] < MIN_WORDS) | (100 * c["r"] > MAX_REPEAT_PERCENT * c["n"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return core.let(counts, lambda c: F.struct(*[x.alias(n) for n, x in zip(names, (c["n"], chars, symbols, dups, c["r"], failed(c)), strict=True)]))


def score(text: Column, weights: list[int]) -> Column:
    """Struct of n, the n-grams of a text, and total, the sum of their log-likelihood ratios in milli-nats."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one constant
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))
    of = lambda g: F.struct(F.size(g).cast("long").alias("n"), total(g).alias("total"))
    return core.let(tokens(F.coalesce(text, F.lit(""))), lambda k: core.let(_pairs(k, len(weights)), of))


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of trusted rows: of the best quality and not toxic."""
    good = core.pick(labels, "doc_id", "quality", "toxic").where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select("doc_id").distinct()


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Of these `most` at most, by least hash: the bounded target sample."""
    return trusted(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def quality(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS, most: int = MAX_TRUSTED) -> DataFrame:
    """A row for each document with its figures, llr (mean nats per n-gram, null without any) and verdict `kept`."""
    weights = model(docs, trusted_ids(labels, most), buckets)
    d = core.pick(docs, "doc_id", "text").select("doc_id", base(F.col("text")).alias("rules"), score(F.col("text"), weights).alias("s"))
    llr = F.col("s.total") / F.nullif(F.col("s.n"), F.lit(0).cast("long"))
    kept = ~F.col("rules.base_failed") & F.coalesce(llr >= threshold, F.lit(False))
    return d.select("doc_id", "rules.*", (llr / 1000).alias("llr"), kept.alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that pass, all columns as they were; the verdict is a filter within the scan, without a join."""
    weights = model(docs, trusted_ids(core.read(spark, sf_dir, "labels")))
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    text = F.col(f"c{own.index('text')}")
    sound = core.let(core.words(F.coalesce(text, F.lit(""))), lambda w: (F.size(w) >= MIN_WORDS) & (100 * repeated_words(w) <= MAX_REPEAT_PERCENT * F.size(w)))
    likely = core.let(score(text, weights), lambda s: (s["n"] > 0) & (s["total"] >= THRESHOLD * s["n"]))
    return plain.where(sound & likely).toDF(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "labels"))
