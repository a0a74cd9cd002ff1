"""Operator 4, mixing sources to target weights by capped water-filling.

Sources are clamped at `max_epochs` times their size; the excess weight goes to the others in proportion until none is
above its cap. The fixpoint has a closed form: with sources by cap / weight, the level (total - caps before) / (weights
from here) rises while sources are clamped and falls afterwards, so its maximum is the water level.
Documents then get whole repetitions and, in a seeded order, a fractional one: the id's hash puts each document in one of
4096 bins, and bins are taken whole up to the target. In the bin in which it lies documents are taken whole in the order of
a key (the hashes of id and text) up to the target; the one document in which it lies gives its first words. Rows of one
key, which are equal rows, each give the same share.

Plan: one scan with a map-side combined sum per (source, bin), windows over a table of sources; one scan that counts the
words of the cut bins alone (1 / 4096 of the rows) into a table of keys, whose cut is found by 4096 bins again and only then by a
window over a source's keys, 1 / 16 777 216 of its rows; and one scan of the documents joined with the plan per source
(broadcast up to MAX_BROADCAST sources, shuffled beyond). No text is shuffled.

Cases: null or empty texts have size 0 and aren't in the mix. A null source is a source of its own, last. Repeated rows each count.
A null doc_id hashes as the text 'null'. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import core

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, 7
BIN_DIGITS = 3
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Rows of the plan per source up to which it is broadcast (some 60 bytes each).
MAX_BROADCAST = 200_000


def _order(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _bin(order: Column, level: int = 0) -> Column:
    return F.conv(F.substring(order, 1 + level * BIN_DIGITS, BIN_DIGITS), 16, 10).cast("int")


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.concat(_order(doc_id, seed), F.coalesce(F.md5(text), F.lit("")))


def _small(df: DataFrame) -> DataFrame:
    """A stashed table of sources, broadcast if there are few."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def _first_above(masses: DataFrame, by: str) -> DataFrame:
    """Of (source, by, mass, need): per source the first `by` at which the sum of masses exceeds the need, its mass, and what is needed of it."""
    up_to = F.sum("mass").over(Window.partitionBy("source").orderBy(by))
    x = masses.withColumn("cum", up_to).where("cum > need").groupBy("source").agg(F.min(F.struct(by, "mass", (F.col("need") - (F.col("cum") - F.col("mass"))).alias("need"))).alias("x"))
    return x.select(F.col("source").alias("_s"), F.col(f"x.{by}").alias("_cut"), F.col("x.mass").alias("_mass"), F.col("x.need").alias("_need"))


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Of (source, source_size): with weight and target. One row a source, so that a window over all of them is small."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("long")
    t = sizes.withColumn("weight", w).withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by), F.lit(0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return t.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def plan(docs: DataFrame, seed: int = SEED, **kw) -> DataFrame:
    """Per source: target, whole repetitions, the bin and, in it, the key up to which documents get one more, and the share of that key."""
    d = core.pick(docs, "doc_id", "source", "text")
    bins = d.select("source", _bin(_order(F.col("doc_id"), seed)).alias("bin"), core.n_words(F.col("text")).alias("size")).groupBy("source", "bin").agg(F.sum("size").alias("mass"))
    bins = core.stash(bins, "mix_bins")
    t = targets(bins.groupBy("source").agg(F.sum("mass").alias("source_size")), **kw)
    t = t.withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long"))
    t = core.stash(t.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix_targets")
    need = t.select(F.col("source").alias("_t"), "need")
    cut = core.stash(_first_above(bins.join(_small(need), bins["source"].eqNullSafe(need["_t"])), "bin"), "mix_cuts")

    inside = d.join(_small(cut), (d["source"].eqNullSafe(cut["_s"])) & (_bin(_order(d["doc_id"], seed)) == cut["_cut"]))
    keys = inside.select("source", _key(F.col("doc_id"), F.col("text"), seed).alias("key"), core.n_words(F.col("text")).alias("size"), F.col("_need").alias("need"))
    keys = core.stash(keys.groupBy("source", "key", "need").agg(F.sum("size").alias("mass")), "mix_keys")
    finer = keys.groupBy("source", "need", _bin(F.col("key"), 1).alias("fine")).agg(F.sum("mass").alias("mass"))
    fine = _first_above(finer, "fine")
    k = keys.join(fine, keys["source"].eqNullSafe(fine["_s"]) & (_bin(keys["key"], 1) == fine["_cut"]))
    last = _first_above(k.select("source", "key", "mass", F.col("_need").alias("need")), "key")
    last = last.select(F.col("_s").alias("_k"), F.col("_cut").alias("key"), (F.col("_need") / F.col("_mass")).alias("share"))
    found = t.join(cut, t["source"].eqNullSafe(cut["_s"]), "left").join(last, t["source"].eqNullSafe(last["_k"]), "left")
    return found.select("source", "source_size", "target", "whole", F.coalesce("_cut", F.lit(0)).alias("cut"), F.coalesce("key", F.lit("")).alias("key"), F.coalesce("share", F.lit(0.0)).alias("share"))


def mixed(docs: DataFrame, seed: int = SEED, **kw) -> DataFrame:
    """docs with one struct column `mix`: size, source_size, target, copies (whole) and part (words of a last copy)."""
    p = plan(docs, seed, **kw).select(F.col("source").alias("_s"), F.struct("source_size", "target", "whole", "cut", "key", "share").alias("_p"))
    p = _small(core.stash(p, "mix_plan"))
    d = docs.join(p, docs["source"].eqNullSafe(p["_s"]), "left").withColumn("_size", core.n_words(docs["text"])).withColumn("_bin", _bin(_order(docs["doc_id"], seed)))
    at = F.when(F.col("_bin") == F.col("_p.cut"), _key(docs["doc_id"], docs["text"], seed))
    more = F.when(F.col("_bin") < F.col("_p.cut"), 1).when(at < F.col("_p.key"), 1).otherwise(0)
    part = F.when(at == F.col("_p.key"), F.floor(F.col("_size") * F.col("_p.share"))).otherwise(F.lit(0)).cast("long")
    mix = F.struct(F.col("_size").alias("size"), F.col("_p.source_size").alias("source_size"), F.col("_p.target").alias("target"), (F.col("_p.whole") + more).alias("copies"), part.alias("part"))
    return d.withColumn("mix", mix).drop("_s", "_p", "_size", "_bin")


def mixing(docs: DataFrame, **kw) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words that the mix takes from it."""
    d = mixed(core.pick(docs, "doc_id", "source", "text"), **kw)
    m = F.col("mix")
    return d.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"] + m["part"]).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each copy that is taken, all columns as they were, with copy (from 1) and taken (its
    words); the text of a source's one copy that is taken in part ends after these words, its white space kept."""
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    of = {n: F.col(f"c{own.index(n)}") for n in ("doc_id", "source", "text")}
    d = mixed(plain.withColumns(of))
    n = F.col("mix.copies") + F.when(F.col("mix.part") > 0, F.lit(1)).otherwise(F.lit(0))
    d = d.where((n > 0) & (F.col("mix.size") > 0)).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    cut = F.col("_copy") > F.col("mix.copies")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(of["text"], F.lit(SPACED_WORD), F.lit(0)), F.lit(1), F.col("mix.part").cast("int")), "")).otherwise(of["text"])
    taken = F.when(cut, F.col("mix.part")).otherwise(F.col("mix.size"))
    cols = [(text if c == "text" else F.col(f"c{i}")).alias(f"c{i}") for i, c in enumerate(own)]
    extra = [core.fresh(docs, "copy"), core.fresh(docs, "taken")]
    return d.select(*cols, F.col("_copy"), taken.alias("_taken")).toDF(*own, *extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(core.read(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH e AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 3))::INTEGER AS bin,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) || coalesce(md5(text), '') AS key
  FROM documents),
d AS (SELECT source, size, bin FROM e),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(size) FROM d)::BIGINT
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
w AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
b AS (SELECT source, bin, sum(size)::BIGINT AS mass FROM d GROUP BY source, bin),
c AS (SELECT b.source, bin, mass, target - whole * source_size AS need, (sum(mass) OVER (PARTITION BY b.source ORDER BY bin))::BIGINT AS cum
      FROM b JOIN w ON b.source IS NOT DISTINCT FROM w.source),
x AS (SELECT source, min(bin) AS cut, arg_min(need - (cum - mass), bin) AS need FROM c WHERE cum > need GROUP BY source),
k AS (SELECT d.source, key, x.need, sum(d.size)::BIGINT AS mass FROM e d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.bin = x.cut GROUP BY d.source, key, x.need),
q AS (SELECT *, (sum(mass) OVER (PARTITION BY source ORDER BY key))::BIGINT AS cum FROM k),
y AS (SELECT source, min(key) AS key, arg_min((need - (cum - mass)) / mass, key) AS share FROM q WHERE cum > need GROUP BY source)
SELECT d.doc_id, d.size, w.source_size, w.target,
       (d.size * (w.whole + CASE WHEN d.bin < coalesce(x.cut, 0) OR d.bin = x.cut AND d.key < y.key THEN 1 ELSE 0 END)
        + CASE WHEN d.bin = x.cut AND d.key = y.key THEN floor(d.size * y.share) ELSE 0 END)::BIGINT AS taken
FROM e d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source LEFT JOIN y ON y.source IS NOT DISTINCT FROM d.source
"""
