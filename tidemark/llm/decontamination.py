"""Operator 2, benchmark decontamination by template canonicalisation [native].

Numbers, units and names become typed placeholders; windows of WINDOW template words are hash-joined between benchmark and
documents. There are two templates of each text: in the strict one capitalised words that begin a sentence stay as they are, in the loose
one they are names as well ("Janet picks 16 eggs. Janet eats 3."). Matches of (document, item) are aligned by their diagonal,
document position less item position, and by bands of DRIFT diagonals, which hold copies with a few words more or less. An alignment counts if
the item's words under its windows reach MIN_COVER of the item, or MIN_RUN words in a row on one diagonal, and if its slots are
consistent: one value of the item always stands for one value of the document, so that "3 apples ... 3 pears" matches "5 apples ... 5
pears" but not "5 apples ... 6 pears". Matches of the strict template alone, and of both, are judged each for itself: either suffices.
Words of benchmark and document correspond one to one with their template words: placeholders replace parts of words only.

Plan: the benchmark's windows are broadcast up to MAX_BROADCAST rows and shuffled beyond; the documents' windows go
through the join where they are made, and only matches are grouped. Texts of matched documents alone are joined back for
the slots; what is broadcast there is checked by rows and bytes. DataFrame functions only.

Cases: null or empty texts of documents aren't contaminated, those of the benchmark match nothing. Items of fewer words than a
window are matched as a whole if they have MIN_WORDS words that aren't placeholders. Null doc_ids count as one document; rows that repeat a doc_id
are told apart by 128 bits of the text. Repeated items each count under their id. Empty tables give empty or clean results. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import core

WINDOW, MIN_COVER, MIN_LITERAL, MIN_CONSISTENT = 8, 0.5, 0.5, 1.0
#: Words in a row that count whatever their share of the item, diagonals of a band, and the literal words a short item needs.
MIN_RUN, DRIFT, MIN_WORDS = 40, 16, 2
#: Rows and bytes up to which tables are broadcast.
MAX_BROADCAST, MAX_BYTES = 500_000, 64_000_000
ROW = ["did", "tag", "tag2"]
#: Unit words.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|mph|kmh|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|inches|feet|grams?|litres?|liters?|dollars?|euros?|pounds?|cents?|percent|%"
NUMBER = r"(?<![\p{L}\p{N}])[+-]?[$€£]?[0-9]+(?:[.,:/][0-9]+)*"
NAME = r"(?<=[^.!?:\s\x00][\x20\x09-\x0D])[\"'(]?\p{Lu}[\p{Ll}'’-]+"
EDGE = r"(?<=[\p{L}\p{N}\x01-\x03])[,.;:!?\"')\]]+(?=[\x20\x09-\x0D]|$)"
NUM, UNIT, NAMED, FIRST = "\x01", "\x02", "\x03", "\x04"
#: Capitalised words that NAME leaves: those that begin a sentence.
BEGIN = r"(?<![\p{L}\p{N}'’\x01-\x04-])[\"'(]?\p{Lu}[\p{Ll}'’-]+"


def template(text: Column) -> Column:
    """Template words of a text, one for each of its words, with placeholders as control characters; words that begin a sentence with a capital
    have the mark FIRST before them. Such characters of the text itself go first."""
    t = F.regexp_replace(text, r"[\x01-\x04]", "?")
    t = F.regexp_replace(t, NAME, NAMED)
    t = F.regexp_replace(t, BEGIN, FIRST + "$0")
    t = F.regexp_replace(t, NUMBER, NUM)
    t = F.regexp_replace(t, rf"(\x01[\x20\x09-\x0D]*)(?:{UNITS})(?![\p{{L}}\p{{N}}])", "$1" + UNIT)
    return core.words(F.lower(F.regexp_replace(t, EDGE, "")))


def strict(word: Column) -> Column:
    return F.ltrim(word, F.lit(FIRST))


def loose(word: Column) -> Column:
    return F.when(word.startswith(FIRST), F.lit(NAMED)).otherwise(word)


def windows(words: Column, k: int) -> Column:
    """Structs (v, pos, h) of all windows of k words: hashes of the strict template (v = 1), and of the loose one (v = 2) where they differ."""
    hashes = lambda of: F.transform(words, lambda w: F.xxhash64(of(w)))

    def joined(h: Column) -> Column:
        starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))

    one = lambda v: lambda h, i: F.struct(F.lit(v).alias("v"), i.alias("pos"), h.alias("h"))
    both = lambda a, b: F.concat(F.transform(a, one(1)), F.filter(F.transform(b, one(2)), lambda x: x["h"] != F.get(a, x["pos"])))
    return core.let(core.let(hashes(strict), joined), lambda a: core.let(core.let(hashes(loose), joined), lambda b: both(a, b)))


def _literal(w: Column, marks: str) -> Column:
    return F.filter(w, lambda x: ~x.rlike(f"[{marks}]"))


def item_windows(items: DataFrame) -> DataFrame:
    """(h, k, item, ipos) of items (item, w): hashes of all windows that have enough literal words."""
    found = None
    for k in range(1, WINDOW + 1):
        own = items.where(F.least(F.lit(WINDOW), F.size("w")) == k)
        own = own.select("item", "w", F.explode(windows(F.col("w"), k)).alias("x")).withColumn("g", F.slice("w", F.col("x.pos") + 1, F.lit(k)))
        n = F.when(F.col("x.v") == 1, F.size(_literal(F.col("g"), r"\x01-\x03"))).otherwise(F.size(_literal(F.col("g"), r"\x01-\x04")))
        own = own.where((n >= MIN_LITERAL * k) & (n >= min(k, MIN_WORDS))) if k >= MIN_WORDS else own.limit(0)
        own = own.select(F.col("x.h").alias("h"), F.lit(k).alias("k"), "item", F.col("x.pos").alias("ipos"))
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def _marked(docs: DataFrame) -> DataFrame:
    return core.pick(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(core.NO_ID)).alias("did"), *core.tags(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df with a broadcast hint if its rows, and their bytes by `size`, are within the limits."""
    n = df.limit(MAX_BROADCAST + 1).agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if n.n <= MAX_BROADCAST and (n.b or 0) <= MAX_BYTES else df


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(did, tag, tag2, item, loose, band, at, covered, run): alignments that cover enough, at: the matched windows (ipos, pos)."""
    own = core.pick(benchmark, "item_id", "text").where("text is not null").select(F.col("item_id").alias("item"), template(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = core.stash(own, "items")
    items = core.stash(item_windows(own), "item_windows")
    n = items.limit(MAX_BROADCAST + 1).count()
    ks = [r.k for r in items.select("k").distinct().collect()]  # at most WINDOW values
    w = _marked(docs).select(*ROW, template(F.col("text")).alias("w"))
    hits = None
    for k in sorted(ks):
        x = w.select(*ROW, F.explode(windows(F.col("w"), k)).alias("x")).select(*ROW, "x.v", "x.pos", "x.h")
        mine = items.where(f"k = {k}")
        m = x.join(F.broadcast(mine) if n <= MAX_BROADCAST else mine, "h").select(*ROW, "v", "k", "item", "pos", "ipos")
        hits = m if hits is None else hits.unionByName(m)
    if hits is None:
        return w.select(*ROW, *[F.lit(None).cast(t).alias(c) for c, t in (("item", "long"), ("loose", "boolean"), ("at", "array<struct<ipos:int,pos:int>>"), ("k", "int"))]).limit(0)
    shift = F.col("pos") - F.col("ipos")
    band = lambda mode, x: F.struct(F.lit(mode).alias("mode"), x.cast("int").alias("n"))
    bands = F.explode(F.array(band(0, shift), band(1, F.floor(shift / DRIFT)), band(2, F.floor((shift + DRIFT // 2) / DRIFT)))).alias("band")
    views = F.explode(F.when(F.col("v") == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("loose")
    each = hits.select("*", views).select(*ROW, "item", "k", "loose", "ipos", "pos", bands)
    lines = each.groupBy(*ROW, "item", "loose", "band").agg(F.sort_array(F.collect_set(F.struct("ipos", "pos"))).alias("at"), F.max("k").alias("k"))

    def step(a: Column, p: Column, k: Column) -> Column:
        more = F.least(k, p - a["last"])
        run = F.when(p - a["last"] <= k, a["run"] + more).otherwise(k)
        return F.struct((a["n"] + more).alias("n"), run.alias("run"), F.greatest(a["best"], run).alias("best"), p.alias("last"))

    begin = F.struct(*[F.lit(0).alias(c) for c in ("n", "run", "best")], F.lit(-100).alias("last"))
    cover = F.aggregate("at", begin, lambda a, p: step(a, p["ipos"], F.col("k")))
    sized = own.select("item", F.size("w").alias("size"))
    lines = lines.withColumn("c", cover).join(_small(sized, F.lit(16)), "item")
    enough = (F.col("c.n") >= MIN_COVER * F.col("size")) | ((F.col("band.mode") == 0) & (F.col("c.best") >= MIN_RUN))
    return core.stash(lines.where(enough).select(*ROW, "item", "loose", "at", "k"), "alignments")


def consistency() -> Column:
    """Share of the item's distinct slot values (iw, ir: its template words and words) that stand for one value of the document (dr); 1 without slots."""
    inside = F.array_distinct(F.flatten(F.transform("at", lambda p: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct((p["ipos"] + j).alias("i"), (p["pos"] + j).alias("d"))))))
    marks = F.when(F.col("loose"), F.lit(r"[\x01-\x04]")).otherwise(F.lit(r"[\x01-\x03]"))
    slots = F.filter(inside, lambda p: F.regexp_like(F.get("iw", p["i"]), marks))
    bare = lambda x: F.regexp_replace(F.lower(x), EDGE, "")
    pairs = F.array_distinct(F.transform(slots, lambda p: F.struct(bare(F.get("ir", p["i"])).alias("i"), bare(F.get("dr", p["d"])).alias("d"))))
    one = lambda pairs: F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(F.array_distinct(F.transform(pairs, lambda x: x["i"]))) / F.size(pairs))
    return core.let(pairs, one)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(did, tag, tag2, items): documents that hold benchmark items, with the sorted ids of these."""
    a = alignments(docs, benchmark)
    items = core.pick(benchmark, "item_id", "text").select(F.col("item_id").alias("item"), template(F.col("text")).alias("iw"), core.words(F.col("text")).alias("ir"), F.octet_length("text").alias("bytes"))
    items = items.join(a.select("item").distinct(), "item", "left_semi")
    texts = _marked(docs).join(_small(a.select(*ROW).distinct(), F.lit(24)), ROW, "left_semi").select(*ROW, core.words(F.col("text")).alias("dr"))
    both = texts.join(_small(a, F.size("at") * 8 + 48), ROW).join(_small(items, F.col("bytes") * 4), "item")
    both = both.where(consistency() >= MIN_CONSISTENT)
    return both.groupBy(*ROW).agg(F.sort_array(F.collect_set("item")).alias("items"))


def _joined(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    f = core.stash(found, "contaminated").withColumnsRenamed({c: f"_{c}" for c in ROW})
    f = _small(f, F.size("items") * 8 + 40)
    own = [F.coalesce(docs["doc_id"], F.lit(core.NO_ID)), *core.tags(docs["text"])]
    return docs.join(f, [x == f[f"_{c}"] for c, x in zip(ROW, own, strict=True)], how)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_items, items (ids of the benchmark items it holds), kept."""
    d = core.pick(docs, "doc_id", "text")
    d = _joined(d, contaminated(d, benchmark), "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    return d.select("doc_id", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.size(items) == 0).alias("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs that hold no benchmark item; all columns as they were."""
    own = docs.columns
    i, j = own.index("doc_id"), own.index("text")
    plain = docs.toDF(*["doc_id" if k == i else "text" if k == j else f"c{k}" for k in range(len(own))])
    found = contaminated(plain, core.read(spark, sf_dir, "benchmark"))
    return _joined(plain, found, "left_anti").toDF(*own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(core.read(spark, sf_dir, "documents"), core.read(spark, sf_dir, "benchmark"))
