"""Shared helpers of the training-data operators: column picking, word rules, hashing, shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id inside an operator, so that it sorts last; rows are joined back null-safe.
NO_ID = (1 << 63) - 1


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, found by exact spelling: extra columns that differ in case only don't clash."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").alias(n) for n in names])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The array of words of a text, empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def tags(text: Column) -> list[Column]:
    """128 bits that, with the doc_id, tell rows apart: tag and tag2, two hashes of the text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("tag"), F.xxhash64(F.lit(1), t).alias("tag2")]


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master gets a temporary one; on a
    cluster executors would write to their own disks, so that is an error."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        said = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", said)
    return said


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: written once to the shared folder as Parquet and read again, so that lost executors cost no more
    than their own tasks and branches above share the work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like stash(), bucketed by a column: what is grouped by it next to this table moves to the table's rows, which stay. The
    catalog's entry goes at once; the files stay as those of stash() do."""
    spark, at = df.sparkSession, uuid.uuid4().hex
    table = f"tidemark_{name}_{at}"
    df.write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/tidemark/{at}/{name}").bucketBy(n, key).sortBy(key).saveAsTable(table)
    d = spark.table(table)
    d.schema  # noqa: B018  resolves the table
    spark.sql(f"DROP TABLE {table}")
    return d


def drop_stash(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what stash() wrote for df, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def guarded(limit: int):
    """Broadcast hint only behind a check: broadcast_if(df, rows) hints if rows is within the limit."""
    return lambda df, rows: F.broadcast(df) if rows <= limit else df


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once: within a lambda, an expression would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
