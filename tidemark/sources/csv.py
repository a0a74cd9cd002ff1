"""CSV dialects, header-keyed reading and writing (IO-01..IO-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dialects.
DIALECTS = {
    "rfc4180": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\r\n"},
    "excel": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\r\n"},
    "unix": {"sep": ",", "quote": '"', "escape": '"', "lineSep": "\n"},
    "unix_tab": {"sep": "\t", "quote": '"', "escape": '"', "lineSep": "\n"},
    "excel_tab": {"sep": "\t", "quote": '"', "escape": '"', "lineSep": "\r\n"},
    "pipe": {"sep": "|", "quote": '"', "escape": '"', "lineSep": "\n"},
}


def _options(dialect: str, multi_line: bool) -> dict:
    o = dict(DIALECTS[dialect])
    if multi_line:
        o.pop("lineSep")  # the parser finds line ends itself, so quoted fields may hold them
        o["multiLine"] = True
    return o


def read_csv(spark: SparkSession, path: str, dialect: str = "rfc4180", header: bool = True, comment: str | None = "#", schema: str | None = None, raw_quotes: bool = False, multi_line: bool = True) -> DataFrame:
    """IO-01, IO-02: all columns are strings by the header's names; a row of another width is an error. raw_quotes keeps
    quote characters in the fields (Q24); comment lines begin with the mark (Q25)."""
    o = _options(dialect, multi_line) | {"header": header, "mode": "FAILFAST", "inferSchema": False, "enforceSchema": False}
    if comment:
        o["comment"] = comment
    if raw_quotes:
        o |= {"quote": "", "escape": ""}
    r = spark.read.options(**o)
    return (r.schema(schema) if schema else r).csv(path)


def read_rows(spark: SparkSession, path: str, dialect: str = "rfc4180") -> DataFrame:
    """IO-04: each row as a map from header to field; a repeated name is an error or, by spark.sql.mapKeyDedupPolicy, the last wins."""
    d = read_csv(spark, path, dialect)
    return d.select(F.map_from_arrays(F.array(*map(F.lit, d.columns)), F.array(*[F.col(f"`{c}`") for c in d.columns])).alias("row"))


def tokens(line: Column, delimiters: str = ",;", quote: str = '"') -> Column:
    """IO-06: fields of a line split at any of several delimiters outside quotes."""
    inside = "[" + "".join("\\" + c for c in delimiters) + "]"
    return F.split(line, f"{inside}(?=(?:[^{quote}]*{quote}[^{quote}]*{quote})*[^{quote}]*$)")


def write_csv(df: DataFrame, path: str, dialect: str = "unix", header: bool = True) -> None:
    """IO-07: nulls are empty fields; fields with separators or quotes are quoted."""
    flat = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    flat.write.mode("overwrite").options(**DIALECTS[dialect], header=header, emptyValue="", quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
