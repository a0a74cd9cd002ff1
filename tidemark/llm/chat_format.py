"""Operator 8, chat formatting by a grammar round trip.

A turn is rendered as '### ROLE: TEXT </turn>\\n'. A deterministic parser reads turns back; where what it recovers differs
from the source, the text is escaped further, until they are identical: first not at all, then backslashes that would read as escapes,
then also control strings, at last every special character, which the parser always undoes.
The grammar: a turn opens with '### ' and its role up to the first unescaped ': ', and ends at the first unescaped
' </turn>\\n'; a backslash before one of '\\\\#<:' gives that character.

Turns are rendered, reparsed and digested one by one in a stream sorted by conversation and turn: a task holds one turn
and two running digests, however long a conversation is.

Cases: null texts and roles are empty. A null conv_id is one conversation; null turns come first. Rows that repeat a turn all
stay, in the order of role and text. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import core

OPEN, CLOSE, COLON = "### ", " </turn>\n", ": "
ESCAPED = re.compile(r"\\([\\#<:])")
#: What is escaped at each level; the text between is left alone.
LEVELS = (None, re.compile(r"\\(?=[\\#<:])|\\$"), re.compile(r"\\|#(?=##)|<(?=/turn>)"), re.compile(r"[\\#<:]"))
LOSS_ROLES = ("assistant",)


def escape(text: str, level: int) -> str:
    return text if LEVELS[level] is None else LEVELS[level].sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _find(s: str, what: str, at: int) -> int:
    """Where `what` stands unescaped from `at` on; -1 if nowhere. A character is escaped after an odd run of backslashes."""
    while (i := s.find(what, at)) >= 0:
        k = i
        while k > at and s[k - 1] == "\\":
            k -= 1
        if (i - k) % 2 == 0 or what[0] == " ":
            return i
        at = i + 1
    return -1


def parse(s: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the escaped text within s) of all turns; ValueError if s isn't of the grammar."""
    turns, at = [], 0
    while at < len(s):
        if not s.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        colon = _find(s, COLON, at + len(OPEN))
        end = _find(s, CLOSE, colon + len(COLON)) if colon >= 0 else -1
        if end < 0:
            raise ValueError(f"the turn at {at} has no end")
        turns.append((unescape(s[at + len(OPEN) : colon]), unescape(s[colon + len(COLON) : end]), colon + len(COLON), end))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as little as the round trip allows. A guard before and after shows texts that would swallow or
    split their neighbours."""
    guard = OPEN + "x" + COLON + "y" + CLOSE
    for level in range(len(LEVELS)):
        s = OPEN + escape(role, 3 if level else 0) + COLON + escape(text, level) + CLOSE
        try:
            got = parse(guard + s + guard)
        except ValueError:
            continue
        if [x[:2] for x in got] == [("x", "y"), (role, text), ("x", "y")]:
            return s
    raise ValueError("no escaping makes the round trip")


@F.pandas_udf(T.StringType())
def rendered(role: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([render(r or "", t or "") for r, t in zip(role, text, strict=True)], dtype=object)


def formatted(conversations: DataFrame) -> DataFrame:
    """The operator's output, a row for each turn: conv_id, turn, role, text, formatted, and loss_begin, loss_end (code points
    within formatted that are trained on; both 0 for other roles)."""
    d = core.pick(conversations, "conv_id", "turn", "role", "text").withColumn("formatted", rendered("role", "text"))
    role = F.coalesce("role", F.lit(""))
    end = F.length("formatted") - len(CLOSE)
    begin = F.locate(COLON, F.col("formatted")) - 1 + len(COLON)  # roles that are trained on hold no colon
    loss = role.isin(*LOSS_ROLES)
    return d.select("conv_id", "turn", "role", "text", "formatted", F.when(loss, begin).otherwise(0).alias("loss_begin"), F.when(loss, end).otherwise(0).alias("loss_end"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over formatted turns sorted by conversation: what is read back of each conversation."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    at, open_ = None, False
    for p in batches:
        out = []
        for conv, s, lo, hi in zip(p["conv_id"].tolist(), p["formatted"], p["loss_begin"], p["loss_end"], strict=True):
            conv = None if conv is None or conv != conv else int(conv)
            if not open_ or conv != at:
                if open_:
                    out.append((at, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
                at, open_ = conv, True
                n, loss_n, chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text, *_ in parse(s):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1
            trained = unescape(s[lo:hi])
            loss.update(trained.encode())
            loss_n += len(trained)
            chars += len(s)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if open_:
        yield pd.DataFrame([(at, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)], columns=names).astype({"conv_id": "Int64"})


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns: n_turns, digests of turns and of what is trained on, lengths."""
    d = turns.repartition(core.parts(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", F.coalesce("text", F.lit("")))
    return d.select("conv_id", "formatted", "loss_begin", "loss_end").mapInPandas(_digest, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    d = core.pick(core.read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return digests(formatted(d.unionByName(own)))


ORACLE_SQL = None  # formatted_chars depends on the escaping; see tests for the rest against SQL
