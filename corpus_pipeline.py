"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import core
from tidemark.llm.decontamination import decontamination_stage
from tidemark.llm.line_dedup import line_stage
from tidemark.llm.mixing import mixing_stage
from tidemark.llm.near_dedup import near_stage
from tidemark.llm.quality_rules import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
#: Registers, hashed scores and slots aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = core.stash(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
