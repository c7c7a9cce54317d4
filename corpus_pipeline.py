"""The corpus pipeline: stages that each read what the one before wrote, from documents to a mix of sources.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rulewright.llm.common import discard, stored
from rulewright.llm.decontaminate import drop_contaminated
from rulewright.llm.jaccard_join import near_duplicates
from rulewright.llm.language_id import drop_unidentified
from rulewright.llm.line_templates import drop_long_lines, drop_repeated_lines
from rulewright.llm.mixing import mixed


def near_duplicates_and_long_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies go whole first; long lines that still stand in two documents or more go after them."""
    return drop_long_lines(spark, stored(near_duplicates(spark, docs, sf_dir)), sf_dir)


STAGES = [
    ("language_id", drop_unidentified),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", near_duplicates_and_long_lines),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mixed),
]

#: None: SQL can express neither the trained language model nor the template tree; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return docs
