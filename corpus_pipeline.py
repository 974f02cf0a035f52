"""Corpus pipeline over `documents`: quality classifier, near-duplicates, benchmark decontamination, pseudonyms, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; what a stage returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Rows with null or empty
text are rejected by the first stage; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.bpe import encode
from inkwell.llm.common import load, settled, written
from inkwell.llm.decontaminate import drop_leaks
from inkwell.llm.minhash import drop_near_duplicates
from inkwell.llm.pii import replace_pii
from inkwell.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps; null and empty texts go, repeated rows are judged each by itself, other columns pass through."""
    return keep_quality(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each group of near copies, and all rows in none; rows with a null id stay, all rows of a dropped id go."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty texts hold none, without a benchmark all rows stay."""
    return drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal values replaced in their texts; null texts stay null, n_chars stays right as lengths do not change."""
    return replace_pii(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with tokens, n_tokens and round_trip in place of the text; null text gives nulls."""
    return encode(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("encoding", encoding),
]

#: SQL can express neither the trained classifier nor the keyed permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Of what they write to the shared folder only the last stage's input is left."""
    docs, mark = load(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, mark)
    return STAGES[-1][1](spark, docs, sf_dir)
