"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept; all but the last return the
columns of ``documents``.  Rows that lack a doc_id, or share one, are scored,
compared, mixed and packed each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isotrack.llm.common import only_last_table_stays, read_table, stage
from isotrack.llm.exact_dedup import drop_repeats
from isotrack.llm.mixing import curriculum
from isotrack.llm.ngram_join import one_per_group
from isotrack.llm.packing import pack
from isotrack.llm.quality import select_documents
from isotrack.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose expected chance of the clean grade is one half or more."""
    return select_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each text, that of the largest doc_id."""
    return drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return one_per_group(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their weights, in training order."""
    return curriculum(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("packing", packing)]

#: The classifier is fitted and the tokenizer's pieces are packed outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written on its way is deleted when its result is."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with only_last_table_stays(spark):
            docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
