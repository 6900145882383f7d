"""A training corpus from raw documents: five stages, each one operator of thicket.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet in the
shared folder and reads them back as the next one's docs. All but the last return the columns of documents.

Defined cases, in any stage: null and empty texts are documents without words; they are scored, alone in their group, clean and of size
0. A null doc_id is a document like others, and counts as unlabelled. Repeated rows are one group of near-duplicates, of which one stays; rows that
share a doc_id but not the text are different documents. A null source is one of the sources, in the last place. Further columns of documents,
whatever their names, are carried to the last stage, which has its own columns. Empty tables give an empty result; without
labels of both classes the classifier has nothing to learn and every document stays or goes by its constant score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import contamination, mixing, neardup, quality, substrings
from thicket.llm._store import written


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return neardup.without_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 35 words and more that occur twice."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and at which training position it is used first."""
    out = mixing.mixed(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "position")
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


STAGES = [
    ("quality classifier", accept_quality),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifier's trees have no SQL form; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
