"""A corpus pipeline: quality rules, near-duplicates, pseudonyms, source mixing and packing, each over all it is given.

Every stage but the last returns the columns it was given, in their order. What the operators say of nulls, empty and
very long texts, ties, repeated rows, empty tables and clashing columns holds for the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairlead.functions.stages import durable
from fairlead.llm import mixing, near_duplicates, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts; null, empty and short texts go, each row is judged for itself."""
    return quality.keep(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: shingles of five words, 0.8 similar or more, among documents that meet by
    operator 6's fingerprints or by least hashes. The row with the least id
    stays, a null id only where there is no other, and one row of rows that repeat."""
    return near_duplicates.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced under the session's key; columns such as n_chars are as they were."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some of them repeated, near each source's target; a null source is one of its own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document of the mix lies; each repetition of a document is packed for itself."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", one_of_each_group),
    ("pseudonyms", pseudonyms),
    ("source mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written as Parquet and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Similarity of sets of shingles, keyed pseudonyms and token ids are beyond SQL; a test compares run's rows with those of
#: a plain Python pipeline.
ORACLE_SQL = None
