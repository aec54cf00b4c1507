"""Corpus cleaning: stages over documents, each written as Parquet and read again by the next.

Every stage takes what its predecessor kept, whole texts, and hands on the columns of documents;
the last returns packed pieces.  Null and empty texts pass to the classifier, which scores them like
any other; texts of any length are one row; equal rows are copies of each other for near-dedup and
one document for substring dedup; an empty table gives an empty result; further columns are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeleaf.llm.tables import load, released_after, write_table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    from gaugeleaf.llm.quality_classifier import keep_good

    return keep_good(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    from gaugeleaf.llm.minhash import keep_one_of_each

    return keep_one_of_each(docs, percent=80, shingle=5)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from every document but the earliest."""
    from gaugeleaf.llm.line_dedup import without_repeats

    return without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    from gaugeleaf.llm.decontamination import decontaminate

    return decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence and place in it."""
    from gaugeleaf.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned scores and a local search over token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released_after(spark):  # the tables that a stage has made on its way
            docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
