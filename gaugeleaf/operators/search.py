"""An inverted index: postings by term, with positions, lengths and tiers of impact, in a Parquet table.

A term's postings lie in one partition of hashed terms, sorted by term, so that a search reads the row
groups of its words and nothing of other documents.  Within it they are parted by impact, what a posting
adds to a score before the weight of its term: the best k documents are often known from the upper tiers.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import fresh_path
from .retrieval import words_of

TIERS = 4
K1, B = 1.2, 0.75
MOST_IMPACT = K1 + 1


def impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class SearchIndex:
    """The tables below path: postings (bucket, tier, term, key, tf, positions, length), terms (term, documents) and totals (documents, mean length)."""

    spark: SparkSession
    path: str
    key: str
    buckets: int
    documents: int
    mean: float
    schema: T.StructType

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: str, path: str | None = None, buckets: int = 16) -> SearchIndex:
        """Indexes every row of docs; rows of one key are one document, null texts and keys none."""
        spark = docs.sparkSession
        path = path or fresh_path(spark, "search")
        worded = docs.where(F.col(key).isNotNull()).select(key, words_of(F.col(text)).alias("words"))
        totals = worded.agg(F.count("*").alias("documents"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)).alias("mean")).first()
        mean = totals.mean or 1.0
        each = worded.select(key, F.size("words").alias("length"), F.posexplode("words").alias("position", "term"))
        held = each.groupBy("term", key).agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"), F.max("length").alias("length"))
        tier = F.least(F.lit(TIERS - 1), F.floor(impact(F.col("tf"), F.col("length"), F.lit(mean)) / MOST_IMPACT * TIERS)).cast("int")
        placed = held.withColumns({"bucket": bucket_of(F.col("term"), buckets), "tier": tier})
        placed.repartitionByRange("bucket", "tier", "term", key).sortWithinPartitions("bucket", "tier", "term", key).write.partitionBy("bucket", "tier").parquet(f"{path}/postings")
        counted = spark.read.schema(placed.schema).parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("documents"))
        counted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return cls(spark, path, key, buckets, totals.documents, float(mean), placed.schema)

    @functools.cached_property
    def table(self) -> DataFrame:
        """All postings; the folders are listed once."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")

    @functools.cached_property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, documents long").parquet(f"{self.path}/terms")

    def postings(self, words: list[str], tiers: list[int] | None = None) -> DataFrame:
        """The postings of words: a scan of their partitions and row groups."""
        found = self.table.where(F.col("bucket").isin(*(bucket_of(F.lit(w), self.buckets) for w in words)) & F.col("term").isin(words))
        return found if tiers is None else found.where(F.col("tier").isin(tiers))

    def weights(self, words: list[str]) -> dict[str, float]:
        """The weight of each word that occurs: the rarer, the more."""
        found = self.terms.where(F.col("term").isin(words)).collect()  # a row for each word
        return {r.term: math.log(1 + (self.documents - r.documents + 0.5) / (r.documents + 0.5)) for r in found}

    def holding(self, words: list[str]) -> DataFrame:
        """key and length of the documents that hold every word."""
        words = sorted(set(words))
        each = self.postings(words).groupBy(self.key).agg(F.count("*").alias("n"), F.max("length").alias("length"))
        return each.where(F.col("n") == len(words)).drop("n")

    def phrase(self, words: list[str]) -> DataFrame:
        """key of the documents in which the words follow one another."""
        distinct = sorted(set(words))
        each = self.postings(distinct).groupBy(self.key).pivot("term", distinct).agg(F.first("positions"))
        place = F.exists(F.col(f"`{words[0]}`"), lambda p: reduce_and([F.array_contains(F.col(f"`{w}`"), p + i) for i, w in enumerate(words)]))
        return each.where(F.coalesce(place, F.lit(False))).select(self.key)

    def scored(self, words: list[str], rows: DataFrame | None = None) -> DataFrame:
        """key and score (BM25) of the documents with any of the words."""
        weights = self.weights(words)
        weight = self.weight(weights)
        rows = self.postings(words) if rows is None else rows
        part = weight * impact(F.col("tf"), F.col("length"), F.lit(self.mean))
        # added up in the order of the words, so that equal documents have equal scores
        parts = F.array_sort(F.collect_list(F.struct("term", part.alias("part"))))
        return rows.groupBy(self.key).agg(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["part"]).alias("score"))

    def weight(self, weights: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for word, w in weights.items():
            out = F.when(F.col("term") == word, F.lit(w)).otherwise(out)
        return out

    def best(self, words: list[str], k: int) -> DataFrame:
        """The k documents of the highest score, ties by key, with score and tiers (how many were read in full).

        Tiers are read from the top until no document outside of them can be among the k; what the found ones have
        further down is looked up for those alone that can still be.
        """
        words = sorted(set(words))
        weights = self.weights(words)
        for tier in reversed(range(TIERS)):
            read = list(range(tier, TIERS))
            edge = tier * MOST_IMPACT / TIERS  # what a word can add from below
            if tier == 0:
                break
            rest = sum(weights.values()) * edge
            part = self.weight(weights) * impact(F.col("tf"), F.col("length"), F.lit(self.mean))
            seen = self.postings(words, read).groupBy(self.key).agg(F.sum(part).alias("least"), (F.lit(sum(weights.values())) - F.sum(self.weight(weights))).alias("open"))
            top = seen.orderBy(F.desc("least")).limit(k).agg(F.count("*").alias("n"), F.min("least").alias("kth")).first()
            if top.n == k and top.kth > rest:
                able = seen.where(F.col("least") + F.col("open") * edge >= top.kth - 1e-9).select(self.key)
                rows = self.postings(words).join(able, self.key, "left_semi")
                return self.scored(words, rows).orderBy(F.desc("score"), self.key).limit(k).withColumn("tiers", F.lit(TIERS - tier))
        return self.scored(words).orderBy(F.desc("score"), self.key).limit(k).withColumn("tiers", F.lit(TIERS))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def reduce_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
