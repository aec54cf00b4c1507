"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every partition of the input counts its rows.  The matrix of rows that each
partition sends to each shard is drawn as a tree over the partitions: a node
holds how many rows its partitions send to each shard, and one multivariate
hypergeometric draw, seeded by the node, splits that between its halves.  A
task walks from the root to its own partition and so draws its row of the
matrix; nobody holds the whole.  Each partition then gives its rows the drawn
labels in a random order (the local permutation) and rows are exchanged.  The
second permutation is a sort by a random key: a shard is dealt into cells by
ranges of the key, so that no task sees a whole shard, and a row's slot is the
size of the shard's earlier cells and its place in its own.

Law: ``rows``: the shards' row counts differ by one at most, and every
assignment is equally likely.

Scale: what is broadcast is one number for each input partition (8 MB for a
million), as many as the driver schedules anyway; more than ``most_broadcast``
bytes are refused.  Draws are exact for any number of rows.

Edge cases: null texts count as empty, and texts of any length are one row;
an empty table gives empty shards; equal rows are placed independently, and ties of
the random key are broken by the first column; columns named shard and slot are
replaced, other extra columns are kept (names that begin with __cell, __key,
__row, __n or __first are refused); a partition whose row count changes between
the passes fails loudly instead of giving wrong sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: numpy draws from urns below this size.
SMALL_URN = 10**9


def hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn from an urn of any size.

    For a large urn, good and bad ones are drawn independently with chance n / (good + bad) until their
    number is n: given the number, every choice is equally likely.  It takes about sqrt(n) tries, drawn together.
    """
    if not good or not n:
        return 0
    if not bad or n == good + bad:
        return min(good, n)
    if good < SMALL_URN and bad < SMALL_URN:
        return int(draw.hypergeometric(good, bad, n))
    while True:
        some = draw.binomial(good, n / (good + bad), 100_000)
        rest = draw.binomial(bad, n / (good + bad), 100_000)
        hit = np.flatnonzero(some + rest == n)
        if len(hit):
            return int(some[hit[0]])


def split(sizes: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """How many of n rows go to each shard, of shards with room for sizes rows: one hypergeometric draw after another."""
    out, rest = np.zeros_like(sizes), int(sizes.sum())
    for c, size in enumerate(sizes.tolist()):
        rest -= size
        out[c] = hypergeometric(draw, size, rest, n)
        n -= int(out[c])
    return out


def matrix_row(p: int, ends: np.ndarray, capacities: np.ndarray, seed: int) -> np.ndarray:
    """Rows that partition p sends to each shard; ends are the partitions' running row counts, from 0."""
    low, high, own = 0, len(ends) - 1, capacities.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = split(own, int(ends[middle] - ends[low]), np.random.default_rng([seed, low, high]))
        if p < middle:
            high, own = middle, left
        else:
            low, own = middle, own - left
    return own


def communication_matrix(counts: np.ndarray, capacities: np.ndarray, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard: row sums counts, column sums capacities."""
    ends = np.append(0, np.cumsum(counts.astype(np.int64)))
    return np.stack([matrix_row(p, ends, capacities, seed) for p in range(len(counts))])


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], dtype=np.int64)


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7, cell_rows: int = 20_000, most_broadcast: int = 256 << 20) -> DataFrame:
    """docs with shard and slot (gapless from 0 within a shard); columns of those names are replaced."""
    docs = docs.drop("shard", "slot")
    if {"__cell", "__key", "__row", "__n", "__first"} & set(docs.columns):
        raise ValueError("columns named __cell, __key, __row, __n or __first are not allowed")
    first = docs.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], names=["p", "n"])

    found = {r["p"]: r["n"] for r in docs.select(first).mapInArrow(count, "p int, n long").collect()}
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], dtype=np.int64)
    total, ends = int(counts.sum()), np.append(0, np.cumsum(counts))
    if ends.nbytes > most_broadcast:
        raise ValueError(f"{len(counts)} partitions are more than their counts can be broadcast for")
    sent = docs.sparkSession.sparkContext.broadcast(ends)
    capacities = shard_sizes(total, shards)
    cells = max(1, -(-total // (shards * cell_rows)))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        drawn = matrix_row(p, sent.value, capacities, seed) if p < len(sent.value) - 1 else np.zeros(shards, dtype=np.int64)
        draw = np.random.default_rng([seed, p])
        labels = draw.permutation(np.repeat(np.arange(shards, dtype=np.int32), drawn))
        keys = draw.integers(0, (1 << 63) - 1, len(labels))
        at = 0
        for batch in batches:
            end = at + batch.num_rows
            if end > len(labels):
                raise RuntimeError(f"partition {p} has more rows than were counted")
            own = keys[at:end]
            cell = np.minimum((own / 2.0**63 * cells).astype(np.int64), cells - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[at:end]), pa.array(cell), pa.array(own)], names=[*batch.schema.names, "shard", "__cell", "__key"])
            at = end
        if at < len(labels):
            raise RuntimeError(f"partition {p} has fewer rows than were counted")

    def labelled(df: DataFrame) -> DataFrame:
        return df.mapInArrow(permute, T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("__cell", T.LongType()), T.StructField("__key", T.LongType())]))

    # labels depend on the seed and the place of a row only, so one column is enough to count the cells
    sizes = labelled(docs.select(first)).groupBy("shard", "__cell").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__cell").orderBy("__key", first)
    placed = labelled(docs).withColumn("__row", F.row_number().over(within))
    out = placed.join(offsets, ["shard", "__cell"]).withColumn("slot", F.col("__first") + F.col("__row") - 1)
    return out.select(*docs.columns, "shard", "slot")
