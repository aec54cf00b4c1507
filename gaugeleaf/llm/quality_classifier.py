"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Every text becomes a few statistics (lengths, shares of characters, words and
lines, repetition).  A Gaussian kernel over them is approximated by random
Fourier features; the normal equations of a ridge regression are summed over
partitions; a monotone map fitted on labelled rows that the regression has not
seen turns its output into a score from 0 to 1.

Scale: the training sample is chosen from the labels and the ids alone, at most
``sample_rows`` labelled documents (those with the smallest hash of doc_id), a
documented bound; statistics are computed for these, and once more for every
document where it is scored, in one pass without a shuffle.  Only matrices of
the features' size reach the driver, and what is broadcast is the sample's ids
and the fitted model, plain arrays of a fixed size.

Labels are learned only from rows whose crc32(doc_id) mod 4 is not 2; the other
labelled rows are held out.  Labels, lang, source and doc_id are no inputs.

Edge cases: null and empty texts have all-zero statistics and get a score;
texts of any length are one row of statistics; without labels, or with one kind
of label only, every score is the labels' share (0.5 without any); repeated
labels count once (the highest), and a labelled doc_id on several texts counts
once, with the least statistics; ties of the raw score share one calibrated value;
an empty table gives no row.  ``keep_good`` keeps all columns; ``quality_scores``
returns doc_id and its own columns only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import materialize

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
END = np.zeros(256, dtype=bool)
END[[ord(c) for c in ".!?"]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
SIGN = np.ones(256, dtype=bool)
SIGN[[0x20, *range(0x09, 0x0E), *range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

STATISTICS = (
    "log_words", "log_lines", "word_length", "word_length_spread", "short_words", "long_words", "symbols", "punctuation", "ends", "digits", "upper",
    "signs", "distinct_words", "repeated_neighbours", "top_word", "distinct_pairs", "distinct_grams", "distinct_lines", "line_words", "words_per_end", "ends_with_end", "bars", "capital_words",
)


def distinct_share(keys: np.ndarray, rows: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    """Distinct keys of each row as a share of its keys (1 without any)."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.where(counts > 0, np.bincount(r[fresh], minlength=n) / np.maximum(counts, 1), 1.0)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each of the texts laid end to end."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, ends, hashes, first = K.words(data, offsets, K.SPACE)
    rows = K.rows_of(first)
    count = np.diff(first)
    words = np.maximum(count, 1)
    size = (ends - starts).astype(np.float64)

    def per_byte(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=flags, minlength=n)

    chars = np.maximum(sizes, 1)
    mean = per_word(size) / words
    spread = np.sqrt(np.maximum(per_word(size * size) / words - mean * mean, 0))
    last = data[ends - 1] if len(ends) else data[:0]
    ended = per_word(END[last])
    newline = data == 0x0A
    lines = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(newline, out=lines[1:])
    n_lines = lines[offsets[1:]] - lines[offsets[:-1]] + (sizes > 0)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    begin = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, dtype=int)
    runs = np.diff(np.append(begin, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[begin], runs)
    distinct = np.where(count > 0, np.bincount(r[begin], minlength=n) / words, 1.0)

    def gram_share(k: int) -> np.ndarray:
        grams = K.ngrams(hashes, k)
        own = rows[: len(grams)]
        inside = own == rows[k - 1 :] if len(grams) else own.astype(bool)
        return distinct_share(grams[inside], own[inside], n, np.maximum(count - k + 1, 0))

    # a line's key: the sum of its words' hashes in order
    line_of = lines[starts] if len(starts) else starts
    up, _ = K.powers(len(hashes))
    new_line = np.ones(len(starts), dtype=bool)
    new_line[1:] = (line_of[1:] != line_of[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new_line)
    place = np.arange(len(hashes)) - np.repeat(at, np.diff(np.append(at, len(hashes)))) if len(hashes) else np.zeros(0, dtype=int)
    keys = np.add.reduceat(hashes * up[place], at) if len(at) else hashes[:0]
    full_lines = np.bincount(rows[at], minlength=n)
    tail = np.array([END[data[b - 1]] if b > a else False for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=float)
    bars = np.zeros(256, dtype=bool)
    bars[0x7C] = True
    out = np.stack(
        [
            np.log1p(count), np.log1p(n_lines), mean / 10, spread / 10, per_word(size <= 3) / words, per_word(size > 12) / words, per_byte(SYMBOL) / words, per_byte(PUNCTUATION) / words,
            ended / words, per_byte(DIGIT) / chars * 5, per_byte(UPPER) / words, per_byte(SIGN) / words, distinct, per_word(same) / words, top / words, gram_share(2), gram_share(4),
            distinct_share(keys, rows[at], n, full_lines), np.log1p(count / np.maximum(full_lines, 1)) / 3, np.log1p(count / np.maximum(ended, 1)) / 3, tail, per_byte(bars) / words, per_word(UPPER[data[starts]] if len(starts) else starts) / words,
        ],
        axis=1,
    )
    out[count == 0] = 0
    return out.astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for i, n, data, offsets in K.text_slices(batch):
                grid = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([names.slice(i, n), K.list_array(grid.reshape(-1), np.arange(n + 1) * grid.shape[1], pa.float32())], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What is broadcast: executors need not have this module on their path to read it."""
        return self.center, self.scale, self.frequencies, self.phases, self.weights, self.knots, self.values

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.center) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases), x / 8, np.ones((len(x), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.values[0])
        raw = np.round(self.features(stats) @ self.weights, 9)
        return np.clip(np.interp(raw, self.knots, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the monotone map nearest to (x, y): pool adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, t = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + t]
    knots = np.array([t / c for _, c, t in blocks])
    return knots, np.array([(s + 0.5) / (c + 1) for s, c, _ in blocks])


def stat_grid(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), len(STATISTICS))


def fit(docs: DataFrame, labels: DataFrame, n_features: int = 256, gamma: float = 0.04, ridge: float = 0.1, sample_rows: int = 20_000, seed: int = 11) -> Model:
    """The model, from at most sample_rows labelled documents outside the held-out fold."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = known.where(fold != 2).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = materialize(chosen, "labelled")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")  # sample_rows ids at most
    sample = document_statistics(own).groupBy("doc_id").agg(F.min("stats").alias("stats")).join(F.broadcast(chosen), "doc_id")
    sample = sample.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int"))
    sample = materialize(sample.select("part", "quality", "stats"), "training-sample")
    moments = sample.select("part", "quality", F.posexplode("stats").alias("k", "v")).where("part < 4").groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    d = len(STATISTICS)
    center, scale = np.zeros(d), np.ones(d)
    for row in moments:
        center[row["k"]], scale[row["k"]] = row["m"], row["s"] if row["s"] > 1e-6 else 1.0
    draw = np.random.default_rng(seed)
    model = Model(center, scale, draw.normal(size=(d, n_features)) * np.sqrt(2 * gamma), draw.uniform(0, 2 * np.pi, n_features), np.zeros(0), np.zeros(1), np.full(1, 0.5))
    sent = sample.sparkSession.sparkContext.broadcast(model.arrays())
    width = n_features + d + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, seen = np.zeros((width, width)), np.zeros(width), np.zeros(2)
        fitted = Model(*sent.value)
        for batch in batches:
            x = fitted.features(stat_grid(batch))
            y = batch.column(batch.schema.get_field_index("quality")).to_numpy().astype(np.float64)
            gram += x.T @ x
            target += x.T @ y
            seen += [len(y), y.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary()), pa.array([seen[0]]), pa.array([seen[1]])], names=["gram", "target", "n", "ones"])

    # the sample is bounded, so a fixed number of partitions sends a fixed number of matrices
    parts = sample.where("part < 4").coalesce(4).mapInArrow(sums, "gram binary, target binary, n double, ones double").collect()
    total, ones = sum(p["n"] for p in parts), sum(p["ones"] for p in parts)
    if not total or ones in (0, total):
        model.values = np.full(1, ones / total if total else 0.5)
        return model
    gram = sum(np.frombuffer(p["gram"]).reshape(width, width) for p in parts)
    target = sum(np.frombuffer(p["target"]) for p in parts)
    model.weights = np.linalg.solve(gram + ridge * np.eye(width), target)
    rest = sample.where("part = 4").collect()
    if rest:
        raw = model.features(np.array([r["stats"] for r in rest], dtype=np.float64)) @ model.weights
        model.knots, model.values = isotonic(raw, np.array([r["quality"] for r in rest], dtype=np.float64))
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for i, n, data, offsets in K.text_slices(batch):
                yield pa.RecordBatch.from_arrays([names.slice(i, n), pa.array(model.score(statistics(data, offsets).astype(np.float64)))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents with a score of threshold or more, columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*sent.value)
        for batch in batches:
            for i, n, data, offsets in K.text_slices(batch):
                good = model.score(statistics(data, offsets).astype(np.float64)) >= threshold
                yield batch.slice(i, n).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
