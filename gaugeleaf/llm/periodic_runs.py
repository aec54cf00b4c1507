"""Runs of words that repeat with a period, and texts with the repetition taken out.

A run is a stretch of words in which words one period apart are equal, at least two periods and
`least` words long, that no neighbouring word extends; its period is the smallest it has.  Words are
numbered, and the numbers lie as bit planes in big integers, one bit for each word of the text.  For a
lag, the planes are XORed with themselves shifted by the lag and the mismatches ORed; what is left
zero are words equal to those a lag further on, and ANDs with shifts that double leave only stretches
that are long enough.

Lags under eight are all tried.  Of lags from 2g up to 4g only those are tried at which a stretch of g
words, looked up at every (g + 1)th word, comes again: a run of such a period has 2g matching words
at least, so one of these places lies in it, and no run is missed.  A text of n words has at most 2n
such pairs for each power of two, whatever it holds, and pairs inside a run whose period divides the
lag are settled.

Null and empty texts have no words and no runs, and their collapsed text is empty.  A text of any
length is one row; equal rows have equal results; an empty table gives an empty result.  Further
columns are kept; those named n_words, runs or collapsed are replaced.  There is no shuffle: a task
holds one text at a time beside its batch, and a lost task is run again alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class BitPlanes:
    """The word numbers of one text as big integers, bit i of plane b being bit b of number i."""

    def __init__(self, ids: np.ndarray, distinct: int):
        self.n = len(ids)
        self.planes = [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range((distinct - 1).bit_length())]

    def stretches(self, lag: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last of the places from which need words in turn equal those a lag further on."""
        differ = 0
        for plane in self.planes:
            differ |= plane ^ plane >> lag
        left = ~differ & (1 << self.n - lag) - 1
        held = 1
        while held < need and left:
            step = min(held, need - held)
            left &= left >> step
            held += step
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.places(left & ~(left << 1)), self.places(left & ~(left >> 1))

    def places(self, bits: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(self.n // 8 + 1, "little"), np.uint8), bitorder="little"))


def longer_names(names: np.ndarray, step: int) -> np.ndarray:
    """From names of every stretch of step words, those of every stretch of twice as many: equal where the words are."""
    left, right = names[: len(names) - step], names[step:]
    return np.unique(left * (names.max() + 1) + right, return_inverse=True)[1].astype(np.int64)


def open_pairs(names: np.ndarray, width: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Lags from 2 * width on, under twice that, at which a stretch of width words comes again outside known runs."""
    n = len(names) + 1
    keys = np.sort(names * n + np.arange(n - 1))
    at = np.arange(0, n - 1, width + 1)
    low = np.searchsorted(keys, names[at] * n + np.minimum(at + 2 * width, n - 1))
    high = np.searchsorted(keys, names[at] * n + np.minimum(at + 4 * width, n - 1))
    counts = np.maximum(high - low, 0)
    first = np.repeat(at, counts)
    second = keys[np.repeat(low, counts) + K.ragged(counts)] % n
    settled = np.zeros(len(first), dtype=bool)
    for start, length, period in runs:
        if length >= 3 * width:
            a, b = np.searchsorted(first, (start, start + length))
            settled[a:b] |= ((second[a:b] - first[a:b]) % period == 0) & (second[a:b] + width <= start + length)
    return np.unique((second - first)[~settled])


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] if n > 1 else found


def runs_of(ids: np.ndarray, distinct: int, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and then period."""
    n, found = len(ids), []
    if n < max(least, 2):
        return found
    width = 1
    names = ids
    while 4 * width <= least:  # every run has as many as least / 2 words that come again a period later
        names = longer_names(names, width)
        width *= 2
    planes = None

    def collect(lag: int) -> None:
        nonlocal planes
        planes = planes or BitPlanes(ids, distinct)
        need = max(least, 2 * lag) - lag
        shorter = [lag // p for p in prime_factors(lag)]
        for start, last in zip(*(x.tolist() for x in planes.stretches(lag, need)), strict=True):
            if not any(np.array_equal(ids[start : start + lag], ids[start + d : start + d + lag]) for d in shorter):
                found.append((start, last - start + need + lag, lag))

    if np.bincount(names).max() > 1:
        for lag in range(1, min(2 * width - 1, n // 2) + 1):
            collect(lag)
    while 4 * width <= n and np.bincount(names).max() > 1:
        for lag in open_pairs(names, width, found).tolist():
            if 2 * lag <= n:
                collect(lag)
        names = longer_names(names, width)
        width *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start and then period) and collapsed, the text without repetition.

    Needs a column text; words end at space and the characters 9 to 13.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kept = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(T.ArrayType(RUN))
        for batch in batches:
            for i, n, data, offsets in K.text_slices(batch):
                part = batch.slice(i, n)
                sizes, runs, texts = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = data[a:b].tobytes().split()  # on exactly the six blanks of ASCII
                    numbers: dict[bytes, int] = {}
                    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    mine = runs_of(ids, len(numbers), least)
                    sizes.append(len(words))
                    runs.append([{"start": s, "length": m, "period": p} for s, m, p in mine])
                    texts.append(b" ".join(collapsed(words, mine)))
                made = [pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *made], names=schema.fieldNames())

    return docs.select(*kept).mapInArrow(run, schema)


def tiled(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which about a tenth of the texts repeat a stretch of their words up to the end.

    With h the CRC-32 of the decimal doc_id and g = floor(h / 10), the text of n > 0 words of a row with
    h % 10 = 0 repeats, from word a = g % n on, its next 1 + floor((n - a) / (3 + g % 8)) words.  A row
    without doc_id keeps its text.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    n, a, p = F.size("words").cast("long"), F.col("a"), F.col("p")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p) + 1
    return (
        docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
        .withColumn("g", F.floor(F.col("h") / 10))
        .withColumn("words", F.when(chosen & F.col("text").rlike(r"[^\x20\x09-\x0D]"), words))
        .withColumn("a", F.col("g") % n)
        .withColumn("p", F.floor((n - a) / (3 + F.col("g") % 8)) + 1)
        .select(
            "doc_id",
            F.when(F.col("words").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", (place(i) - 1).cast("int"))), " "))
            .alias("text"),
        )
    )


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one (ties: smallest start, then period) and digests of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length"),
        (-F.col("best.finer")).alias("period"),
        F.expr("(1000 * best.length) div (-best.finer)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
