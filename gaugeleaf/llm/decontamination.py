"""Benchmark decontamination with suffix arrays over the training words.

Every task is one shard of the training corpus.  It numbers the words of its
texts by the benchmark's vocabulary, builds a suffix array of the word
positions that can start a match, and binary-searches every benchmark suffix
in it.  A hit is extended to the longest verbatim match, and a document with a
match of a whole window is contaminated.

Scale: documents are mapped where they are read, in one pass and without a shuffle.
The benchmark is the stated query set.  It is written as blocks of at most
``block_bytes`` of text into the shared folder; a task gathers a shard of some
megabytes of text, holds it against one block after the other, and hands it on, so
that neither the driver nor a task ever holds more of the benchmark than a block.
An item longer than a block lies in several, in pieces that overlap by a window less
a word; its matches are put together again.

Edge cases: a null or empty text has no words, is never contaminated and is
returned with zeros; a text of any length is one slice; an empty benchmark leaves all
documents clean, and an empty table of documents gives no row; an item
shorter than the window is one window of its own length; an item without words
is never found; an item without item_id counts like any other; equal items with different
ids are all reported, equal matches of one item once; repeated rows are judged one by one;
extra columns are kept, and columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .tables import materialize, open_shared

MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


#: Stands for a null item_id inside a task.
NO_ID = -(2**63)


class SuffixQueries:
    """The windows of one block of benchmark items, as sorted rows of vocabulary numbers."""

    def __init__(self, items: list[tuple[int, int, str]], window: int):
        data = np.frombuffer("".join(t for _, _, t in items).encode(), dtype=np.uint8)
        offsets = np.cumsum([0, *(len(t.encode()) for _, _, t in items)])
        _, _, hashes, first = K.words(data, offsets, K.NOT_ALNUM)
        self.window = window
        self.vocabulary = np.unique(hashes)
        numbers = np.append(np.searchsorted(self.vocabulary, hashes) + 1, np.zeros(window, dtype=np.int64))
        words = np.diff(first)
        sizes = np.minimum(words, window)
        counts = np.where(sizes > 0, words - sizes + 1, 0)
        item, at = np.repeat(np.arange(len(items)), counts), K.ragged(counts)
        self.sizes = sizes[item]
        self.least = int(self.sizes.min()) if len(item) else 0
        padded = np.zeros((len(item), window), dtype=">u4")
        for k in range(window):
            padded[:, k] = np.where(self.sizes > k, numbers[first[item] + at + k], 0)
        self.keys = keys_of(padded)
        self.items = np.array([NO_ID if i is None else i for i, _, _ in items], dtype=np.int64)[item]
        self.at = np.array([before for _, before, _ in items], dtype=np.int64)[item] + at

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the block's vocabulary, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def matches(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest matches in texts of numbered words: text, item, first word, length, and the first word's place in the item."""
        none = np.zeros(0, dtype=np.int64)
        if not len(numbers) or not len(self.keys):
            return none, none, none, none, none
        stops = first[1:][K.rows_of(first)]
        unknown = np.flatnonzero(numbers == 0)
        place = np.arange(len(numbers))
        upcoming = np.append(unknown, len(numbers))[np.searchsorted(unknown, place)]
        reach = np.minimum(upcoming, stops) - place
        starts = np.flatnonzero(reach >= self.least)
        if not len(starts):
            return none, none, none, none, none
        grid = np.zeros((len(starts), self.window), dtype=">u4")
        padded = np.append(numbers, np.zeros(self.window, dtype=numbers.dtype))
        for k in range(self.window):
            grid[:, k] = np.where(reach[starts] > k, padded[starts + k], 0)
        keys = keys_of(grid)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = starts[order], keys[order]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(self.sizes):
            own = np.flatnonzero(self.sizes == size)
            wanted = self.keys[own]
            cut = np.dtype(f"S{4 * size}")
            array = keys if size == self.window else keys.astype(cut)
            wanted = wanted if size == self.window else wanted.astype(cut)
            low, high = np.searchsorted(array, wanted, "left"), np.searchsorted(array, wanted, "right")
            counts = high - low
            query = np.repeat(own, counts)
            at = suffixes[np.repeat(low, counts) + K.ragged(counts)]
            whole = reach[at] >= size
            found.append((query[whole], at[whole]))
        query = np.concatenate([q for q, _ in found])
        at = np.concatenate([p for _, p in found])
        if not len(query):
            return none, none, none, none, none
        text = np.searchsorted(first, at, side="right") - 1
        item, shift = self.items[query], at - self.at[query]
        order = np.lexsort((at, shift, item, text))
        text, item, shift, at, size = text[order], item[order], shift[order], at[order], self.sizes[query][order]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(at)) - 1
        return text[begin], item[begin], at[begin] - first[text[begin]], at[last] + size[last] - at[begin], at[begin] - shift[begin]


def keys_of(grid: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings that sort like them."""
    grid = np.ascontiguousarray(grid)
    return grid.view(f"S{grid.shape[1] * 4}").reshape(-1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def pieces_of(text: str, window: int, most: int) -> Iterator[tuple[int, str]]:
    """An item's text in runs of words of about most bytes, with the number of the first word; windows never get lost between them."""
    raw = text.encode()
    if len(raw) <= most:
        yield 0, text
        return
    starts, ends, _, _ = K.words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), K.NOT_ALNUM)
    at = 0
    while at < len(starts):
        stop = max(at + window, int(np.searchsorted(ends, starts[at] + most, side="right")))
        yield at, raw[starts[at] : ends[min(stop, len(ends)) - 1]].decode("utf-8", "replace")
        if stop >= len(starts):
            return
        at = stop - window + 1


BLOCK = T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("text", T.StringType())])))])


def write_blocks(benchmark: DataFrame, block_bytes: int, window: int) -> list[str]:
    """Writes the items in blocks of at most block_bytes (one piece at least), a row each; returns the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(BLOCK["items"].dataType)
        block: list[dict] = []
        size = 0
        for batch in batches:
            for item_id, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for first, text in pieces_of(whole or "", window, block_bytes):
                    n = len(text.encode())
                    if block and size + n > block_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([block], kind)], names=["items"])
                        block, size = [], 0
                    block.append({"item_id": item_id, "first": first, "text": text})
                    size += n
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([block], kind)], names=["items"])

    return materialize(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, BLOCK), "benchmark").inputFiles()


class Blocks:
    """The blocks of a benchmark one after the other; one alone is kept."""

    def __init__(self, files: list[str], window: int):
        self.files, self.window = files, window
        self.only: list[SuffixQueries] | None = None

    def __iter__(self) -> Iterator[SuffixQueries]:
        if self.only is not None:
            yield from self.only
            return
        seen, last = 0, None
        for name in self.files:
            with open_shared(name) as file:
                for batch in pq.ParquetFile(file).iter_batches(batch_size=1):
                    for items in batch.column(0).to_pylist():
                        last = SuffixQueries([(i["item_id"], i["first"], i["text"]) for i in items], self.window)
                        seen += 1
                        yield last
        if seen <= 1:
            self.only = [last] if seen else []


def joined(found: list[np.ndarray]) -> np.ndarray:
    """Rows (text, item, start, length, place in item) with those of one item that overlap at one shift as one: pieces of an item meet again."""
    rows = np.concatenate([np.zeros((0, 5), dtype=np.int64), *found])
    text, item, start, length, place = rows.T
    order = np.lexsort((start, start - place, item, text))
    rows = rows[order]
    out: list[list[int]] = []
    for row in rows.tolist():
        if out and row[:2] == out[-1][:2] and row[2] - row[4] == out[-1][2] - out[-1][4] and row[2] <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], row[2] + row[3] - out[-1][2])
        else:
            out.append(row)
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, columns: tuple[str, ...] | None = None, shard_bytes: int = 16 << 20) -> DataFrame:
    """docs (or the named columns of it) with n_words, spans (merged word ranges) and matches (item, first word, length).

    Needs a column text in docs and item_id, text in benchmark.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("n_words", "spans", "matches")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("matches", T.ArrayType(MATCH))])
    files = write_blocks(benchmark, block_bytes, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(files, window)
        span_type, match_type = to_arrow_type(T.ArrayType(SPAN)), to_arrow_type(T.ArrayType(MATCH))

        def judged(shard: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            found: list[list[np.ndarray]] = [[] for _ in shard]
            for queries in blocks:
                for own, (_, hashes, first) in zip(found, shard, strict=True):
                    own.append(np.stack(queries.matches(queries.numbered(hashes), first), axis=1))
            for own, (part, _, first) in zip(found, shard, strict=True):
                matches: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for text, item, start, length, _ in joined(own).tolist():
                    matches[text].append({"item_id": None if item == NO_ID else item, "start": start, "length": length})
                spans = [[{"start": a, "end": b} for a, b in merged([(m["start"], m["start"] + m["length"]) for m in own])] for own in matches]
                made = [pa.array(np.diff(first), pa.int64()), pa.array(spans, span_type), pa.array(matches, match_type)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *made], names=schema.fieldNames())

        shard, size = [], 0
        for batch in batches:
            for i, n, data, offsets in K.text_slices(batch):
                _, _, hashes, first = K.words(data, offsets, K.NOT_ALNUM)
                shard.append((batch.slice(i, n), hashes, first))
                size += len(data)
                if size >= shard_bytes:
                    yield from judged(shard)
                    shard, size = [], 0
        if shard:
            yield from judged(shard)

    wanted = [*kept, *([] if "text" in kept else ["text"])]
    return docs.select(*wanted).mapInArrow(run, schema)


def with_hits(matched: DataFrame) -> DataFrame:
    """Adds n_hit (words inside a window), items (sorted as strings) and contaminated."""
    return matched.withColumns(
        {
            "n_hit": F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
            "items": F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string")))),
        }
    ).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a window of the benchmark, columns unchanged."""
    mine = ("n_words", "spans", "matches")
    renamed = docs.withColumnsRenamed({c: f"__{c}" for c in mine if c in docs.columns})
    clean = find_matches(renamed, benchmark, window).where(F.size("spans") == 0).drop(*mine)
    return clean.withColumnsRenamed({f"__{c}": c for c in mine}).select(*docs.columns)
