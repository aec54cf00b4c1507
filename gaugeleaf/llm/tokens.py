"""Token ids of whole texts, and token counts by a separator scan of flat token blocks.

Tokenising: the tokenizer drops white space and never joins characters across
it, so a text's ids are the ids of its units in order.  Each worker encodes a
unit once and keeps a bounded table of units it has seen.

Token counts: ``write_flat`` lays the ids of all documents of a task end to
end, each document closed by the end-of-document id, and cuts the stream into
blocks of a fixed number of ids without regard to documents; no index is kept.
``count_tokens`` finds the separators of each block with one vectorised search,
and stitches documents that cross blocks with a prefix scan over the blocks'
summaries (separators so far, ids since the last one).  The scan's rows are one
per block, and a window partition holds the blocks of one file, whose size the
input split bounds.

Edge cases: null and empty texts have no ids but their separator and count 0;
a document of any length spans any number of blocks; an empty table gives no
file; a null doc_id is counted as well; the separator is an id outside the vocabulary, as a text
may spell out the tokenizer's special tokens; special tokens are matched before letters are
folded; a file whose separators and manifest disagree fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tables import materialize

TOKENIZER = "word_bpe_49k.json"
#: Stands for a null doc_id in the manifest.
NO_ID = -(2**63)
#: Closes a document in a flat stream; no vocabulary has it.
SEPARATOR = 65535


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# The printable characters that stand for the 256 byte values in byte-level vocabularies.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}

SPACE_CLASS, LETTER, DIGIT, OTHER, RARE = range(5)
BYTE_CLASS = np.full(256, OTHER, dtype=np.uint8)
BYTE_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
BYTE_CLASS[[*range(0x30, 0x3A)]] = DIGIT
BYTE_CLASS[[*range(0x09), *range(0x0E, 0x20), 0x27, *range(0x7F, 0x100)]] = RARE
BYTE_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE_CLASS


def held(key: tuple, make):
    """One object for each key in this worker process, kept between its tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_gaugeleaf_worker", types.ModuleType("_gaugeleaf_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


class UnitEncoder:
    """Ids of texts laid end to end, by a table of the units seen so far.

    A unit is what the tokenizer's first splitting yields: a run of letters, one
    digit or a run of other signs, in lower case.  Units of ASCII and Latin-1
    letters are found by byte classes and given to the vocabulary's model; a
    white-space-free run with anything else (apostrophes, other scripts,
    control characters, the spelling of a special token) is one unit and goes
    through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 3_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > SEPARATOR:
            raise ValueError(f"{path}: ids do not fit 16 bits beside the separator")
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        self.begin = np.zeros(0, dtype=np.int64)  # of each in ids
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(1 << 20, dtype=np.uint16)
        self.used = 0

    def add(self, hashes: np.ndarray, units: list[bytes], rare: list[bool]) -> None:
        model, tokenizer = self.tokenizer.model, self.tokenizer
        encoded = []
        for unit, odd in zip(units, rare, strict=True):
            if odd:
                encoded.append(tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids)
            else:
                text = unit.decode("ascii") if unit.isascii() else "".join(map(BYTE_CHARACTERS.__getitem__, unit))
                encoded.append([t.id for t in model.tokenize(text)])
        counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        total = int(counts.sum())
        while len(self.ids) < self.used + total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((x for e in encoded for x in e), dtype=np.uint16, count=total)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(counts) - counts)
        self.count = np.insert(self.count, at, counts)
        self.used += total

    def units(self, data: np.ndarray, offsets: np.ndarray):
        """Bytes (folded but in rare units, which the tokenizer folds), and starts, ends and rareness of the units."""
        raw, data = data, K.LOWER[data]
        n = len(data)
        kind = BYTE_CLASS[data]
        if n:
            lead = np.flatnonzero(data[:-1] == 0xC3)
            after = data[lead + 1]
            lead = lead[(after != 0x97) & (after != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            upper = lead[data[lead + 1] < 0x9F] + 1
            data[upper] += 0x20
            special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
            kind[special] = RARE
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        inside = kind != SPACE_CLASS
        odd = np.flatnonzero(kind == RARE)
        if len(odd):
            opens = inside.copy()
            opens[1:] &= ~inside[:-1] | edge[1:n]
            opens = np.flatnonzero(opens)
            closes = inside.copy()
            closes[:-1] &= ~inside[1:] | edge[1:n]
            closes = np.flatnonzero(closes) + 1
            runs = np.unique(np.searchsorted(opens, odd, side="right") - 1)
            marks = np.zeros(n + 1, dtype=np.int32)
            marks[opens[runs]] += 1
            marks[closes[runs]] -= 1
            within = np.cumsum(marks[:n]) > 0
            kind[within] = RARE
            data[within] = raw[within]
        opens = inside & edge[:n]
        opens[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        if n:
            opens[0] = inside[0]
        starts = np.flatnonzero(opens)
        stops = edge[1:].copy()
        stops[:-1] |= opens[1:] | ~inside[1:]
        ends = np.flatnonzero(stops & inside) + 1
        return data, starts, ends, kind[starts] == RARE

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one more entry for the end)."""
        data, starts, ends, rare = self.units(data, offsets)
        up, down = K.powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(K.BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
        hashes = K.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, offsets)
        kinds, example, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        new = ~np.isin(kinds, self.known, assume_unique=True, kind="sort") if len(self.known) < len(kinds) else self.missing(kinds)
        if new.any():
            raw, where = data.tobytes(), example[new]
            self.add(kinds[new], [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], rare[where].tolist())
        slot = np.searchsorted(self.known, kinds)
        begin, counts = self.begin[slot][back], self.count[slot][back]
        ids = self.ids[np.repeat(begin, counts) + K.ragged(counts)]
        return ids, np.append(0, np.cumsum(counts))[first]

    def missing(self, kinds: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, kinds), len(self.known) - 1)
        return self.known[at] != kinds


def encoder_for(path: str) -> UnitEncoder:
    return held(("encoder", path), lambda: UnitEncoder(path))


def write_flat(docs: DataFrame, path: str | None = None, end_id: int = SEPARATOR, block_ids: int = 65536) -> DataFrame:
    """Flat token blocks in the shared folder: file, seq, kind ('ids' or 'docs'), n, data.

    Rows of kind 'ids' are the stream: unsigned 16-bit little-endian ids, cut every block_ids.
    Rows of kind 'docs' are the manifest that names the documents in stream order.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        file = TaskContext.get().partitionId()
        seqs = {"ids": 0, "docs": 0}
        rest = np.zeros(0, dtype="<u2")

        def rows(kind: str, pieces: list[np.ndarray]) -> pa.RecordBatch:
            seq = np.arange(seqs[kind], seqs[kind] + len(pieces))
            seqs[kind] += len(pieces)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pieces), file), pa.int32()), pa.array(seq, pa.int64()), pa.array([kind] * len(pieces)), pa.array([len(p) for p in pieces], pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["file", "seq", "kind", "n", "data"],
            )

        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for i, n, data, offsets in K.text_slices(batch):
                ids, begins = encoder.encode(data, offsets)
                stream = np.insert(ids, begins[1:], end_id).astype("<u2")
                rest = np.concatenate([rest, stream])
                whole = len(rest) // block_ids
                if whole:
                    yield rows("ids", [rest[k * block_ids : (k + 1) * block_ids] for k in range(whole)])
                    rest = rest[whole * block_ids :].copy()
                yield rows("docs", [names.slice(i, n).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")])
        if len(rest):
            yield rows("ids", [rest])

    flat = docs.select("doc_id", "text").mapInArrow(run, "file int, seq long, kind string, n long, data binary")
    return materialize(flat, "flat-tokens", "kind")


def count_tokens(flat: DataFrame, end_id: int = SEPARATOR) -> DataFrame:
    """doc_id, file, ordinal, start (ids before it in its file) and n_tokens of every document of a flat stream."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["data"], dtype="<u2")
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]], pa.int32()), pa.array([row["seq"]], pa.int64()), pa.array([row["n"]], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), K.list_array(at, np.array([0, len(at)]), pa.int64())],
                    names=["file", "seq", "n", "n_ends", "last_end", "at"],
                )

    blocks = flat.where(F.col("kind") == "ids").select("file", "seq", "n", "data").mapInArrow(search, "file int, seq long, n long, n_ends long, last_end long, at array<long>")
    earlier = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    scanned = scanned.withColumns(
        {
            "ends_before": F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)),
            "last_before": F.coalesce(F.max(F.col("before") + F.col("last_end")).over(earlier), F.lit(-1)),
        }
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            lists = column("at")
            counts = np.diff(np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]) if len(lists) else np.zeros(0, dtype=int)
            ends = np.asarray(lists.flatten()) + np.repeat(np.asarray(column("before")), counts)
            first = np.cumsum(counts) - counts
            starts = np.empty_like(ends)
            starts[1:] = ends[:-1] + 1
            some = counts > 0
            starts[first[some]] = np.asarray(column("last_before"))[some] + 1
            ordinal = np.repeat(np.asarray(column("ends_before")), counts) + K.ragged(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(column("file")), counts), pa.int32()), pa.array(ordinal, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64())], names=["file", "ordinal", "start", "n_tokens"])

    counted = scanned.select("file", "at", "before", "ends_before", "last_before").mapInArrow(cut, "file int, ordinal long, start long, n_tokens long")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["data"], dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["file"]), pa.int32()), pa.array(row["before"] + np.arange(len(ids)), pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.ones(len(ids), dtype=bool))], names=["file", "ordinal", "doc_id", "named"])

    manifest = flat.where(F.col("kind") == "docs").select("file", "seq", "n", "data").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    named = manifest.select("file", "before", "data").mapInArrow(name, "file int, ordinal long, doc_id long, named boolean")
    agreed = F.when(F.col("named") & F.col("start").isNotNull(), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("separators and manifest disagree in file "), F.col("file"))).cast("long"))
    return counted.join(named, ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "start", agreed.alias("n_tokens"))
