"""Substring dedup by hashing lines and the units of lines.

Every line of words is normalised (A-Z in lower case, white space collapsed) and
hashed; digests are grouped over the whole corpus, the earliest occurrence in
the order (doc_id, place in the text) is kept, and every later copy goes,
whatever its length.  A paragraph is a run of lines, so its later copies go with
them.

Passages that are spliced into the middle of a line are no line of their own.
Lines are therefore cut into units as well, where a word's hash is the smallest
among its neighbours, so that a passage has the same inner units wherever it
stands.  Units are hashed and grouped like lines, and a run of neighbouring
repeats of ``min_words`` words or more inside a line is removed; shorter runs
are stock phrases and stay.  A unit of a few words that happens to occur earlier and
stands beside a repeat goes with it.  ``min_words`` bounds these inner runs only.
Removed ranges are given as byte offsets of the original text.

Scale: one narrow row for each unit and line, aggregated before the shuffle; the join
back is on the digest, of which adaptive execution splits frequent ones.  Texts
are shuffled once, to meet the repeats found in them.

Edge cases: null and empty texts have no units and come back as they are; a
text without repeats comes back unchanged, byte for byte; a text of any length
is handled in its row; rows that share doc_id and text are one document and get the same
ranges, while one doc_id on several texts is several documents, ordered by a hash of the text
where their places tie; rows without doc_id are never compared with others and stay as they
are; an empty table gives no row; extra columns are kept, whatever they are called, but
for those named n_bytes, n_removed, removed and __units, which are replaced, and ``text``
is replaced by what is left.  ``without_repeats`` keeps these too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K

#: Numbers of lines begin here, above those of units.
LINES = 1 << 30
RANGE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def units(data: np.ndarray, offsets: np.ndarray, radius: int = 3):
    """First word of each unit, its digest, the words' starts and ends, the first unit and word of each text, and first word and digest of each line."""
    starts, ends, hashes, first = K.words(data, offsets, K.SPACE)
    n = len(starts)
    if not n:
        return starts, hashes, starts, ends, np.zeros(len(offsets), dtype=np.int64), first, starts, hashes
    newlines = np.flatnonzero(data == 0x0A)
    opens = np.zeros(n, dtype=bool)
    opens[first[:-1][first[:-1] < n]] = True
    opens[1:] |= np.searchsorted(newlines, starts[1:]) > np.searchsorted(newlines, ends[:-1])
    line = np.cumsum(opens)
    least = np.ones(n, dtype=bool)
    for d in range(1, radius + 1):
        if n > d:
            same = line[d:] == line[:-d]
            least[d:] &= ~same | (hashes[d:] < hashes[:-d])
            least[:-d] &= ~same | (hashes[:-d] <= hashes[d:])
    begins = np.flatnonzero(opens | least)
    up, down = K.powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])

    def digest(begins: np.ndarray) -> np.ndarray:
        stops = np.append(begins[1:], n)
        return K.mix((sums[stops] - sums[begins]) * down[begins] + (stops - begins).astype(np.uint64))

    lines = np.flatnonzero(opens)
    whole = K.mix(digest(lines) ^ np.uint64(0x9E3779B97F4A7C15))  # a line is never equal to a unit
    return begins, digest(begins), starts, ends, np.searchsorted(begins, first), first, lines, whole


def tag(text: str = "text") -> Column:
    """Tells apart texts of one doc_id."""
    return F.xxhash64(text).bitwiseAND(0xFFFFFFFF)


def repeated_units(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, tag and the numbers of the document's units and lines (from LINES on) that occur earlier in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, tags = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tag"))
            for i, n, data, offsets in K.text_slices(batch):
                own = tags.slice(i, n).to_numpy()
                _, digests, _, _, first, word, lines, whole = units(data, offsets, radius)
                counts, of_text = np.diff(first), np.diff(np.searchsorted(lines, word))
                owner = np.concatenate([np.repeat(np.arange(n), counts), np.repeat(np.arange(n), of_text)])
                number = np.concatenate([K.ragged(counts), LINES + K.ragged(of_text)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, n).take(pa.array(owner)), pa.array(number * (1 << 32) + own[owner]), pa.array(np.concatenate([digests, whole]).view(np.int64))],
                    names=["doc_id", "place", "digest"],
                )

    # the place of a unit or line holds its document's tag as well, which keeps the rows narrow
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), tag().alias("tag"), "text")
    found = named.mapInArrow(run, "doc_id long, place long, digest long")
    kept = found.groupBy("digest").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = found.join(kept, "digest").where("struct(doc_id, place) <> first")
    own = repeats.select("doc_id", F.col("place").bitwiseAND(0xFFFFFFFF).alias("tag"), F.shiftright("place", 32).cast("int").alias("unit"))
    return own.groupBy("doc_id", "tag").agg(F.collect_set("unit").alias("__units"))


def remove_repeats(docs: DataFrame, min_words: int = 20, radius: int = 3) -> DataFrame:
    """docs with text reduced, and n_bytes, n_removed and removed (byte ranges of the original text)."""
    docs = docs.drop("n_bytes", "n_removed", "removed", "__units")
    repeats = repeated_units(docs, radius)
    same = (F.col("d.doc_id") == F.col("r.doc_id")) & (tag("d.text") == F.col("r.tag"))
    joined = docs.alias("d").join(repeats.alias("r"), same, "left").select("d.*", "r.__units")
    columns_in = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(RANGE))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = to_arrow_type(T.ArrayType(RANGE))
        for batch in batches:
            for i, n, data, offsets in K.text_slices(batch):
                part = batch.slice(i, n)
                at = part.schema.get_field_index("text")
                marks = part.column(part.schema.get_field_index("__units")).to_pylist()
                removed: list[list] = [[] for _ in range(n)]
                texts = None
                if any(marks):
                    begins, _, starts, ends, first, word, lines, _ = units(data, offsets, radius)
                    first_line, line_stops = np.searchsorted(lines, word), np.append(lines[1:], len(starts))
                    texts = part.column(at).to_pylist()
                    stops = np.append(begins[1:], len(starts))
                    for r, own in enumerate(marks):
                        if own:
                            own = np.sort(np.array(own))
                            line = own[own >= LINES] - LINES + first_line[r]
                            spans = list(zip(lines[line].tolist(), line_stops[line].tolist(), strict=True))
                            own = own[own < LINES] + first[r]
                            edge = np.flatnonzero(np.diff(own) > 1) + 1
                            for piece in np.split(own, edge) if len(own) else ():
                                a, b = int(begins[piece[0]]), int(stops[piece[-1]])
                                if b - a >= min_words:
                                    spans.append((a, b))
                            last = -1
                            for a, b in sorted(spans):
                                end = int(starts[b]) if b < word[r + 1] else int(offsets[r + 1])
                                if a <= last:  # words that touch what is removed already
                                    last = max(last, b)
                                    removed[r][-1] = (removed[r][-1][0], max(removed[r][-1][1], int(end - offsets[r])))
                                else:
                                    last = b
                                    removed[r].append((int(starts[a] - offsets[r]), int(end - offsets[r])))
                            if removed[r]:
                                raw = data[offsets[r] : offsets[r + 1]].tobytes()
                                keep, last = [], 0
                                for a, b in removed[r]:
                                    keep.append(raw[last:a])
                                    last = b
                                texts[r] = b"".join([*keep, raw[last:]]).decode("utf-8", "replace")
                columns = [part.column(part.schema.get_field_index(c)) for c in columns_in]
                if texts is not None:
                    columns[columns_in.index("text")] = pa.array(texts, part.schema.field(at).type)
                columns += [pa.array(np.diff(offsets), pa.int64()), pa.array([sum(b - a for a, b in x) for x in removed], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in removed], ranges)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """The documents without their repeats, columns unchanged; those of which nothing is left go."""
    mine = ("n_bytes", "n_removed", "removed", "__units")
    renamed = docs.withColumnsRenamed({c: f"__own_{c}" for c in mine if c in docs.columns})
    out = remove_repeats(renamed, min_words)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(*mine).withColumnsRenamed({f"__own_{c}": c for c in mine}).select(*docs.columns)
