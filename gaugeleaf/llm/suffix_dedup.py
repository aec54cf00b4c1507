"""Exact substring dedup on a sparse enhanced suffix array.

Every byte that lies in a string of ``length`` bytes which also starts anywhere
else goes; the same is reported for a second, shorter length (``passage``), at
which passages of some fifty words are found.  Indexing all suffixes would cost
many times the corpus, so only anchors are indexed: the byte positions whose
``gram``-byte hash is the least of some window.  A window is exactly the set of
grams inside one string of ``passage`` bytes, so every such string holds an
anchor, and all its copies hold it at the same place; a longer string holds one
in its first ``passage`` bytes.  A match is therefore found from an anchor,
within ``passage - gram`` bytes to the left and ``length`` bytes to the right.

1. Anchors with equal grams are grouped.  Where all contexts in a group are
   equal (the inside of copies), its suffix array is a single interval: the
   whole context repeats.
2. Other groups bring one example of each distinct context together and build
   an enhanced suffix array over them: sorted right contexts and their common
   prefixes.  A stack scan yields the interval tree; in each interval the left
   contexts are sorted too, so that every occurrence gets its longest left
   extension shared with another member, not just with its neighbour in the
   array.  An interval whose prefix and extension reach a length is a repeat
   of all members that share it.
3. All repeats found from an anchor hold its gram, so their union is one range,
   which every occurrence with that context takes over.

Scale: anchors are one in seventy bytes or so, aggregated by key before the
shuffle.  A group of more than ``group_contexts`` distinct contexts (some fifty
megabytes) never meets in one task: its windows are hashed and counted by key instead, which gives the
same ranges (a test holds both ways against brute force).  Every join has a
written table on both sides, so that adaptive execution splits a hot gram.
Contexts are compared by a 64-bit hash within an equal 64-bit gram hash.

Edge cases: null and empty texts have nothing to remove; texts shorter than a
length cannot hold its repeats; matches never cross texts; overlapping copies
in one text (periodic text) count; repeated rows are copies of each other; rows
are told apart by doc_id and text together, so that one doc_id on two texts and
rows without doc_id are compared like any other; a text of any length is
handled in one row; an empty table gives no row; columns but doc_id and text are
left out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import groups_in
from .tables import materialize


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of values[i : i + width] for every i that has as many."""
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors_in(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, ahead: int):
    """Positions of the anchors, their texts, gram hashes, context hashes and bytes of context on both sides."""
    n = len(data)
    width = length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none, none, none
    up, down = K.powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(K.BYTE_VALUE[data] * up[:n], out=sums[1:])
    grams = K.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    rank = np.maximum(grams >> np.uint64(32), np.uint64(1)).astype(np.uint32)
    least = sliding(rank, width, np.minimum)
    last = np.zeros(n + 1, dtype=np.int32)  # windows that would cross the end of a text do not count
    np.add.at(last, np.maximum(offsets[1:] - length + 1, offsets[:-1]), 1)
    np.add.at(last, offsets[1:], -1)
    least[np.cumsum(last)[: len(least)] > 0] = 0
    highest = sliding(np.concatenate([np.zeros(width - 1, dtype=np.uint32), least, np.zeros(width - 1, dtype=np.uint32)]), width, np.maximum)
    at = np.flatnonzero(highest == rank)
    text = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(at - offsets[text], length - gram)
    right = np.minimum(offsets[text + 1] - at, ahead)
    context = K.mix((sums[at + right] - sums[at - left]) * down[at - left] + (left * (ahead + 1) + right).astype(np.uint64))
    return at, text, grams[at].view(np.int64), context.view(np.int64), left, right


#: A row is named by its doc_id (or a hash of its text) and a hash of its text.
KEY = ("key_a", "key_b")


def keyed_columns() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(5), "text")).alias("key_a"), F.xxhash64("text").alias("key_b")]


def anchors(docs: DataFrame, length: int, gram: int, ahead: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(batch.schema.get_field_index(k)) for k in KEY]
            for i, n, data, offsets in K.text_slices(batch):
                at, text, grams, contexts, left, right = anchors_in(data, offsets, length, gram, ahead)
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [*(k.slice(i, n).take(own) for k in names), pa.array(at - offsets[text], pa.int32()), pa.array(grams), pa.array(contexts), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
                    names=[*KEY, "at", "gram", "context", "left", "right"],
                )

    return docs.where(F.octet_length("text") >= length).mapInArrow(run, "key_a long, key_b long, at int, gram long, context long, left int, right int")


def common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of a and b, most at most."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def interval_tree(prefixes: list[int], n: int) -> list[tuple[int, int, int]]:
    """(common prefix, first row, last row) of the intervals of an array whose row i shares prefixes[i] with row i + 1."""
    out = []
    stack: list[tuple[int, int]] = []  # (prefix, first row), growing prefixes
    for i in range(n):
        here = prefixes[i] if i < n - 1 else 0
        begin = i
        while stack and stack[-1][0] > here:
            depth, begin = stack.pop()
            out.append((depth, begin, i))
        if here and (not stack or stack[-1][0] < here):
            stack.append((here, begin))
    return out


def matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    flat = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), dtype=np.uint8)
    return flat.reshape(len(values), width), sizes


def repeat_ranges(group: np.ndarray, lefts: list[bytes], rights: list[bytes], lengths: tuple[int, ...], gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of lengths, how far repeats reach to the left and right of each context's anchor (0, 0: none).

    group is sorted; lefts are reversed, so that both sides start at the anchor.
    """
    n = len(group)
    order = sorted(range(n), key=lambda i: (group[i], rights[i]))
    group = group[order]
    right, right_size = matrix([rights[i] for i in order], max(map(len, rights)))
    left, left_size = matrix([lefts[i] for i in order], max(1, *map(len, lefts)))
    rank = np.empty(n, dtype=np.int64)
    rank[sorted(range(n), key=[lefts[i] for i in order].__getitem__)] = np.arange(n)
    shared = np.zeros(n, dtype=np.int64)
    for a in range(0, n - 1, 8192):
        b = min(n - 1, a + 8192)
        shared[a:b] = np.where(group[a:b] == group[a + 1 : b + 1], common(right[a:b], right[a + 1 : b + 1], np.minimum(right_size[a:b], right_size[a + 1 : b + 1])), 0)
    tree = np.array([t for t in interval_tree(shared.tolist(), n) if t[0] >= gram], dtype=np.int64).reshape(-1, 3)
    reached = [(np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)) for _ in lengths]
    sizes = tree[:, 2] - tree[:, 1] + 1
    at = 0
    upto = np.cumsum(sizes)
    while at < len(tree):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 8192, side="right")))
        part, count = tree[at:end], sizes[at:end]
        node = np.repeat(np.arange(end - at), count)
        row = np.repeat(part[:, 1], count) + K.ragged(count)
        by_left = np.lexsort((rank[row], node))
        node, row = node[by_left], row[by_left]
        extension = np.zeros(len(row), dtype=np.int64)
        for a in range(0, len(row) - 1, 8192):
            b = min(len(row) - 1, a + 8192)
            x, y = row[a:b], row[a + 1 : b + 1]
            both = np.where(node[a:b] == node[a + 1 : b + 1], common(left[x], left[y], np.minimum(left_size[x], left_size[y])), -1)
            extension[a:b] = np.maximum(extension[a:b], both)
            extension[a + 1 : b + 1] = np.maximum(extension[a + 1 : b + 1], both)
        depth = part[:, 0][node]
        for length, (reach_left, reach_right) in zip(lengths, reached, strict=True):
            good = extension + depth >= length
            np.maximum.at(reach_left, row[good], extension[good])
            np.maximum.at(reach_right, row[good], depth[good])
        at = end
    out = [(np.empty_like(x), np.empty_like(y)) for x, y in reached]
    for mine, sorted_ones in zip(out, reached, strict=True):
        for x, y in zip(mine, sorted_ones, strict=True):
            x[order] = y
    return out


def contexts_of(texts: DataFrame, examples: DataFrame, behind: int, ahead: int) -> DataFrame:
    """gram, context, n, big and the bytes left (reversed) and right of each example's anchor."""
    wanted = examples.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "context", "n", "big", "at")).alias("wanted"))
    joined = texts.join(wanted, list(KEY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = batch.column(batch.schema.get_field_index("text"))[r].as_py().encode()
                rows = batch.column(batch.schema.get_field_index("wanted")).slice(r, 1).flatten()
                places = rows.field("at").to_pylist()
                lefts = [raw[max(0, p - behind) : p][::-1] for p in places]
                rights = [raw[p : p + ahead] for p in places]
                yield pa.RecordBatch.from_arrays([rows.field("gram"), rows.field("context"), rows.field("n"), rows.field("big"), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())], names=["gram", "context", "n", "big", "left", "right"])

    return joined.select("text", "wanted").mapInArrow(run, "gram long, context long, n long, big boolean, left binary, right binary")


REACHED = "gram long, context long, length int, reach_left int, reach_right int"


def found_in_groups(contexts: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """For each length the contexts with a repeat of it and how far it reaches, by an enhanced suffix array in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in(batches, "gram", 10_000):
            group = table.column("gram").to_numpy()
            context = table.column("context").to_numpy()
            first = np.unique(np.stack([group, context], axis=1), axis=0, return_index=True)[1]
            first.sort()
            group, context, n = group[first], context[first], table.column("n").to_numpy()[first]
            lefts, rights = table.column("left").take(first).to_pylist(), table.column("right").take(first).to_pylist()
            whole = np.array([len(a) + len(b) for a, b in zip(lefts, rights, strict=True)])
            for length, (reach_left, reach_right) in zip(lengths, repeat_ranges(group, lefts, rights, lengths, gram), strict=True):
                copied = (n > 1) & (whole >= length)
                reach_left = np.where(copied, [len(x) for x in lefts], reach_left)
                reach_right = np.where(copied, [len(x) for x in rights], reach_right)
                some = np.flatnonzero(reach_right > 0)
                columns = (group, context, np.full(len(group), length, dtype=np.int32), reach_left.astype(np.int32), reach_right.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in columns], names=["gram", "context", "length", "reach_left", "reach_right"])

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, REACHED)


def found_by_windows(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The same for groups of any size: every window of a context is hashed and counted over its group."""

    names = ["gram", "context", "n", "window", "before", "length"]

    def windows_of(row: dict) -> Iterator[list[np.ndarray]]:
        raw = row["left"][::-1] + row["right"]
        data = np.frombuffer(raw, dtype=np.uint8)
        up, down = K.powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(K.BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
        for length in lengths:
            m = min(len(data) - length, len(row["left"])) + 1  # windows that hold the anchor
            if m > 0:
                found = K.mix((sums[length : length + m] - sums[:m]) * down[:m]).view(np.int64)
                yield [*(np.full(m, row[c]) for c in names[:3]), found, (len(row["left"]) - np.arange(m)).astype(np.int32), np.full(m, length, dtype=np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [w for row in batch.slice(at, 256).to_pylist() for w in windows_of(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)

    windows = contexts.dropDuplicates(["gram", "context"]).mapInArrow(run, "gram long, context long, n long, window long, before int, length int")
    # the anchor's place in the window is part of the key: one window seen from two of its anchors is one occurrence
    key = ["gram", "window", "before", "length"]
    twice = windows.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key)
    found = windows.join(twice, key)
    return found.groupBy("gram", "context", "length").agg(F.max("before").alias("reach_left"), F.max(F.col("length") - F.col("before")).cast("int").alias("reach_right"))


def repeated_ranges(docs: DataFrame, length: int = 400, passage: int = 250, gram: int = 100, group_contexts: int = 100_000) -> DataFrame:
    """key_a, key_b and ranges (start, end, length): byte ranges that repeat, for both lengths; they may overlap."""
    texts = docs.where("text is not null").select(*keyed_columns(), "text")
    lengths = (length, passage)
    found = materialize(anchors(texts, passage, gram, length), "anchors")
    keys = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    # written, so that both sides of the joins are plain exchanges: adaptive execution splits a hot gram only then
    keys = materialize(keys.select("gram", (F.col("low") == F.col("high")).alias("same")), "repeated-keys")
    again = materialize(found.join(keys, "gram"), "repeated-anchors")
    start, end = F.col("at") - F.col("left"), F.col("at") + F.col("right")
    wide = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda x: x <= F.col("left") + F.col("right")))
    equal = again.where("same").select(*KEY, start.alias("start"), end.alias("end"), wide.alias("length"))
    unequal = again.where("not same")
    distinct = materialize(unequal.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "at")).alias("first")), "distinct-contexts")
    large = materialize(distinct.groupBy("gram").agg(F.count("*").alias("contexts")).where(F.col("contexts") > group_contexts).select("gram", F.lit(True).alias("large")), "large-groups")
    examples = distinct.join(large, "gram", "left").select("gram", "context", "n", F.coalesce("large", F.lit(False)).alias("big"), "first.*")
    contexts = materialize(contexts_of(texts, examples, passage - gram, length), "contexts")
    reached = found_in_groups(contexts.where("not big"), lengths, gram).unionByName(found_by_windows(contexts.where("big"), lengths))
    reached = materialize(reached, "reached")
    partly = unequal.join(reached, ["gram", "context"]).select(*KEY, (F.col("at") - F.col("reach_left")).alias("start"), (F.col("at") + F.col("reach_right")).alias("end"), "length")
    return equal.union(partly).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "length")).alias("ranges"))


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same places of each row in as few ranges as can be, in order."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    shift = row * (int(end.max()) + 1)  # rows do not touch
    reach = np.maximum.accumulate(end + shift)
    opens = np.append(True, (start + shift)[1:] > reach[:-1])
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], reach[last] - shift[at]


SPANS = "array<struct<start: long, end: long>>"


def remove_substrings(docs: DataFrame, length: int = 400, passage: int = 250, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges), kept (bytes left; only with_kept), its kept_sha256, and passages (byte ranges that repeat at the shorter length) with n_passage_bytes."""
    ranges = repeated_ranges(docs, length, passage)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keyed_columns(), "text")
    joined = rows.join(ranges, list(KEY), "left").select("doc_id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"), F.col("ranges.length").alias("lengths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            starts, ends, lengths = (batch.column(batch.schema.get_field_index(c)) for c in ("starts", "ends", "lengths"))
            counts = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            start, end, wide = (x.flatten().to_numpy().astype(np.int64) for x in (starts, ends, lengths))
            first = np.append(0, np.cumsum(counts))
            for i, n, data, offsets in K.text_slices(batch):
                own = slice(first[i], first[i + n])
                long = wide[own] == length
                found = []
                for some in (long, slice(None)):
                    of, a, b = merged(row[own][some] - i, start[own][some], end[own][some])
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(span)))
                    found.append((of, a, b, lists, np.bincount(of, weights=b - a, minlength=n).astype(np.int64)))
                of, a, b, spans, removed = found[0]
                marks = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(marks, a + offsets[of], 1)
                np.add.at(marks, b + offsets[of], -1)
                keep = np.cumsum(marks[:-1]) == 0
                left = memoryview(data[keep].tobytes())
                bounds = np.append(0, np.cumsum(np.diff(offsets) - removed)).tolist()
                kept = [left[x:y] for x, y in zip(bounds, bounds[1:])]
                columns = {
                    "doc_id": batch.column(batch.schema.get_field_index("doc_id")).slice(i, n), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed), "spans": spans,
                    "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "passages": found[1][3], "n_passage_bytes": pa.array(found[1][4]),
                }
                if with_kept:
                    columns["kept"] = pa.array([bytes(x) for x in kept], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"doc_id long, n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string, passages {SPANS}, n_passage_bytes long"
    done = joined.mapInArrow(run, f"{schema}, kept binary" if with_kept else schema)
    return done.withColumn("n_spans", F.size("spans").cast("long"))
