"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Every document becomes the set of its distinct word shingles, hashed by one
   function, and the sketch of the k smallest hashes.  Equal sets (compared by
   size and a 128-bit fingerprint) collapse into one representative each.
2. Inverted lists of retained values generate overlaps.  A similar pair shares
   at least ``least_shared`` of its ``keyed`` smallest values, so it shares one
   of all but the ``least_shared - 1`` most frequent of them: only those rarer
   values get lists, which spares the lists of words that everybody uses.
3. Inside a list, pairs of compatible size are judged by the estimate from
   their union sketch.  Only a spanning forest of the passing pairs leaves the
   task; its components are families.
4. Full sets of the members of families are compared exactly, and the links of
   ``similarity`` or more make the final components.

Loss: with 16 keyed values and 5 shared, a pair of larger sets, one inside the
other (the worst case), is missed with probability 1e-7 at exactly 0.85 and 3e-6
at exactly 0.8; the estimate's margin loses as little.  Where one set of a pair
has no more than 16 shingles steps 2 and 3 are exact: what its partner may hold
beyond its keyed values is taken off the bound.

Scale: lists and families are dealt by key.  A list of over ``block_rows`` or a
family of over ``block_values`` shingles is dealt into blocks of that size, each
a task with the group's hubs (a few members): whoever is similar to a hub is
joined there, and a group of copies is settled in this one round.  Where more
than one component is left, the members outside the largest one meet each other
and the largest one's blocks in pairs of blocks; members of the largest one need
not meet again.  So no group meets in one task, none is cut short, and copies
cost a few rows each, not the square of their number.  Pairs are never emitted,
only forests.  What is left quadratic is a list or family of that size whose
members are alike in value but not in content.

Edge cases: null and empty texts have no shingles and stay alone; a text of
fewer words than a shingle is one shingle; a text of any length is one row;
repeated rows and equal texts are one representative, whose component is the
smallest doc_id; representatives have numbers of their own, so that one doc_id
on several texts neither links nor multiplies them; a row without doc_id takes
the component of its equals but never names one, and always stays; ties of
hashes are broken by the number; an empty table gives no row; extra columns are
kept by ``keep_one_of_each`` and left out by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .tables import materialize


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, sign: np.uint64) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, hashes, first = K.words(data, offsets, K.SPACE)
    grams = K.ngrams(hashes, size) ^ sign
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = K.mix(K.ngrams(hashes[a:b], b - a) + np.uint64(b - a))
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketches(docs: DataFrame, shingle: int = 3, k: int = 64) -> DataFrame:
    """doc_id, tag (hash of the text), n_shingles, print_a, print_b (fingerprint of the set) and sketch (k smallest hashes, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, tags = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tag"))
            for i, n, data, offsets in K.text_slices(batch):
                sets = [(s >> np.uint64(1)).astype(np.int64) for s in shingle_sets(data, offsets, shingle, np.uint64(0))]
                sets = [s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])] for s in sets]
                prints = [(int(K.mix(s.view(np.uint64)).sum(dtype=np.uint64)), int(K.mix(s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))) for s in sets]
                a, b = (np.array([p[x] for p in prints], dtype=np.uint64).view(np.int64) for x in (0, 1))
                tops = [s[:k] for s in sets]
                bounds = np.cumsum([0, *map(len, tops)])
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, n), tags.slice(i, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), K.list_array(np.concatenate(tops), bounds, pa.int64())],
                    names=["doc_id", "tag", "n_shingles", "print_a", "print_b", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tag"), "text").mapInArrow(run, "doc_id long, tag long, n_shingles long, print_a long, print_b long, sketch array<long>")


def roots(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The smallest index reachable from each of n."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)])


def estimate(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Estimated similarity of rows of sketches (padded with the largest value) from the k smallest of their union."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    top = np.iinfo(np.int64).max
    twin = both[:, 1:] == both[:, :-1]
    real = both != top
    fresh = np.ones_like(real)
    fresh[:, 1:] = ~twin
    fresh &= real
    within = np.cumsum(fresh, axis=1) <= k
    shared = (twin & real[:, 1:] & within[:, 1:]).sum(axis=1)
    union = np.minimum(fresh.sum(axis=1), k)
    return shared / np.maximum(union, 1)


def groups_in(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000, most_bytes: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key, about rows or most_bytes at a time."""
    held: list[pa.Table] = []
    size = weight = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        held.append(table)
        size += table.num_rows
        weight += table.nbytes
        if size >= rows or weight >= most_bytes:
            whole = pa.concat_tables(held)
            keys = whole.column(key).to_numpy()
            others = np.flatnonzero(keys != keys[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield whole.slice(0, cut)
            held = [whole.slice(cut)]
            size = weight = 0  # since the last look; a group larger than that is looked at again after as many more
    if held:
        whole = pa.concat_tables(held)
        if whole.num_rows:
            yield whole


def lists_of(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    array = table.column(column).combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1]
    return array.flatten().to_numpy(), offsets - (offsets[0] if len(offsets) else 0)


#: Members of a large group that all its blocks meet.
HUBS = 4


def with_hubs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """First round: adds task.  A row goes to its block's task; the hubs of a group of several blocks (n_blocks) go to all of them."""
    block = F.pmod(F.xxhash64(member, F.lit(17)), F.col("n_blocks")).cast("long")
    some = F.array(*(F.min(F.struct(F.xxhash64(member, F.lit(k)).alias("h"), F.col(member).alias("hub")))["hub"] for k in range(HUBS)))
    hubs = rows.where("n_blocks > 1").groupBy(group).agg(F.array_distinct(some).alias("hubs"))
    hubs = materialize(hubs.select(group, F.explode("hubs").alias(member), F.lit(True).alias("__hub")), "hubs")
    marked = rows.join(hubs, [group, member], "left")
    to = F.explode(F.when(F.col("__hub"), F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).otherwise(F.array(block)))
    return marked.withColumn("__to", to).withColumn("task", F.xxhash64(group, F.lit(-1), "__to")).drop("__to", "__hub")


def in_block_pairs(rows: DataFrame, group: str, member: str, joined: DataFrame) -> DataFrame:
    """Second round, for groups of several blocks that joined (node, component) leaves apart: adds task.

    Members outside a group's largest component meet each other and that component in pairs of blocks.
    """
    many = rows.where("n_blocks > 1").join(joined.withColumnRenamed("node", member), member, "left").withColumn("component", F.coalesce("component", member))
    parts = materialize(many.groupBy(group, "component").agg(F.count("*").alias("n"), F.max("n_blocks").alias("n_blocks")), "group-parts")
    totals = parts.groupBy(group).agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"), F.max("n_blocks").alias("n_blocks")).where("all > main.n")
    share = lambda n: F.ceil(F.col("n_blocks") * n / F.col("all")).cast("long")
    totals = materialize(totals.select(group, F.col("main.component").alias("__main"), share(F.col("all") - F.col("main.n")).alias("__rest"), share(F.col("main.n")).alias("__most")), "group-blocks")
    apart = many.join(totals, group)
    inner, own = F.col("component") == F.col("__main"), F.xxhash64(member, F.lit(17))
    block = F.when(inner, F.col("__rest") + F.pmod(own, F.col("__most"))).otherwise(F.pmod(own, F.col("__rest")))
    others = F.when(inner, F.col("__rest")).otherwise(F.col("__rest") + F.col("__most"))
    spread = apart.withColumn("__block", block).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
    return spread.withColumn("task", F.xxhash64(group, F.least("__block", "__other"), F.greatest("__block", "__other"))).drop("component", "__main", "__rest", "__most", "__block", "__other")


def keyed_overlap(n: int, similarity: float, keyed: int) -> int:
    """Values that a set of n <= keyed shares at least with the keyed values of any similar set (of m values)."""
    sizes = range(math.ceil(n * similarity - 1e-9), math.floor(n / similarity + 1e-9) + 1)
    return min(math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9) - max(0, m - keyed) for m in sizes)


def families(reps: DataFrame, similarity: float, k: int, keyed: int, least_shared: int, margin: float, block_rows: int) -> DataFrame:
    """Edges (a, b) of a forest whose components hold every similar pair of representatives."""
    values = reps.select("rep", "n_shingles", F.explode(F.slice("sketch", 1, keyed)).alias("value"))
    frequent = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    have = F.least(F.col("n_shingles"), F.lit(keyed))
    place = have - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "value"))
    exact = F.array(*(F.lit(n - keyed_overlap(n, similarity, keyed) + 1) for n in range(1, keyed + 1)))
    needed = F.when(F.col("n_shingles") <= keyed, F.element_at(exact, F.least("n_shingles", F.lit(keyed)).cast("int"))).otherwise(keyed - least_shared + 1)
    rare = values.join(frequent, "value").withColumn("place", place).where(F.col("place") <= needed).select("rep", "value")
    rare = materialize(rare, "lists")
    lengths = rare.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    listed = rare.join(lengths.select("value", F.ceil(F.col("n") / block_rows).alias("n_blocks")), "value")
    held = reps.select("rep", "n_shingles", "sketch")
    top = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in(batches, "task"):
            task = table.column("task").to_numpy()
            rep = table.column("rep").to_numpy()
            n = table.column("n_shingles").to_numpy()
            flat, offsets = lists_of(table, "sketch")
            grid = np.full((len(rep), k), top, dtype=np.int64)
            sizes = np.diff(offsets)
            grid[np.repeat(np.arange(len(rep)), sizes), K.ragged(sizes)] = flat
            bounds = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
            counts = np.diff(bounds)
            edges: list[tuple[np.ndarray, np.ndarray]] = []

            def passing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                fit = np.flatnonzero((rep[left] != rep[right]) & (small >= similarity * large - 1e-9))
                found = [fit[c : c + 4096][judge(left[fit[c : c + 4096]], right[fit[c : c + 4096]])] for c in range(0, len(fit), 4096)]
                return np.concatenate(found) if found else fit

            def judge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
                whole = (n[left] <= k) & (n[right] <= k)
                return estimate(grid[left], grid[right], k) >= np.where(whole, similarity - 1e-9, similarity - margin)

            small = np.flatnonzero(counts <= 48)
            for c in range(0, len(small), 2048):  # all pairs of many small groups at once
                own_counts, own_begin = counts[small[c : c + 2048]], bounds[:-1][small[c : c + 2048]]
                member = np.repeat(own_begin, own_counts) + K.ragged(own_counts)
                after = np.repeat(own_counts, own_counts) - 1 - K.ragged(own_counts)
                left = np.repeat(member, after)
                right = left + 1 + K.ragged(after)
                good = passing(left, right)
                edges.append((rep[left[good]], rep[right[good]]))
            for g in np.flatnonzero(counts > 48):  # a large group: grow its forest, skip what is joined already
                a, b = int(bounds[g]), int(bounds[g + 1])
                label = np.arange(b - a)
                for x in range(b - a):
                    others = np.flatnonzero(label != label[x])
                    if not len(others):
                        break
                    others = others[others > x]  # earlier ones were compared with x already
                    good = others[passing(np.full(len(others), a + x), a + others)]
                    if len(good):
                        edges.append((np.full(len(good), rep[a + x]), rep[a + good]))
                        label[np.isin(label, label[good])] = label[x]
            if edges:
                left, right = (np.concatenate([e[s] for e in edges]) for s in (0, 1))
                low, high = np.minimum(left, right), np.maximum(left, right)
                pair = np.unique(np.stack([low, high], axis=1), axis=0)
                if len(pair):
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def forest(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(held, "rep").select("task", "rep", "n_shingles", "sketch")
        return rows.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")

    large = not lengths.where(F.col("n") > block_rows).isEmpty()
    if not large:
        return forest(listed.withColumn("task", F.col("value")))
    listed = materialize(listed, "listed")
    edges = materialize(forest(with_hubs(listed, "value", "rep")), "forest")
    return edges.union(forest(in_block_pairs(listed, "value", "rep", connected_components(edges))))


def exact_links(docs: DataFrame, members: DataFrame, percent: int, shingle: int, block_values: int) -> DataFrame:
    """node and component of the members (rep, doc_id, tag, n_shingles, family), over links confirmed on full sets."""
    sizes = members.groupBy("family").agg(F.sum("n_shingles").alias("n")).select("family", F.ceil(F.col("n") / block_values).alias("n_blocks"))
    wanted = members.join(sizes, "family")
    named = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    # one plan at every size: a small side is not broadcast
    texts = named.join(wanted.select("doc_id", "tag", "rep", "family", "n_blocks").hint("merge"), ["doc_id", "tag"]).select("rep", "family", "n_blocks", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, data, offsets in K.text_slices(batch):
                part = batch.slice(i, n)
                own = shingle_sets(data, offsets, shingle, np.uint64(0))
                bounds = np.cumsum([0, *map(len, own)])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in ("rep", "family", "n_blocks")), K.list_array(np.concatenate(own).view(np.int64), bounds, pa.int64())], names=["rep", "family", "n_blocks", "own"])

    full = texts.mapInArrow(sets, "rep long, family long, n_blocks long, own array<long>")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_in(batches, "task", 2000):
            task = table.column("task").to_numpy()
            rep_all = table.column("rep").to_numpy()
            flat, offsets = lists_of(table, "own")
            bounds = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rep, begin = rep_all[a:b], offsets[a : b + 1]
                n = np.diff(begin)
                _, codes = np.unique(flat[begin[0] : begin[-1]], return_inverse=True)
                begin = begin - begin[0]
                seen = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int32)
                often = np.bincount(codes, minlength=len(seen))[codes]
                shared = np.add.reduceat((often > 1).astype(np.int32), begin[:-1])
                label = np.arange(b - a)
                for x in np.argsort(-shared, kind="stable"):
                    if (label == label[x]).all():
                        break
                    mine = codes[begin[x] : begin[x + 1]]
                    seen[mine] = 1
                    common = np.add.reduceat(seen[codes], begin[:-1])
                    seen[mine] = 0
                    good = 100 * common >= percent * (n + n[x] - common)
                    if (label[good] != label[x]).any():
                        label[np.isin(label, label[good])] = label[x]
                root = np.empty(b - a, dtype=np.int64)
                for value in np.unique(label):
                    root[label == value] = rep[label == value].min()
                found.append((rep, root))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in range(2)], names=["a", "b"])

    def linked(dealt: DataFrame) -> DataFrame:
        return dealt.select("task", "rep", "own").repartition("task").sortWithinPartitions("task").mapInArrow(verify, "a long, b long")

    if sizes.where("n_blocks > 1").isEmpty():
        return linked(full.withColumn("task", F.col("family"))).select(F.col("a").alias("node"), F.col("b").alias("component"))
    full = materialize(full, "full-sets")
    links = materialize(linked(with_hubs(full, "family", "rep")), "links")
    return connected_components(links.union(linked(in_block_pairs(full, "family", "rep", connected_components(links)))))


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    shingle: int = 5,
    k: int = 64,
    keyed: int = 16,
    least_shared: int = 5,
    margin: float = 0.25,
    block_rows: int = 4096,
    block_values: int = 4_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of percent or more) for every row of docs."""
    similarity = percent / 100
    all_docs = materialize(sketches(docs, shingle, k), "sketches")
    sets = ["n_shingles", "print_a", "print_b"]
    reps = all_docs.where("n_shingles > 0 and doc_id is not null").groupBy(*sets).agg(F.min(F.struct("doc_id", "tag", "sketch")).alias("first"))
    # numbered as they are written: two sets may have one smallest doc_id
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), *sets, "first.*"), "representatives")
    forest = connected_components(families(reps, similarity, k, keyed, least_shared, margin, block_rows))
    members = reps.select("rep", "doc_id", "tag", "n_shingles").join(forest.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    linked = materialize(exact_links(docs, materialize(members, "members"), percent, shingle, block_values), "linked")
    owners = linked.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node")
    names = materialize(owners.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-names")
    named = linked.distinct().join(names, "component").select(F.col("node").alias("rep"), "component_id")
    named = reps.join(named, "rep", "left").select(*sets, F.coalesce("component_id", "doc_id").alias("component_id"))
    return all_docs.drop("sketch", "tag").join(named, sets, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates, columns unchanged."""
    found = near_duplicates(docs, percent, shingle)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = docs.join(kept, docs["doc_id"] == F.col("__kept"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))
