"""Packing token sequences by a swap-based local search.

Documents are tokenised where they are read; only documents longer than a
sequence are cut, into full pieces, which are sequences of their own.  The
remaining pieces (their lengths, not their ids) are dealt into groups of a
bounded size by a hash of their place, so that a group fits one task whatever
the corpus.  A group starts loose: pieces are put into bins in the order they
come.  The search then takes the emptiest bin again and again and fills others
from it: it moves a piece, exchanges one for one, two for one or one for two,
choosing the change that fills the other bin most, as long as the sum of squared
fills grows.  Every underfull bin takes part; the search ends when the bins are
as few as their total length allows or no bin has an improving change left.  If
they are not as few as that, the search is made from best fit decreasing too, and
the fewer bins count.  Pieces of one length are one to it, however many there are.

Bins that are not nearly full afterwards are taken apart and packed once more
with those of other groups, in as many groups as they then need, until one group
is left, so that the groups' remainders do not add up.

Scale: lengths only are shuffled, once for the groups and then for the few
remainders.  The search holds one group.

Edge cases: a null or empty text is a piece of its end id alone; a piece longer
than the capacity cannot occur; equal lengths are taken in the order of their
place; a text of any length is cut in its row; an empty table gives no sequence;
repeated rows are packed as often as they occur; columns but doc_id and text are
left out.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import materialize
from .tokens import encoder_for, tokenizer_path

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def next_fit(lengths: list[int], capacity: int) -> list[Counter]:
    """Bins filled in the order in which the lengths come."""
    bins: list[Counter] = []
    fill = capacity
    for n in lengths:
        if fill + n > capacity:
            bins.append(Counter())
            fill = 0
        bins[-1][n] += 1
        fill += n
    return bins


def best_fit(lengths: list[int], capacity: int) -> list[Counter]:
    """Bins filled from the greatest length on, each into the bin with the least room for it."""
    bins: list[Counter] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for n in sorted(lengths, reverse=True):
        ahead = int(np.argmax(open_rooms[n:])) + n
        if open_rooms[ahead]:
            b = with_room[ahead].pop()
            open_rooms[ahead] = bool(with_room[ahead])
        else:
            b, ahead = len(bins), capacity
            bins.append(Counter())
        bins[b][n] += 1
        with_room[ahead - n].append(b)
        open_rooms[ahead - n] = True
    return bins


class Held:
    """Values of all bins end to end, in which those of one bin can be replaced."""

    def __init__(self, groups: list[np.ndarray]):
        self.sizes = np.array([len(g) for g in groups], dtype=np.int64)
        self.value, self.owner = np.concatenate([*groups, np.zeros(0, np.int64)]), np.repeat(np.arange(len(groups)), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.used = len(self.value)

    def replace(self, b: int, values: np.ndarray) -> None:
        self.owner[self.begin[b] : self.begin[b] + self.sizes[b]] = -1
        if self.used + len(values) > len(self.value):
            live = np.flatnonzero(self.owner[: self.used] >= 0)  # drop what was replaced, and make room
            value, owner = self.value[live], self.owner[live]
            order = np.argsort(owner, kind="stable")
            value, owner = value[order], owner[order]
            self.begin = np.searchsorted(owner, np.arange(len(self.sizes)))
            self.used = len(value)
            spare = max(len(values), self.used // 2 + 1024)
            self.value, self.owner = np.concatenate([value, np.zeros(spare, np.int64)]), np.concatenate([owner, np.full(spare, -1)])
        self.begin[b], self.sizes[b] = self.used, len(values)
        self.value[self.used : self.used + len(values)] = values
        self.owner[self.used : self.used + len(values)] = b
        self.used += len(values)


class Search:
    """Bins of lengths, and the changes between them; counts moves, exchanges and emptied bins.

    Pieces of one length are one: a bin knows how many it has of each.  A bin of 4,096 has 90 different
    lengths at most, whatever the number of its pieces, so that what it can give or take is short.
    """

    def __init__(self, lengths: np.ndarray, capacity: int, start: Callable = next_fit):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.bins = start(self.lengths.tolist(), capacity)
        self.fill = np.array([sum(n * c for n, c in b.items()) for b in self.bins], dtype=np.int64)
        self.singles = [np.array(sorted(b), dtype=np.int64) for b in self.bins]
        self.held = Held(self.singles)
        self.held_pairs: Held | None = None  # made when it is first asked for
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.count = {"move": 0, "one_for_one": 0, "two_for_one": 0, "one_for_two": 0, "emptied": 0}

    def put(self, given: tuple[int, ...], source: int, target: int) -> None:
        for n in given:
            self.bins[target][n] += 1
            self.bins[source][n] -= 1
            if not self.bins[source][n]:
                del self.bins[source][n]
        for b, sign in ((source, -1), (target, 1)):
            self.fill[b] += sign * sum(given)
            self.singles[b] = np.array(sorted(self.bins[b]), dtype=np.int64)
            self.held.replace(b, self.singles[b])
            if self.held_pairs:
                self.held_pairs.replace(b, self.pairs(b))

    def pairs(self, b: int) -> np.ndarray:
        """The lengths that two pieces of a bin can have together."""
        x = self.singles[b]
        i, j = np.triu_indices(len(x), 1)
        twice = x[[self.bins[b][n] > 1 for n in x.tolist()]] * 2
        return np.unique(np.concatenate([x[i] + x[j], twice]))

    def pair_of(self, b: int, total: int) -> tuple[int, int]:
        return next((n, total - n) for n in self.singles[b].tolist() if self.bins[b].get(total - n, 0) > (n == total - n))

    def offer(self, gives: np.ndarray, held: Held, low: int) -> tuple[int, int, int] | None:
        """(give, take, bin) by which another bin gains most: give - take, no more than its room, and enough to raise the sum of squares."""
        if not len(gives):
            return None
        take, owner = held.value[: held.used], held.owner[: held.used]
        near = np.flatnonzero((take < gives[-1]) & (owner >= 0))
        take, owner = take[near], owner[near]
        room = self.capacity - self.fill[owner]
        at = np.searchsorted(gives, take + room, side="right") - 1
        gain = np.where(at >= 0, gives[at], 0) - take
        gain[(gain + self.fill[owner] <= self.fill[low]) | (owner == low)] = 0
        if not len(gain) or gain.max() <= 0:
            return None
        q = int(np.argmax(gain))
        return int(gives[at[q]]), int(take[q]), int(owner[q])

    def change(self, low: int) -> bool:
        """Fills another bin from bin low, if that increases the sum of squared fills."""
        mine = self.singles[low]
        room = self.capacity - self.fill
        others = np.flatnonzero((room > 0) & (self.fill > 0))
        others = others[others != low]
        if not len(others):
            return False
        others = others[np.argsort(room[others], kind="stable")]
        at = np.searchsorted(room[others], mine)  # the fullest bin with room for each
        fits = np.flatnonzero(at < len(others))
        fits = fits[self.fill[others[at[fits]]] + mine[fits] > self.fill[low]]
        if len(fits):
            self.put((int(mine[fits[-1]]),), low, int(others[at[fits[-1]]]))
            self.count["move"] += 1
            return True
        if found := self.offer(mine, self.held, low):
            kind, give, take = "one_for_one", (found[0],), (found[1],)
        elif found := self.offer(self.pairs(low), self.held, low):
            kind, give, take = "two_for_one", self.pair_of(low, found[0]), (found[1],)
        elif found := self.offer(mine, self.all_pairs(), low):
            kind, give, take = "one_for_two", (found[0],), self.pair_of(found[2], found[1])
        else:
            return False
        self.put(give, low, found[2])
        self.put(take, found[2], low)
        self.count[kind] += 1
        return True

    def all_pairs(self) -> Held:
        if self.held_pairs is None:
            self.held_pairs = Held([self.pairs(b) for b in range(len(self.bins))])
        return self.held_pairs

    def run(self) -> list[list[int]]:
        """The bins, each a list of pieces, when no change is left or they are as few as can be."""
        used = int((self.fill > 0).sum())
        changed = True
        while changed and used > self.least:
            changed = False
            waiting = [(int(f), b) for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(waiting)
            while waiting and used > self.least:
                was, low = heapq.heappop(waiting)
                if was != self.fill[low]:
                    if self.fill[low]:
                        heapq.heappush(waiting, (int(self.fill[low]), low))
                    continue
                while self.fill[low] and self.change(low):
                    changed = True
                if not self.fill[low]:
                    used -= 1
                    self.count["emptied"] += 1
        order = np.argsort(self.lengths, kind="stable")
        first = dict(zip(*(x.tolist() for x in np.unique(self.lengths[order], return_index=True)), strict=True))
        out = []
        for b in self.bins:
            mine = []
            for n, c in b.items():
                mine += order[first[n] : first[n] + c].tolist()
                first[n] += c
            if mine:
                out.append(sorted(mine))
        return out


def fewest(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The bins of the search from a loose start, or from best fit decreasing where the first are not as few as can be and the second are fewer."""
    loose = Search(lengths, capacity)
    found = loose.run()
    if len(found) > loose.least:
        tight = Search(lengths, capacity, best_fit).run()
        found = min(found, tight, key=len)
    return found


def pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and place (task and row) of every piece of every document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for i, n, data, offsets in K.text_slices(batch):
                ids, begins = encoder.encode(data, offsets)
                ids = np.insert(ids, begins[1:], end_id).astype("<u4")
                begins = begins + np.arange(len(begins))
                sizes = np.diff(begins)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(n), counts)
                piece = K.ragged(counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begins[row] + start).tolist(), (begins[row] + start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, n).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(place + np.arange(len(row)), pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "place"],
                )
                place += len(row)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, group_pieces: int = 8192, nearly_full: float = 0.99) -> DataFrame:
    """Every piece with sequence_id and offset; at most capacity ids in a sequence, no gaps."""
    cut = materialize(pieces(docs, capacity, end_id, path), "pieces")
    result = f"{PIECE}, sequence_id long, offset long"

    def filler(level: int):
        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("place", kind="stable").reset_index(drop=True)
            lengths = pdf["length"].to_numpy()
            bins = fewest(lengths, capacity)
            order = np.concatenate([np.array(b) for b in bins])
            sizes = np.array([len(b) for b in bins])
            placed = lengths[order]
            before = np.cumsum(placed) - placed
            opening = np.cumsum(sizes) - sizes
            out = pdf.iloc[order].copy()
            # odd numbers; the full pieces' sequences have even ones
            out["sequence_id"] = 2 * ((level << 54) + (int(pdf["bucket"].iloc[0]) << 24) + np.repeat(np.arange(len(bins)), sizes)) + 1
            out["offset"] = before - np.repeat(before[opening], sizes)
            out["filled"] = np.repeat(np.add.reduceat(placed, opening), sizes)
            return out.drop(columns="bucket")

        return fill

    todo, done, level = cut.where(F.col("length") < capacity), [], 0
    n = todo.count()
    while True:
        groups = max(1, -(-n // group_pieces))
        bucket = F.pmod(F.xxhash64("place", F.lit(level)), F.lit(groups))
        packed = todo.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(filler(level), f"{result}, filled long")
        if groups == 1:
            done.append(packed)
            break
        packed = materialize(packed, "packed")
        loose = F.col("filled") < nearly_full * capacity
        n = packed.where(loose).count()
        if 2 * max(1, -(-n // group_pieces)) > groups:  # lengths that leave most bins underfull: nothing to gain from others
            done.append(packed)
            break
        done.append(packed.where(~loose))
        todo, level = packed.where(loose).drop("sequence_id", "offset", "filled"), level + 1
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": 2 * F.col("place"), "offset": F.lit(0).cast("long")})
    return functools.reduce(DataFrame.unionByName, [d.drop("filled") for d in done], full).drop("place")
