"""How the words of each source differ from those of the other sources of its language.

Terms are runs of ASCII letters and characters beyond ASCII, with only A-Z lower-cased.  A language
keeps the terms in at least `least_docs` of its documents; V is their number.  A source of a language,
and the language itself, gives a kept term with count occurrences there the share
p = 1 + floor(scale * (count + 2) / (N + 2 V)), N its occurrences of kept terms, and shares p and q
differ by floor((p - q)^2 / (p + q)).  All of it is whole numbers.

Pairs of sources: the sum over all V terms is V times the difference of the shares of an absent term
(the base), corrected where one source has the term, and again where both have it, so that only terms
that occur are joined.  Corrections against a base depend on the count alone and are summed over a
table of counts.

Top terms: radix selection.  Histograms of the next bits of the values, one row for each group and
bucket, show the bucket with each group's kth value; what is above it is taken, what is below goes,
and the next bits decide the bucket.  Rows of the kth value are refined in the same way by the next
byte of the term after the prefix they share.  No group is sorted or gathered, of whatever size.

Null text, lang and source are empty texts; a group without terms has shares all the same; repeated
rows are documents of their own, ties go by the UTF-8 bytes of the item; an empty table gives an empty
result; texts of any length are one row.  Columns beyond text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tables import materialize

GROUP = ["lang", "source"]
#: What a task counts at once: distinct (group, term) pairs held before they are handed on.
HELD_TERMS = 200_000
#: Bits of a value that one round of histograms reads: at most 2,048 buckets a group.
DIGIT_BITS = 11

#: Bytes of terms, lower-cased; all others become blanks.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), of every term that occurs."""
    inputs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = "lang string, source string, term binary, n long, docs long"

    def handed_on(groups: dict) -> pa.RecordBatch:
        rows = [(lang, source, term, n, groups[lang, source][1][term]) for (lang, source), (counts, _) in groups.items() for term, n in counts.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in GROUP)
            for i, n, data, offsets in K.text_slices(batch):
                text = data.tobytes().translate(TERM_BYTES)
                for row, a, b in zip(range(i, i + n), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    found = Counter(text[a:b].split())
                    counts, holders = groups.setdefault((langs[row], sources[row]), (Counter(), Counter()))
                    size -= len(counts)
                    counts.update(found)
                    holders.update(found.keys())
                    size += len(counts)
                    if size >= held:
                        yield handed_on(groups)
                        groups, size = {}, 0
        if size:
            yield handed_on(groups)

    parts = inputs.mapInArrow(run, schema).withColumn("term", F.col("term").cast("string"))
    return parts.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def quotient(a: Column, b: Column) -> Column:
    """a divided by b without rest, as a long."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column, scale: int) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * terms)), by decimals, as the product may pass 64 bits; without terms 1."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(terms == 0, F.lit(1).cast("long")).otherwise(quotient(F.lit(scale).cast("decimal(11,0)") * wide(count + 2), wide(F.greatest(total + 2 * terms, F.lit(1)))) + 1)


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return quotient((p - q) * (p - q), p + q)


class Shares:
    """The tables that both parts read: groups (lang, source, base, total, terms) and postings (lang, source, term, n, p, base, q)."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, scale: int = 10**9):
        if not 1 <= scale <= 10**9:
            raise ValueError("scale is at most 1,000,000,000: squares of shares are longs")
        zero = F.lit(0).cast("long")
        counts = materialize(term_counts(docs), "term-counts")
        kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("holders")).where(F.col("holders") >= least_docs).drop("holders"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
        held = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "postings")
        names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP)).distinct()
        totals = held.groupBy(*GROUP).agg(F.sum("n").alias("total"))
        groups = names.join(totals, GROUP, "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
        self.scale = scale
        self.groups = materialize(groups.withColumn("base", share(zero, F.col("total"), F.col("terms"), scale)), "groups")
        sized = held.join(self.groups, GROUP)
        self.postings = sized.select(
            *GROUP, "term", "n", "base",
            share(F.col("n"), F.col("total"), F.col("terms"), scale).alias("p"),
            share(F.col("in_lang"), F.col("lang_total"), F.col("terms"), scale).alias("q"),
        )


def salted_by_lang(left: DataFrame, groups: DataFrame, by: list[str], salts: int = 32) -> DataFrame:
    """Each row of left with every group of its language as (item, item_base), dealt over more tasks than there are languages."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(others, ["lang", "salt"]).where(F.col("source") != F.col("item")).drop("salt")


def pair_divergence(shares: Shares) -> DataFrame:
    """lang, source, item (each other source of the language) and value, the difference of their shares summed over all kept terms."""
    f = difference
    p, base, other = F.col("p"), F.col("base"), F.col("item_base")
    absent = salted_by_lang(shares.groups, shares.groups, GROUP).select(*GROUP, "item", (F.col("terms") * f(base, other)).alias("value"))
    tally = shares.postings.groupBy(*GROUP, "p", "base").agg(F.count(F.lit(1)).alias("m"))
    alone = salted_by_lang(tally, shares.groups, [*GROUP, "p"]).groupBy(*GROUP, "item").agg(F.sum(F.col("m") * (f(p, other) - f(base, other))).alias("value"))
    a = shares.postings.select("lang", "term", "source", "p", "base")
    b = shares.postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("item_p"), F.col("base").alias("item_base"))
    p2 = F.col("item_p")
    both = (
        a.join(b, ["lang", "term"])
        .where(F.col("source") < F.col("item"))
        .groupBy(*GROUP, "item")
        .agg(F.sum(f(p, p2) - f(p, other) - f(base, p2) + f(base, other)).alias("value"))
    )
    one_way = alone.unionByName(both)
    mirrored = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return absent.unionByName(one_way).unionByName(mirrored).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))


def narrowed(undecided: DataFrame, group: list[str], bucket: Column, descending: bool) -> DataFrame:
    """The rows of the buckets that each group's best `left` rows reach, marked whole where all of a bucket is among them."""
    cut = undecided.withColumn("bucket", bucket)
    order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    above = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    histogram = cut.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("left").alias("left"))
    reached = histogram.withColumn("before", F.coalesce(F.sum("rows").over(above), F.lit(0))).where(F.col("before") < F.col("left"))
    reached = reached.select(*group, "bucket", (F.col("before") + F.col("rows") <= F.col("left")).alias("whole"), (F.col("left") - F.col("before")).alias("left"))
    return materialize(cut.drop("left", "whole").join(reached, [*group, "bucket"]).drop("bucket"), "radix")


def shared_bytes(a: str, b: str) -> Column:
    """The number of bytes at the beginning in which two binary columns agree."""
    return F.expr(
        f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE coalesce(nullif(array_position(transform(sequence(1, least(length({a}), length({b}))), i -> substring({a}, i, 1) = substring({b}, i, 1)), false), 0) - 1, least(length({a}), length({b}))) END"
    ).cast("int")


def top_by_radix(rows: DataFrame, group: list[str], k: int, largest: int) -> DataFrame:
    """The k rows of each group with the greatest value (a long from 0 to largest), ties by the UTF-8 bytes of item, with rank from 1.

    Items are distinct within a group.
    """
    undecided = materialize(rows.withColumn("left", F.lit(k).cast("long")), "radix")
    taken = None
    rounds = -(-max(1, largest.bit_length()) // DIGIT_BITS)

    def decided(found: DataFrame) -> DataFrame:
        nonlocal taken
        mine = found.where("whole").drop("whole", "left")
        taken = mine if taken is None else taken.unionByName(mine)
        return found.where("NOT whole")

    for digit in reversed(range(rounds)):
        undecided = decided(narrowed(undecided, group, F.shiftright("value", digit * DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)), descending=True))
    while not undecided.isEmpty():  # equal values: the next byte after those that all of a group's rows share
        spelled = undecided.withColumn("bytes", F.col("item").cast("binary"))
        ends = spelled.groupBy(*group).agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
        skip = ends.select(*group, shared_bytes("low", "high").alias("skip"))
        cut = spelled.join(skip, group).withColumn("next_byte", F.expr("substring(bytes, skip + 1, 1)")).drop("bytes", "skip")
        undecided = decided(narrowed(cut, group, F.col("next_byte"), descending=False).drop("next_byte"))
    order = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col("item"))
    return taken.withColumn("rank", F.row_number().over(order))  # at most k rows of a group


def top_terms(shares: Shares, k: int = 10) -> DataFrame:
    """lang, source, item, value and rank of the k terms that a source uses more than its language, by the difference of the shares."""
    over = shares.postings.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    return top_by_radix(over.select(*GROUP, F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value")), GROUP, k, shares.scale + 1)


def audit(docs: DataFrame, least_docs: int = 10, k: int = 10, scale: int = 10**9) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: every other source, and the k terms most over the language's share."""
    shares = Shares(docs, least_docs, scale)
    order = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item"))
    pairs = pair_divergence(shares).withColumn("rank", F.row_number().over(order))
    marked = lambda df, part: df.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return marked(pairs, "pair").unionByName(marked(top_terms(shares, k), "term"))
