"""Rule-based quality filter as a short-circuit cascade, in DataFrame functions only.

Every rule has a name and a condition over measures of the text under which it
rejects.  On a bounded random sample one job finds what each rule rejects and how
many characters, words and lines its measures go through; from these the rules are
ordered by rejection per cost: at each step the rule that rejects most of what is left
of the sample for the cost it adds, a measure that an earlier rule has read being free.
A document is dropped by the first rule
that rejects it.  The chain is one CASE expression over the measures themselves,
so that a measure is computed for a document only when a rule that needs it is
reached.  The verdict does not depend on the order.

A caller who wants the base measures for every row, rejected ones too, pays for
them once and the chain reads them (``measures=True``); the further measures stay
behind the rules before them.

Scale: one projection over the scan, no shuffle and no Python.  The sample
decides nothing but the order.

Edge cases: a null text has no words, lines or symbols; white space alone too;
both fail the base rule.  A text of any length is measured whole.  Repeated rows
get equal verdicts; rules of equal score keep the order of their names; an empty
table gives no row, and the order of the names.  Columns with the names of the
measures and verdicts are replaced, other extra columns are kept; columns named
__body, __trimmed, __words or __lines are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import materialize

# The measures' character classes and the base rule's limits.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARACTERS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 20
REPEAT_WINDOW = 8
MOST_REPEATED_PERCENT = 30
# Patterns of the further rules.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}]"
ELLIPSIS = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it.

    Plain columns would not do: a filter above a projection is pushed through it, and puts each
    column's expression in place of its name, again and again for steps that build on each other.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, size: int = REPEAT_WINDOW) -> Column:
    """Words in windows of size (a power of two) words that occur twice or more in the array."""
    none = F.lit(0).cast("long")

    def doubled(hashes: Column, step: int) -> Column:
        n = F.greatest(F.size(hashes) - step, F.lit(0))
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    def windows(hashes: Column, step: int) -> Column:
        return counted(hashes) if step == size else bound(doubled(hashes, step), lambda h: windows(h, 2 * step))

    def counted(hashes: Column) -> Column:
        # sorted (hash, place): a window that equals a neighbour occurs again
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(bound(placed, lambda p: bound(places(p), covered)))

    def places(placed: Column) -> Column:
        n = F.size(placed) - 1
        twins = F.zip_with(F.slice(placed, F.lit(1), n), F.slice(placed, F.lit(2), n), lambda p, q: F.when(p["h"] == q["h"], F.array(p["i"], q["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))

    def covered(starts: Column) -> Column:
        nexts = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
        gaps = F.zip_with(starts, nexts, lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, none, lambda n, g: n + g)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: windows(h, 1))


#: Columns that hold the text's parts while measures are computed.
PARTS = ("__body", "__trimmed", "__words", "__lines")
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def prepared(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text's parts: body, words and lines that hold a word."""
    if set(PARTS) & set(docs.columns):
        raise ValueError(f"columns named {', '.join(PARTS)} are not allowed")
    out = docs.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("__trimmed", F.btrim("__body", F.lit(WHITE_CHARACTERS)))
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "__words": F.when(F.col("__trimmed") == "", none).otherwise(F.split("__trimmed", WHITE, -1)),
            "__lines": F.filter(F.split("__body", "\n", -1), lambda s: F.btrim(s, F.lit(WHITE_CHARACTERS)) != ""),
        }
    )


def lines_with(pattern: str) -> Column:
    return F.size(F.filter("__lines", lambda s: s.rlike(pattern))).cast("long")


def measures() -> dict[str, Column]:
    """Every measure over the text's parts; the BASE ones first."""
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.concat_ws("", "__words")).cast("long"),
        "n_symbols": F.regexp_count("__body", F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
        "n_letterless": F.size(F.filter("__words", lambda w: ~w.rlike(LETTER))).cast("long"),
        "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
        "n_bullets": lines_with(BULLET),
        "n_ellipses": lines_with(ELLIPSIS),
    }


#: The measures that each rule reads.
READS = {
    "few_words": {"n_words"}, "repeated_words": {"n_repeat_words", "n_words"}, "symbols": {"n_symbols", "n_words"}, "word_length": {"word_chars", "n_words"}, "repeated_lines": {"n_dup_lines", "n_lines"},
    "letterless_words": {"n_letterless", "n_words"}, "few_distinct_words": {"n_distinct", "n_words"}, "bullet_lines": {"n_bullets", "n_lines"}, "ellipsis_lines": {"n_ellipses", "n_lines"},
}


def rules(m: Callable[[str], Column]) -> dict[str, Column]:
    """Name and rejecting condition of every rule, over measures given by name."""
    return {
        "few_words": m("n_words") < LEAST_WORDS,
        "repeated_words": 100 * m("n_repeat_words") > MOST_REPEATED_PERCENT * m("n_words"),
        "symbols": 10 * m("n_symbols") > m("n_words"),
        "word_length": (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 14 * m("n_words")),
        "repeated_lines": 100 * m("n_dup_lines") > 30 * m("n_lines"),
        "letterless_words": 100 * m("n_letterless") > 50 * m("n_words"),
        "few_distinct_words": 50 * m("n_distinct") < m("n_words"),
        "bullet_lines": 100 * m("n_bullets") > 90 * m("n_lines"),
        "ellipsis_lines": 100 * m("n_ellipses") > 30 * m("n_lines"),
    }


#: What each measure costs for a character, a word and a line, in nanoseconds of one core; only the ratios matter.
COSTS = {
    "n_words": (0, 300, 0), "word_chars": (0, 150, 0), "n_symbols": (10, 0, 0), "n_lines": (5, 0, 100), "n_dup_lines": (5, 0, 100), "n_repeat_words": (0, 2000, 0),
    "n_letterless": (0, 600, 0), "n_distinct": (0, 250, 0), "n_bullets": (2, 0, 500), "n_ellipses": (5, 0, 500),
}


def sampled(docs: DataFrame, sample_rows: int = 400, text: str = "text") -> list[tuple[dict[str, float], set[str]]]:
    """For each of about sample_rows random documents the cost of every measure and the rules that reject it."""
    share = min(1.0, sample_rows / max(1, docs.count()))  # of rows without columns: metadata alone, where docs is a table
    drawn = materialize(docs.select(text).sample(share, seed=3), "rule-sample")
    found = measures()
    size = F.struct(F.length("__body").alias("chars"), F.size("__words").alias("words"), F.size("__lines").alias("lines"))
    rejects = F.array_compact(F.array(*(F.when(c, n) for n, c in rules(found.__getitem__).items())))
    rows = prepared(drawn, text).select(size.alias("size"), rejects.alias("rejects")).collect()
    return [({n: c * r.size.chars + w * r.size.words + k * r.size.lines for n, (c, w, k) in COSTS.items()}, set(r.rejects)) for r in rows]


def ordered_rules(docs: DataFrame, sample_rows: int = 400, text: str = "text", given: tuple[str, ...] = ()) -> list[str]:
    """Rule names by what each rejects, of the sample's documents that those before it let pass, for the cost it adds; ties by name.

    A measure costs once, with the first rule that reads it, and nothing if it is given.
    """
    left, reads = sampled(docs, sample_rows, text), READS
    order, paid = [], set(given)
    while len(order) < len(reads):

        def score(rule: str) -> float:
            cost = sum(costs[m] for costs, _ in left for m in reads[rule] - paid)
            return sum(rule in rejects for _, rejects in left) / (cost + len(left) or 1)

        best = min((r for r in reads if r not in order), key=lambda r: (-score(r), r))
        order.append(best)
        paid |= reads[best]
        left = [row for row in left if best not in row[1]]
    return order


def cascade(order: list[str], conditions: dict[str, Column]) -> Column:
    """The first rule of the order that rejects, else null; a condition is evaluated only where those before it let pass."""
    chain = F.lit(None).cast("string")
    for name in reversed(order):
        chain = F.when(conditions[name], F.lit(name)).otherwise(chain)
    return chain


def verdicts(docs: DataFrame, order: list[str] | None = None, text: str = "text", measures_too: bool = True) -> DataFrame:
    """docs with rejected_by (first rule of the order that rejects, else null) and kept; with measures_too also the BASE measures and base_failed."""
    docs = docs.drop("rejected_by", "kept", *((*BASE, "base_failed") if measures_too else ()))
    order = order or ordered_rules(docs, text=text, given=BASE if measures_too else ())
    found = measures()
    out = prepared(docs, text)
    if measures_too:
        out = out.withColumns({n: found[n] for n in BASE})
        found |= {n: F.col(n) for n in BASE}
        base = rules(found.__getitem__)
        out = out.withColumn("base_failed", base["few_words"] | base["repeated_words"])
    out = out.withColumn("rejected_by", cascade(order, rules(found.__getitem__)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).drop(*PARTS)


def evaluations(judged: DataFrame, order: list[str]) -> dict[str, int]:
    """How many documents of verdicts() reached each rule of the order."""
    dropped = {r["rejected_by"]: r["count"] for r in judged.groupBy("rejected_by").count().collect()}
    left, out = sum(dropped.values()), {}
    for name in order:
        out[name] = left
        left -= dropped.get(name, 0)
    return out
