"""Pages of scanned books: where contents, problems and answers begin, as windows over lines.

Lines are (book, page, line_number, text); a book's lines are one window, which its length bounds.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words and signs that tell kinds of pages and lines apart.
ANSWER_HEAD = r"^\s*(?:정답\s*(?:및|과)?\s*해설|정답\s*(?:및|과)?\s*풀이|해설|풀이|정답|해답|답|빠른\s*정답|(?i:answers?\s*(?:and)?\s*solutions?|solutions?|answers?))\s*$"
QUICK_HEAD = r"빠른\s*정답"
OVERVIEW_HEAD = r"한눈에\s*보는\s*정답"
WORD = r"[\p{L}\p{N}_]"
PAGE_REFERENCE = rf"(?i)(?<!{WORD})p\.\s*\d{{1,4}}(?!{WORD})"
ANSWER_PAIR = rf"(?<!{WORD})\d{{1,3}}\s*(?:\([1-5]\)(?={WORD})|[①②③④⑤](?!{WORD})|\d{{1,4}}(?!{WORD}))"
TABLE_HINT = r"(?i)\\begin\{tabular\}|문번|답\s*란|문제편\s*p\."
IMAGE_LINE = r"cdn\.mathpix\.com/cropped"
QUESTION_HINT = r"값은[？?]|구하시오|옳은 것을|고른 것은|최댓값|최솟값|개수|나머지|합은|적당한 것은"
CHOICE_LINE = r"^\s*(?:[①②③④⑤⑥⑦⑧⑨⑩]|\(\s*[1-5]\s*\)|（\s*[1-5]\s*）)"
HEADER_LINE = r"^\s*\d{1,4}\s*.*20\d{2}.*(?:학평|모평|수능|경찰|사관)"
# The length of a short and of a long line, how far down a page heads are looked for, and what pages look like:
# a page looks so if all limits (feature, least or most, number) of any row hold.
SHORT_LINE, LONG_LINE = 24, 40
HEAD_LINES, QUICK_LINES = 5, 10
LOOKS = {
    "is_table": (
        (("pairs", "least", 25), ("long", "most", 2)),
        (("hints", "least", 1), ("pairs", "least", 6)),
        (("references", "least", 4), ("short", "least", 6), ("long", "most", 3)),
    ),
    "is_contents": (
        (("references", "least", 6),),
        (("references", "least", 3), ("short", "least", 8)),
        (("boxes", "least", 4),),
        (("images", "least", 2), ("references", "least", 2)),
    ),
    "is_problems": (
        (("questions", "least", 1),),
        (("choices", "least", 4), ("headers", "least", 1)),
        (("headers", "least", 2),),
        (("headers", "least", 1), ("lines", "least", 2)),
    ),
}
LEAST_SECTION_PAGES = 5
ANSWERS_FROM = 0.7

# What opens a problem on the first page of a book's contents.
LABELS = "예제|유제|대표문제|확인문제|기본문제|심화문제|연습문제|문제"
STARTS = (
    ("label", rf"^\s*(?:{LABELS})\s*(\d{{1,3}})"),
    ("digits", r"^\s*(\d{3,4})\s*[.\s]"),
    ("point", r"^\s*(\d{1,3})\s*\.(?:\D|$)"),
    ("circled", r"^\s*([①②③④⑤⑥⑦⑧⑨⑩])"),
    ("bracket", r"^\s*\[(\d{1,3})\]"),
)


def hits(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("long")


def looks(name: str) -> Column:
    """Whether a page's features look like what LOOKS calls so."""
    limit = {"least": lambda feature, n: F.col(feature) >= n, "most": lambda feature, n: F.col(feature) <= n}
    rows = [functools.reduce(Column.__and__, (limit[kind](feature, n) for feature, kind, n in row)) for row in LOOKS[name]]
    return functools.reduce(Column.__or__, rows)


def page_features(lines: DataFrame, key: str) -> DataFrame:
    """What the lines of each page show, and how the page looks: as an answer table, a table of contents, a page of problems."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = lines.withColumn("text", text).where("text <> ''").withColumn("row", F.row_number().over(Window.partitionBy(key, "page").orderBy("line_number")))
    found = {"references": PAGE_REFERENCE, "pairs": ANSWER_PAIR, "boxes": "□"}
    marked = {"hints": TABLE_HINT, "questions": QUESTION_HINT, "choices": CHOICE_LINE, "headers": HEADER_LINE, "images": IMAGE_LINE}
    heads = {"answer_head": (ANSWER_HEAD, HEAD_LINES), "overview": (OVERVIEW_HEAD, HEAD_LINES), "quick": (QUICK_HEAD, QUICK_LINES)}
    counts = rows.groupBy(key, "page").agg(
        F.count("*").alias("lines"), F.count_if(F.length("text") <= SHORT_LINE).alias("short"), F.count_if(F.length("text") >= LONG_LINE).alias("long"),
        *(F.sum(hits(p)).alias(n) for n, p in found.items()), *(F.count_if(F.col("text").rlike(p)).alias(n) for n, p in marked.items()),
        *(F.max((F.col("row") <= most) & F.col("text").rlike(p)).alias(n) for n, (p, most) in heads.items()), F.max(functools.reduce(Column.__or__, (F.col("text").rlike(p) for _, p in STARTS))).alias("starts"),
    )
    return counts.withColumns({name: looks(name) for name in LOOKS})


def sections(lines: DataFrame, key: str) -> DataFrame:
    """content_start, answer_start, last_page, quick_page and has_quick of each book.

    Answers begin in the last 30 percent of the pages, at a head or an answer table, if at least five pages are left.
    """
    order = Window.partitionBy(key).orderBy("page")
    pages = page_features(lines, key).withColumns({"at": F.row_number().over(order), "pages": F.count("*").over(Window.partitionBy(key)), "last": F.max("page").over(Window.partitionBy(key))})
    late = F.col("at") > F.floor(F.col("pages") * ANSWERS_FROM)
    enough = F.col("last") - F.col("page") + 1 >= LEAST_SECTION_PAGES
    opens = late & enough & (F.col("is_table") | F.col("answer_head"))
    content = F.col("starts") & F.col("is_problems") & ~F.col("is_table") & ~F.col("is_contents")
    out = pages.groupBy(key).agg(
        F.coalesce(F.min(F.when(content, F.col("page"))), F.min("page")).alias("content_start"),
        F.min(F.when(opens, F.col("page"))).alias("answer_start"),
        F.max("last").alias("last_page"),
        F.coalesce(F.min(F.when(F.col("overview"), F.col("page"))), F.min(F.when(late & F.col("is_table"), F.col("page")))).alias("quick_page"),
        F.collect_list(F.when(F.col("quick"), F.col("page"))).alias("quick_pages"),
        F.min(F.when(opens & F.col("is_table"), F.col("page"))).alias("first_table"),
    )
    near = F.exists("quick_pages", lambda p: p.between(F.col("answer_start"), F.col("answer_start") + 3))
    quick = F.col("answer_start").isNotNull() & ((F.col("first_table") == F.col("answer_start")) | near)
    return out.withColumn("has_quick", F.coalesce(quick, F.lit(False))).drop("quick_pages", "first_table")
