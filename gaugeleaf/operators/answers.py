"""Answer pages of books: overview tables, solutions, and what they give the problems of the books.

Lines are (key, page_number, line_number, line_type, text), with latex where there is any.  Chapters and
sections are the last ones seen, as windows; the numbers of solutions are a fold, as a line opens a
solution or not by the number of the one it would close.  Blank and null lines are passed over; equal
places in a book come in any order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import CIRCLED, computed_confidence
from .ordered import ordered_fold
from .workbook import plain_table

# Heads of sections in the order they are tried, words of the levels, signs of an answer
# as scanned, what a summary line and an answer consist of, and numbers a problem can have.
SECTION_HEADS = {"유제": "practice", "Level 1": "level1", "Level 2": "level2", "Level 3": "level3"}
LONG_HEADS = ("Level 1 기초 연습", "Level 2 기본 연습", "Level 3 실력 완성")
SOLUTION_HEADS = SECTION_HEADS | {"대표 기출": "past_exam", "대표기출": "past_exam"}
LEVEL_WORDS = {"기초": "level1", "기본": "level2", "실력": "level3"}
TABLE_WORDS = {"기초": "연습", "기본": "연습", "실력": "완성"}
CHAPTER_HEAD = r"^(0[1-9])\s+\S"
ANSWER_SIGN = r"^[답뎝달뎔]\s+(.+)$"
SUMMARY_LINE = rf"^[\d\s()\[\]{CIRCLED}]+$"
SKIPPED_TYPES = ("page_header", "page_footer")
REFERENCE_HEAD = "본문"
SUMMARY_NUMBER, OPENING, NUMBER_ALONE, DIGIT_TOUCHING = r"^(\d{1,2})", r"^\$?(\d{1,2})\s+(.*)$", r"^\$?(\d{1,2})$", r"^\$?(\d)(.+)$"
MOST_NUMBER = 30
LONG_CONTENT = 3
SUMMARY_TOP = 3
CONFIDENCE = {"inline": 1.0, "table and solution": 0.95, "table": 0.9, "solution": 0.7}
SKIPPED_LINE = rf"^(?:www\.|{REFERENCE_HEAD}|\\)"
WORDED_LEVEL = rf"Level\s*\d\s*({'|'.join(LEVEL_WORDS)})"
PAREN_CELL, SPACED_CELL, JOINED_CELL = r"\d{1,2}\s*\(\d\)", rf"\d{{1,2}}\s+(?:[{CIRCLED}]|\d+)", r"^(\d)(\d+)$"


def stripped(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def first_of(cases: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds; null if none."""
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def level_word(text: Column) -> Column:
    """The section of a level's word, behind a number or not."""
    bare = F.regexp_replace(text, r"^\d+\s*", "")
    return first_of([(bare.contains(word), name) for word, name in LEVEL_WORDS.items()])


def cells(text: Column) -> Column:
    """Answers in a line as array<struct<number, answer>>: ``1 (5)``, else ``1 ①`` and ``3 125``, else a run-together ``3125``."""
    paren = F.transform(F.regexp_extract_all(text, F.lit(f"({PAREN_CELL})"), F.lit(1)), lambda c: F.struct(F.regexp_extract(c, r"^(\d+)", 1).alias("number"), F.regexp_extract(c, r"(\(\d\))$", 1).alias("answer")))
    spaced = F.transform(F.regexp_extract_all(text, F.lit(f"({SPACED_CELL})"), F.lit(1)), lambda c: F.struct(F.regexp_extract(c, r"^(\d+)", 1).alias("number"), F.regexp_extract(c, r"(\S+)$", 1).alias("answer")))
    joined = F.filter(F.array(F.struct(F.regexp_extract(text, JOINED_CELL, 1).alias("number"), F.regexp_extract(text, JOINED_CELL, 2).alias("answer"))), lambda c: c["number"] != "")
    return F.when(F.size(paren) > 0, paren).when(F.size(spaced) > 0, spaced).otherwise(joined)


def overview_answers(lines: DataFrame, key: str) -> DataFrame:
    """(key, chapter, section, number) to answer from the pages that show all answers at a glance; the last one wins.

    A chapter head closes the section.  ``Level`` alone leaves the section to the word in the next line,
    which is no answer line whatever it says.  A table (LaTeX) names its section and its answers in its cells.
    """
    order = Window.partitionBy(key).orderBy("page_number", "line_number")
    shown = lines.withColumn("text", stripped()).withColumn("is_table", F.coalesce(F.col("line_type") == "table", F.lit(False)) & F.col("text").contains("\\begin{tabular}"))
    shown = shown.where((F.col("text") != "") & (F.col("is_table") | ~F.col("text").rlike(SKIPPED_LINE)))
    shown = shown.withColumn("cells_text", F.when(F.col("is_table"), plain_table(F.col("text"))).otherwise(F.col("text")))
    chapter = F.when(~F.col("is_table"), F.nullif(F.regexp_extract("text", CHAPTER_HEAD, 1), F.lit("")))
    plain = shown.withColumn("chapter_head", chapter).withColumn("alone", ~F.col("is_table") & F.col("chapter_head").isNull() & (F.col("text") == "Level"))
    # of lines in turn that all say no more than Level, every second one is the word the one before waits for
    own = Window.partitionBy(key, "is_table").orderBy("page_number", "line_number")
    counted = plain.withColumn("others", F.count_if(~F.col("alone")).over(own))
    counted = counted.withColumn("nth", F.row_number().over(Window.partitionBy(key, "is_table", "others", "alone").orderBy("page_number", "line_number")))
    waits = F.col("alone") & (F.col("nth") % 2 == 1)
    counted = counted.withColumn("waits", waits).withColumn("answers_level", ~F.col("is_table") & F.col("chapter_head").isNull() & F.coalesce(F.lag("waits").over(own), F.lit(False)))
    inside = first_of([(F.col("cells_text").contains(head), name) for head, name in reversed(SECTION_HEADS.items())])
    worded = first_of([(F.regexp_extract("cells_text", WORDED_LEVEL, 1) == word, name) for word, name in LEVEL_WORDS.items()])
    opened = first_of([(F.col("text").startswith(head), name) for head, name in SECTION_HEADS.items()])
    event = (
        F.when(F.col("is_table"), F.coalesce(worded, inside))
        .when(F.col("chapter_head").isNotNull(), "")
        .when(F.col("answers_level"), level_word(F.col("text")))
        .when(~F.col("alone"), opened)
    )
    silent = ~F.col("is_table") & (F.col("chapter_head").isNotNull() | F.col("answers_level") | F.col("alone") | F.col("text").isin(*SECTION_HEADS, *LONG_HEADS))
    marked = counted.withColumns({"event": event, "silent": silent})
    placed = marked.withColumns({"chapter": F.last("chapter_head", ignorenulls=True).over(order), "section": F.nullif(F.last("event", ignorenulls=True).over(order), F.lit(""))})
    each = placed.where(~F.col("silent") & F.col("chapter").isNotNull() & F.col("section").isNotNull()).select(key, "chapter", "section", "page_number", "line_number", F.posexplode(cells(F.col("cells_text"))).alias("nth", "cell"))
    return each.groupBy(key, "chapter", "section", F.col("cell.number").alias("number")).agg(F.max_by("cell.answer", F.struct("page_number", "line_number", "nth")).alias("answer"))


@dataclass
class Numbering:
    """The solution that lines belong to: its number, how many have been opened, and a number that waits for its line."""

    current: int | None = None
    opened: int = 0
    waiting: int | None = None


def numbered(state: Numbering, head: str | None, answers: bool, long: bool, opens: int | None, defers: int | None, loose: int | None) -> tuple[int | None, int | None]:
    """The place and number of the solution that a line belongs to.

    A head closes the solution, an answer line belongs to it and closes it.  A number opens the next one
    unless it is the number of the open one; a number with little behind it waits for the line after.
    Without an open solution, a digit with content right behind it will do.
    """
    if head:
        state.current = None
        state.waiting = None if head == "chapter" else state.waiting
        return None, None
    waited, state.waiting = state.waiting, None
    begins = None
    if waited is not None and waited != state.current and long and not answers:
        begins = waited
    elif answers:
        belongs = (state.opened, state.current) if state.current else (None, None)
        state.current = None
        return belongs
    elif opens is not None and opens != state.current:
        begins = opens
    elif defers is not None:
        state.waiting = defers
        return None, None
    elif state.current is None:
        begins = loose
    if begins is not None:
        state.current, state.opened = begins, state.opened + 1
    return (state.opened, state.current) if state.current else (None, None)


def solution_lines(lines: DataFrame, key: str) -> DataFrame:
    """The lines of the solutions of each book with chapter, section, number and solution, its place among those of the book.

    After a section head comes a summary of answers, passed over: short lines of numbers and answers
    until the numbers, once they have risen to three, fall again.
    """
    order = Window.partitionBy(key).orderBy("page_number", "line_number")
    kind = F.coalesce("line_type", F.lit(""))
    shown = lines.withColumn("text", stripped()).withColumn("answers", F.col("text").rlike(ANSWER_SIGN))
    shown = shown.where((F.col("text") != "") & ~kind.isin(*SKIPPED_TYPES) & ((kind != "page_info") | F.col("answers")))
    shown = shown.withColumn("checked", F.when(kind == "table", plain_table(F.col("text"))).otherwise(F.col("text")))
    chapter = F.nullif(F.regexp_extract("text", CHAPTER_HEAD, 1), F.lit(""))
    shown = shown.withColumn("chapter_head", chapter).withColumn("alone", F.col("chapter_head").isNull() & (F.col("text") == "Level"))
    after_level = F.coalesce(F.lag("alone").over(order), F.lit(False))
    labelled = first_of([(F.col("checked").contains(head), name) for head, name in SOLUTION_HEADS.items()])
    garbled = first_of([((kind == "table") & F.col("checked").contains(word) & F.col("checked").contains(TABLE_WORDS[word]), name) for word, name in LEVEL_WORDS.items()])
    section = F.coalesce(F.when(after_level, level_word(F.col("text"))), F.when(~F.col("alone"), F.coalesce(labelled, garbled)))
    shown = shown.withColumn("section_head", F.when(F.col("chapter_head").isNull(), section))
    shown = shown.withColumn("head", F.when(F.col("chapter_head").isNotNull(), "chapter").when(F.col("section_head").isNotNull(), "section"))
    placed = shown.withColumns(
        {
            "chapter": F.last("chapter_head", ignorenulls=True).over(order),
            "section": F.nullif(F.last(F.when(F.col("head") == "chapter", "").otherwise(F.col("section_head")), ignorenulls=True).over(order), F.lit("")),
            "part": F.count_if(F.col("head").isNotNull()).over(order),
        }
    ).where(F.col("head").isNotNull() | (~F.col("alone") & F.col("chapter").isNotNull() & F.col("section").isNotNull()))
    body = F.col("head").isNull()
    inside = Window.partitionBy(key, "part").orderBy("page_number", "line_number")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    short = body & F.col("text").rlike(SUMMARY_LINE)
    first = F.when(short, F.regexp_extract("text", SUMMARY_NUMBER, 1).try_cast("int"))
    summed = placed.withColumn("first", first).withColumn("top", F.coalesce(F.max("first").over(before), F.lit(0)))
    falls = (F.col("top") >= SUMMARY_TOP) & (F.col("first") < F.col("top"))
    summary = (short & ~F.coalesce(falls, F.lit(False))) | F.col("text").startswith(REFERENCE_HEAD)
    kept = summed.withColumn("begun", F.max(body & ~summary).over(inside)).where(~body | F.col("begun"))

    number, behind = F.regexp_extract("text", OPENING, 1).try_cast("int"), F.regexp_extract("text", OPENING, 2)
    alone = F.regexp_extract("text", NUMBER_ALONE, 1).try_cast("int")
    digit, touching = F.regexp_extract("text", DIGIT_TOUCHING, 1).try_cast("int"), F.regexp_extract("text", DIGIT_TOUCHING, 2)
    can = lambda n: F.when(n.between(1, MOST_NUMBER), n)
    much = F.length(behind) > LONG_CONTENT
    shaped = kept.withColumns(
        {
            "long": F.length("text") > LONG_CONTENT,
            "opens": can(F.when(much, number)),
            "defers": F.coalesce(can(F.when(~much, number)), can(alone)),
            "loose": can(F.when(F.length(touching) > LONG_CONTENT, digit)),
        }
    )
    slim = [key, "page_number", "line_number", "text", "answers", "long", "opens", "defers", "loose", "head", "chapter", "section", *(["latex"] if "latex" in lines.columns else [])]
    return ordered_fold(shaped.select(*slim), [key], ["page_number", "line_number"], ["head", "answers", "long", "opens", "defers", "loose"], Numbering, numbered, "solution int, number int").where("number is not null").drop("head", "long", "opens", "defers", "loose")


def book_solutions(lines: DataFrame, key: str) -> DataFrame:
    """key, chapter, section, number (as text), solution (text), latex, answer (the last stated, without blanks), n_lines and place (of the number's first solution in its book).

    Of solutions of one number in a section the last counts; one that is an answer line alone does not.
    """
    told = solution_lines(lines, key)
    latex = F.coalesce("latex", "text") if "latex" in told.columns else F.col("text")
    rows = F.array_sort(F.collect_list(F.struct("page_number", "line_number", "text", latex.alias("latex"), "answers")))
    whole = told.groupBy(key, "solution").agg(F.first("chapter").alias("chapter"), F.first("section").alias("section"), F.first("number").cast("string").alias("number"), F.max(~F.col("answers")).alias("worked"), rows.alias("rows")).where("worked")
    same = Window.partitionBy(key, "chapter", "section", "number")
    only = whole.withColumns({"nth": F.row_number().over(same.orderBy(F.col("solution").desc())), "place": F.min("solution").over(same)}).where("nth = 1")
    joined = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "\n")
    stated = F.try_element_at(F.filter("rows", lambda r: r["answers"]), F.lit(-1))["text"]
    answer = F.nullif(F.replace(F.regexp_extract(stated, ANSWER_SIGN, 1), F.lit(" "), F.lit("")), F.lit(""))
    return only.select(key, "chapter", "section", "number", joined("text").alias("solution"), joined("latex").alias("latex"), answer.alias("answer"), F.size("rows").alias("n_lines"), "place")


def in_section_of_answer(solutions: DataFrame, overview: DataFrame, key: str) -> DataFrame:
    """Solutions under the section whose overview answer they state, if their own section's is another.

    Two columns of a page are scanned one after the other, so that solutions come to stand before the head
    of their section.  They move to the first section with their answer that has no solution of the
    number; of several that move to one place the last in the book counts.
    """
    keys = [key, "chapter", "section", "number"]
    plain = lambda c: F.replace(F.trim(c), F.lit(" "), F.lit(""))
    found = F.regexp_extract_all("solution", F.lit(r"(?m)[답뎝달뎔][^\S\n]+(.+)$"), F.lit(1))
    told = solutions.withColumn("stated", plain(F.try_element_at(found, F.lit(-1))))
    wrong = told.join(overview.select(*keys, plain(F.col("answer")).alias("expected")), keys).where("stated <> expected").select(*keys, "stated")
    free = overview.join(solutions.select(*keys), keys, "left_anti").select(key, "chapter", F.col("section").alias("other"), "number", plain(F.col("answer")).alias("stated"))
    rank = F.array_position(F.array(*(F.lit(name) for name in dict.fromkeys(SOLUTION_HEADS.values()))), F.col("other"))
    moves = wrong.join(free, [key, "chapter", "number", "stated"]).where("other <> section").groupBy(*keys).agg(F.min_by("other", rank).alias("other"))
    moved = solutions.join(moves, keys, "left").withColumn("section", F.coalesce("other", "section")).drop("other")
    return moved.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("place").desc()))).where("nth = 1").drop("nth")


def match_book_answers(problems: DataFrame, key: str, overview: DataFrame, solutions: DataFrame, quick: DataFrame, entries: DataFrame, answered: DataFrame) -> DataFrame:
    """problem_id, answer, solution, status and confidence of the problems of books.

    problems: key, problem_id, chapter (its number begins it), section, local_number, problem_number, problem_type, inline_answer, inline_solution.
    What stands beside a problem comes first.  In books with an overview, the overview, with the solution
    of the same chapter, section and number, else that solution without an answer.  In other books the quick
    table (key, number, answer) and the numbered entries (key, number, answer, solution).  answered: the keys
    of books that have answer pages at all.
    """
    place = [key, "chapter_no", "section", "local_number"]
    own = lambda df, *columns: df.select(key, F.col("chapter").alias("chapter_no"), "section", F.col("number").alias("local_number"), *columns)
    flagged = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = (
        problems.withColumn("chapter_no", F.substring(F.coalesce("chapter", F.lit("")), 1, 2))
        .join(own(overview, F.col("answer").alias("shown")), place, "left")
        .join(own(solutions, F.col("solution").alias("worked")), place, "left")
        .join(quick.select(key, F.col("number").alias("problem_number"), F.col("answer").alias("quick")), [key, "problem_number"], "left")
        .join(entries.select(key, F.col("number").alias("problem_number"), F.col("answer").alias("entry"), F.col("solution").alias("entry_solution"), F.lit(True).alias("has_entry")), [key, "problem_number"], "left")
        .join(flagged(overview, "has_overview"), key, "left")
        .join(flagged(answered, "has_answers"), key, "left")
    )
    inline = F.coalesce(F.col("inline_answer") != "", F.lit(False))
    has = lambda c: F.col(c).isNotNull()
    number_answer = F.coalesce(F.nullif("quick", F.lit("")), "entry")
    by_number = F.coalesce(number_answer != "", F.lit(False)) | has("has_entry")
    case = (
        F.when(inline, "inline")
        .when(has("has_overview") & has("shown") & has("worked"), "table and solution")
        .when(has("has_overview") & has("shown"), "table")
        .when(has("has_overview") & has("worked"), "solution")
        .when(has("has_overview"), "unmatched")
        .when(~has("has_answers"), "no_answer_key")
        .when(by_number, "number")
        .otherwise("unmatched")
    )
    told = joined.withColumn("case", case)
    by = lambda names, value, rest: F.when(F.col("case").isin(*names), value).otherwise(rest)
    nothing = F.lit(None).cast("string")
    answer = by(["inline"], F.col("inline_answer"), by(["table and solution", "table"], F.col("shown"), by(["number"], number_answer, nothing)))
    solution = by(["inline"], F.col("inline_solution"), by(["table and solution", "solution"], F.col("worked"), by(["number"], F.col("entry_solution"), nothing)))
    known = reduce(lambda rest, c: F.when(F.col("case") == c[0], c[1]).otherwise(rest), CONFIDENCE.items(), F.lit(0.0))
    status = F.when(F.col("case").isin("inline", "unmatched", "no_answer_key"), F.col("case")).otherwise("matched")
    return told.select("problem_id", answer.alias("answer"), solution.alias("solution"), status.alias("status"), F.when(F.col("case") == "number", computed_confidence(F.col("problem_type"), number_answer)).otherwise(known).alias("confidence"))
