"""Problems of scanned textbooks, opened by a number or, without one, by where and how a line follows choices.

Lines are (key, page, line_number, line_type, text) with bbox_x and bbox_y where they are known.  Blank
and null lines are passed over; equal places in a book come in any order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .answers import first_of, stripped
from .documents import CIRCLED, with_choices
from .ordered import ordered_fold

# Grammar of the heads of past exam questions, their sources in order of precedence, and what a form looks like.
EXAM_HEAD = r"^(\d{1,4})(\s*(?:[★☆*✭✦✧⋆•·※]|\S{1,6}){0,4}\s*)(20\d{2})\s*(?:학년도|년)\s*(.*)$"
EXAM_ITEMS = (
    (r"^(.*?)(\d{1,2})\s*(?:번|문항)(?:\(([^)]{1,12})\))?(?:\s*([가나다라마바사]|[AB]형))?(\s*.*)$", {"body": 1, "item": 2, "audience": 3, "form": 4, "rest": 5}),
    (r"^(.*?)(\d{1,2})\s*([가나다라마바사])(\s*.*)$", {"body": 1, "item": 2, "form": 3, "rest": 4}),
)
EXAM_SOURCES = ((r"경찰\s*대?", "경찰대"), (r"사관\s*학교", "사관학교"), (r"수능", "수능"), (r"학평", "학평"), (r"모평|모의평가|교육청", "모평"))
FORM = r"([AB]형|[가나다라마바사])"

# What opens a problem, in the order it is tried, the category of each label, and what numbers a first line.
LABELS = {
    "예제": "example", "유제": "practice", "대표문제": "representative", "확인문제": "check", "기본문제": "basic", "심화문제": "advanced", "연습문제": "exercise",
    "문제": "problem", "Exercise": "exercise", "Problem": "problem", "Q": "problem",
}
LABEL = "|".join(LABELS)
MANY_CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
LABELLED, DIGITS, POINTED, RINGED, BRACKETED = rf"^({LABEL})\s*(\d{{1,3}})", r"^(\d{3,4})\s*[.\s]", r"^(\d{1,3})\s*\.(?:\D|$)", rf"^([{MANY_CIRCLED}])", r"^\[(\d{1,3})\]"
MOST_NUMBER = 2000
NUMBERED = (rf"^(?:{LABEL})\s*\d{{1,3}}\s*(.*)$", r"^\d{1,3}$", r"^\d{3,4}\s*[.\s]+\s*(.*)$", r"^\d{1,3}\s*\.(?!\d)\s*(.*)$", rf"^[{MANY_CIRCLED}]\s*(.*)$", r"^\[\d{1,3}\]\s*(.*)$")

# Heads of concepts, sections and chapters, sub-problems, choices, questions, and layout.
CONCEPT = r"(?i)^\[?\s*(?:정리|정의|공식|참고|NOTE|개념|성질|증명|보기|공식\s*정리)\s*\]?"
SECTION = r"(?i)^(?:\[?\s*유형\s*\d{1,3}|제\s*\d+\s*(?:장|단원|절)|Chapter\s*\d+|단원\s*\d+|§\s*\d+)"
CHAPTER = r"(?i)^(?:\d+\s*단원|Section\s+\d+)"
SUB_PROBLEM = r"^(?:\((\d{1,2})\)|(\d{1,2})\))\s"
CHOICE = rf"^(?:[{CIRCLED}]|[(（][1-5][)）])"
QUESTION = r"값은[？?]|구하시오|옳은 것은|고른 것은|개수는|최댓값은|최솟값은|나머지는|합은|적당한 것은"
POINTS = r"[（(]\d+\s*점[)）]"
WRITTEN = r"풀이\s*과정|서술하|서술형|설명하"
NOISE_TYPES = ("page_info", "page_header", "page_footer")
COLUMN_EDGE, FALLS_BY, RISES_BY, FULL_CHOICES = 1000, 220, 250, 4


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exam_source(text: Column) -> Column:
    """What a line like ``005 ★☆☆ 2014년 6월학평 A형 7번(고2) stem`` says of its source; null for others.

    A struct of raw, year, type (of the first source whose words it has), label, item, audience, form and rest.
    """
    part = lambda n: F.regexp_extract(text, EXAM_HEAD, n)
    blanks = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    names = ("body", "item", "audience", "form", "rest")

    def item(tail: Column) -> Column:
        groups = lambda pattern, at: F.struct(*((F.regexp_extract(tail, pattern, at[n]) if n in at else F.lit("")).alias(n) for n in names))
        found = reduce(lambda rest, p: F.when(tail.rlike(p[0]), groups(*p)).otherwise(rest), reversed(EXAM_ITEMS), F.lit(None))
        return let(found, lambda f: F.when(f.isNotNull(), let(F.struct(blanks(f["body"]).alias("body"), F.trim(f["form"]).alias("form"), F.trim(f["audience"]).alias("audience"), f["item"].alias("item"), F.trim(f["rest"]).alias("rest")), lambda g: told(tail, g))))

    def told(tail: Column, f: Column) -> Column:
        year = F.concat(part(3), F.when(text.contains("학년도"), "학년도").otherwise("년"))
        number = F.concat(f["item"], F.when(tail.rlike("번|문항"), "번").otherwise(""))
        pieces = [blanks(part(2)), year, f["body"], number, F.when(f["audience"] != "", F.concat(F.lit("("), f["audience"], F.lit(")"))), F.when(~f["body"].contains(f["form"]), f["form"])]
        given = lambda c: F.nullif(c, F.lit(""))
        rest = lambda raw: F.struct(
            raw.alias("raw"), part(3).try_cast("int").alias("year"), first_of([(raw.rlike(p), name) for p, name in EXAM_SOURCES]).alias("type"), given(f["body"]).alias("label"),
            f["item"].try_cast("int").alias("item"), given(f["audience"]).alias("audience"), F.coalesce(given(f["form"]), given(F.regexp_extract(f["body"], FORM, 1))).alias("form"), f["rest"].alias("rest"),
        )
        return let(F.array_join(F.filter(F.array(*pieces), lambda p: p != ""), " "), rest)

    return F.when(text.rlike(EXAM_HEAD), let(part(4), item))


def problem_start(text: Column, source: Column) -> Column:
    """number, display and category of the problem that a line opens, as a struct; null if it opens none."""
    at = lambda pattern, n=1: F.regexp_extract(text, pattern, n)
    none = F.lit(None).cast("string")
    made = lambda number, display, category=none: F.struct(number.cast("int").alias("number"), display.alias("display"), category.alias("category"))
    valid = lambda pattern: at(pattern).try_cast("int").between(1, MOST_NUMBER)
    label, number = at(LABELLED), lambda pattern: at(pattern).try_cast("int")
    head = F.regexp_extract(text, r"^(\d{1,4})", 1)
    return (
        F.when(source.isNotNull(), made(head.try_cast("int"), head))
        .when(label != "", made(at(LABELLED, 2).try_cast("int"), F.concat(label, F.lit(" "), at(LABELLED, 2)), first_of([(label == word, name) for word, name in LABELS.items()])))
        .when(valid(DIGITS), made(number(DIGITS), at(DIGITS)))
        .when(valid(POINTED), made(number(POINTED), F.concat(number(POINTED).cast("string"), F.lit("."))))
        .when(at(RINGED) != "", made(F.instr(F.lit(MANY_CIRCLED), at(RINGED)), at(RINGED)))
        .when(valid(BRACKETED), made(number(BRACKETED), F.concat(F.lit("["), number(BRACKETED).cast("string"), F.lit("]"))))
    )


@dataclass
class Problem:
    """The open problem: its place in the book, number and display, and what the layout shows so far."""

    place: int = 0
    number: int | None = None
    display: str | None = None
    category: str | None = None
    choices: int = 0
    x: float | None = None
    y: float | None = None


def display_after(number: int, display: str) -> str:
    """How the problem after one shown so would be shown."""
    if display.isdigit() and display.isascii():
        return str(number).zfill(len(display))
    return f"{number}." if display.endswith(".") else f"[{number}]" if display.startswith("[") else str(number)


def opened(state: Problem, number: int | None, display: str | None, category: str | None, choice: bool, asks: bool, x: float | None, y: float | None) -> tuple:
    """The place, number, display and category of the problem that a line belongs to, and whether it opens one without a number.

    Behind a problem with all its choices, a line that asks and stands in another place of the page (higher,
    well below, in the other column, or nobody knows where) is the next problem, one number on.
    """
    inferred = False
    if number is None and state.number is not None and state.choices >= FULL_CHOICES and asks:
        across = state.x is not None and x is not None and (state.x < COLUMN_EDGE) != (x < COLUMN_EDGE)
        inferred = state.y is None or y is None or y + RISES_BY < state.y or y - state.y > FALLS_BY or across
    if inferred:
        number, display, category = state.number + 1, display_after(state.number + 1, state.display), state.category
    if number is not None:
        state.place, state.number, state.display, state.category, state.choices, state.x, state.y = state.place + 1, number, display, category, 0, None, None
    if state.number is None:
        return None, None, None, None, False
    state.choices += choice
    state.x = x if state.x is None else state.x
    state.y = state.y if y is None else y
    return state.place, state.number, state.display, state.category, inferred


def problem_lines(lines: DataFrame, key: str) -> DataFrame:
    """The lines of each book's problems with place (of the problem in its book), number, display, category, inferred, sub and where chapters and sections stand.

    Lines of page furniture count only as heads.  A concept's lines are passed over until a problem or a
    chapter opens; heads of sections do not end it.
    """
    order = Window.partitionBy(key).orderBy("page", "line_number")
    boxes = {c: F.lit(None).cast("double") for c in ("bbox_x", "bbox_y") if c not in lines.columns}
    everywhere = Window.partitionBy(key)
    shown = lines.withColumns({"raw": F.col("text"), "text": stripped(), "last_page": F.max("page").over(everywhere), **boxes}).where("text <> ''")
    shown = shown.withColumn("source", exam_source(F.col("text")))
    shown = shown.withColumn("start", problem_start(F.col("text"), F.col("source")))
    section, chapter = F.col("text").rlike(SECTION), F.col("text").rlike(CHAPTER)
    furniture = F.coalesce(F.col("line_type").isin(*NOISE_TYPES), F.lit(False))
    shown = shown.where(~(furniture & F.col("start").isNull() & ~section & ~chapter) & ~F.col("text").rlike(r"^\d{1,3}$"))
    event = first_of([(F.col("text").rlike(CONCEPT), "concept"), (section, "section"), (chapter, "chapter"), (F.col("start").isNotNull(), "start")])
    shown = shown.withColumn("event", event)
    head = lambda name, w: F.last(F.when(F.col("event") == name, F.col("text")), ignorenulls=True).over(w)
    heads = {name: head(name, order) for name in ("chapter", "section")} | {f"last_{name}": head(name, order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for name in ("chapter", "section")}
    state = F.last(F.when(F.col("event") != "section", F.col("event")), ignorenulls=True).over(order)
    body = shown.withColumns({**heads, "within": state}).where("event = 'start' OR (event IS NULL AND coalesce(within, '') <> 'concept')")
    text = F.col("text")
    choice = text.rlike(CHOICE)
    given = lambda f: F.when(F.col("event") == "start", F.col(f"start.{f}"))
    body = body.withColumns({"n": given("number"), "d": given("display"), "c": given("category"), "choice": choice, "asks": ~choice & (text.rlike(QUESTION) | text.rlike(POINTS)), "x": F.col("bbox_x").cast("double"), "y": F.col("bbox_y").cast("double")})
    reads = ["n", "d", "c", "choice", "asks", "x", "y"]
    slim = body.select(key, "page", "line_number", "text", "raw", "source", "event", "chapter", "section", "last_chapter", "last_section", "last_page", *reads)
    told = ordered_fold(slim, [key], ["page", "line_number"], reads, Problem, opened, "place int, number int, display string, category string, inferred boolean")
    told = told.where("place is not null").withColumn("opens", F.col("inferred") | (F.col("event") == "start").eqNullSafe(F.lit(True))).drop(*reads, "event")
    inside = Window.partitionBy(key, "place").orderBy("page", "line_number")
    sub = F.when(~F.col("opens"), F.coalesce(*(F.nullif(F.regexp_extract("text", SUB_PROBLEM, k), F.lit("")) for k in (1, 2))))
    return told.withColumn("sub_head", sub).withColumns({"sub": F.count("sub_head").over(inside), "sub_number": F.last("sub_head", ignorenulls=True).over(inside)})


def without_number(text: Column, source: Column) -> Column:
    """A problem's first line without what numbers it."""
    rest = reduce(lambda out, p: F.when(text.rlike(p), F.regexp_extract(text, p, 1) if "(.*)" in p else F.lit("")).otherwise(out), reversed(NUMBERED), text)
    return F.when(source.isNotNull(), source["rest"]).otherwise(let(F.trim(rest), lambda r: F.coalesce(exam_source(r)["rest"], r)))


def textbook_problems(lines: DataFrame, key: str) -> DataFrame:
    """One row a problem: key, place, number, display, category, inferred, chapter and section (in force where it ends), start_page, end_page (where the next begins), lines, stem, choices, problem_type, source and subs (number and text of each)."""
    told = problem_lines(lines, key)
    first = F.min_by(F.struct("text", "source"), F.struct("page", "line_number"))
    rows = F.array_sort(F.collect_list(F.struct("page", "line_number", "raw", "sub", "sub_number", "text", "opens")))
    whole = told.groupBy(key, "place").agg(
        *(F.first(c).alias(c) for c in ("number", "display", "category")), F.max("inferred").alias("inferred"), F.min("page").alias("start_page"), F.first("last_page").alias("last_page"),
        F.count("*").alias("n_lines"), first.alias("first"), rows.alias("rows"), F.min_by(F.struct("chapter", "section"), F.struct("page", "line_number")).alias("opened_in"),
        F.first(F.struct(F.col("last_chapter").alias("chapter"), F.col("last_section").alias("section"))).alias("left_in"),
    )
    order = Window.partitionBy(key).orderBy("place")
    following = whole.withColumns({"closed": F.coalesce(F.lead("opened_in").over(order), "left_in"), "end_page": F.coalesce(F.lead("start_page").over(order), "last_page")})
    lead = without_number(F.col("first.text"), F.col("first.source"))
    rest = F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), lambda r: r["raw"])
    stem = F.when((lead == "") & (F.size("rows") == 1), F.col("rows")[0]["raw"]).otherwise(F.array_join(F.when(lead == "", rest).otherwise(F.concat(F.array(lead), rest)), "\n"))
    grouped = F.transform(F.array_distinct(F.transform(F.filter("rows", lambda r: r["sub"] > 0), lambda r: r["sub"])), lambda k: F.filter("rows", lambda r: r["sub"] == k))
    subs = F.transform(grouped, lambda g: F.struct(g[0]["sub_number"].alias("number"), F.array_join(F.transform(g, lambda r: r["raw"]), "\n").alias("text")))
    shaped = with_choices(following.withColumns({"whole": stem, "subs": subs}), "whole")
    kind = F.when(F.size("choices") > 0, "multiple_choice").when(F.exists(F.split("whole", "\n"), lambda x: F.ltrim(x).rlike(rf"^[{CIRCLED}]")), "multiple_choice").when(F.col("whole").rlike(WRITTEN), "written_solution").otherwise("short_answer")
    return shaped.select(
        key, "place", "number", "display", "category", "inferred", F.col("closed.chapter").alias("chapter"), F.col("closed.section").alias("section"), "start_page", "end_page",
        F.transform("rows", lambda r: r["raw"]).alias("lines"), "stem", "choices", kind.alias("problem_type"), F.col("first.source").alias("source"), "subs",
    )
