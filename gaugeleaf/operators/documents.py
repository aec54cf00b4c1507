"""Page and line text into structured problems, answers and revisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lines are (doc_id, page_number, line_number, text) with optional bbox_x, bbox_y, bbox_w, bbox_h.
PAGES = "array<struct<page int, image_id string, width int, height int, lines array<struct<text string, type string, text_display string, cnt array<array<double>>, line_number int>>>>"

# The x position that divides two text columns, and the circled digits of choices.
COLUMN_EDGE = 1400
CIRCLED = "①②③④⑤"


def page_lines(pages_json: DataFrame, key: str, column: str) -> DataFrame:
    """One row a line of {"pages": [...]} or a bare list; page 0 and blank lines go; diagrams use their display text."""
    wrapped = F.from_json(F.col(column), f"pages {PAGES}").getField("pages")
    pages = F.when(F.ltrim(F.col(column)).startswith("["), F.from_json(F.col(column), PAGES)).otherwise(wrapped)
    each = pages_json.select(key, F.explode(pages).alias("p")).where("p.page > 0")
    lines = each.select(key, F.col("p.page").alias("page_number"), F.posexplode("p.lines").alias("i", "l"))
    text = F.when(F.col("l.type") == "diagram", F.coalesce("l.text_display", "l.text")).otherwise(F.col("l.text"))
    box = polygon_box(F.col("l.cnt"))
    return lines.select(key, "page_number", F.coalesce("l.line_number", F.col("i") + 1).alias("line_number"), text.alias("text"), F.col("l.type").alias("line_type"), box.alias("bbox")).where(F.trim("text") != "")


def polygon_box(points: Column) -> Column:
    """(x, y, w, h) of a contour; null for fewer than two points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    return F.when(F.size(points) >= 2, box)


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Plain documents as lines of one page."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("i", "text"))
    return lines.select(key, F.lit(1).alias("page_number"), (F.col("i") + 1).alias("line_number"), "text")


def is_noise(text: Column) -> Column:
    """Blank lines, bare page numbers and running heads."""
    t = F.trim(text)
    return (t == "") | t.rlike(r"^-?\s*\d{1,3}\s*-?$") | t.rlike(r"^(?:page|p\.)\s*\d+$")


def segments(lines: DataFrame, key: str, most: int = 50) -> DataFrame:
    """Lines with segment, number and their segment's column.

    ``N.`` with N from 1 to most opens a segment (not a decimal); other numbers are body text.  What
    stands before the first number is a segment without number.  Lines on the other side of the
    column edge than the segment's first positioned line do not belong to it.
    """
    lines = lines.where(~is_noise(F.col("text")))
    number = F.regexp_extract("text", r"^\s*(\d{1,3})\.(?!\d)", 1).try_cast("int")
    order = Window.partitionBy(key).orderBy("page_number", "line_number")
    opened = lines.withColumn("number", number).withColumn("opens", F.coalesce(F.col("number").between(1, most), F.lit(False)))
    out = opened.withColumn("segment", F.sum(F.col("opens").cast("int")).over(order))
    inside = Window.partitionBy(key, "segment").orderBy("page_number", "line_number")
    out = out.withColumn("number", F.first(F.when(F.col("opens"), F.col("number")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if "bbox_x" in lines.columns:
        first_x = F.first("bbox_x", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("first_x", first_x)
        out = out.where(F.col("bbox_x").isNull() | F.col("first_x").isNull() | ((F.col("bbox_x") < COLUMN_EDGE) == (F.col("first_x") < COLUMN_EDGE))).drop("first_x")
    return out.drop("opens")


def assembled(segmented: DataFrame, key: str) -> DataFrame:
    """One row a segment: its number, pages, joined text and type."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "line_number", "text")))
    out = segmented.groupBy(key, "segment").agg(F.first("number", ignorenulls=True).alias("number"), F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"), F.count("*").alias("n_lines"), rows.alias("rows"))
    joined = out.withColumn("text", F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).drop("rows")
    choices = F.regexp_count("text", F.lit(f"[{CIRCLED}]"))
    return joined.withColumn("problem_type", F.when(choices >= 4, "multiple_choice").otherwise("short_answer"))


# The signs of a choice, in every form that scans have, and where they may stand.
CHOICE_SIGN = rf"\\(?:textcircled|circled)\{{\s*([1-5])\s*\}}|\(\s*([1-5])\s*\)|（\s*([1-5])\s*）|([{CIRCLED}])|([1-5])[.)]"
CHOICE_PLACE = re.compile(rf"(?:(?<=\s)|^)(?:{CHOICE_SIGN})", re.MULTILINE)


def split_choices(text: str | None, least: int = 4) -> tuple[str, list[str]]:
    """Stem and choices: the first signs in turn that count from one to ``least`` or five, behind a stem and with something behind each."""
    text = re.sub(r"\r\n?", "\n", text or "").strip()
    signs = list(CHOICE_PLACE.finditer(text))
    counted = "".join(str(1 + CIRCLED.find(d)) if d in CIRCLED else d for d in (next(filter(None, m.groups())) for m in signs))
    for run in re.finditer(rf"(?={'12345'[:least]}({'12345'[least:]})?)", counted):
        mine = signs[run.start() : run.start() + (5 if run[1] else least)]
        stem, ends = text[: mine[0].start()].strip(), [m.start() for m in mine[1:]] + [len(text)]
        choices = [text[m.end() : end].strip() for m, end in zip(mine, ends, strict=True)]
        if stem and all(choices):
            return stem, [re.sub(rf"^(?:{CHOICE_SIGN})\s*(?=\S)", "", c) for c in choices]
    return text, []


CHOICES = T.StructType([T.StructField("stem", T.StringType()), T.StructField("choices", T.ArrayType(T.StringType()))])


def with_choices(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds stem and choices, parsed in Arrow batches."""

    @F.pandas_udf(CHOICES)
    def parse(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_choices(v) for v in values], columns=["stem", "choices"])

    return df.withColumn("__parsed", parse(text)).withColumns({"stem": F.col("__parsed.stem"), "choices": F.col("__parsed.choices")}).drop("__parsed")


def quick_answers(text: Column) -> Column:
    """Map of number (leading zeros dropped) to answer from runs like 0001③ 0002②; the last one wins."""
    pairs = F.regexp_extract_all(text, F.lit(rf"(\d{{1,4}})\s*[{CIRCLED}]"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("k"), F.translate(F.right(p, F.lit(1)), CIRCLED, "12345").alias("v")))
    return F.aggregate(entries, F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"]))))


# Section heads of answer tables, and the word of each for the sections they open.
SECTION_HEADS = {"유제": "practice", "예제": "example", "Level 1": "level1", "Level 2": "level2", "Level 3": "level3"}


# A number and its answer; cells may run together where the answer is a choice mark.
ANSWER_CELL = rf"\d+\s*[{CIRCLED}]|\d+\s+-?\d+(?:\.\d+)?"


def answer_table(lines: DataFrame, key: str) -> DataFrame:
    """(chapter, section, number) to answer from answer pages, line by line with carried chapter and section.

    The state is the last chapter and section seen: two windows, no Python.
    """
    order = Window.partitionBy(key).orderBy("page_number", "line_number")
    section = F.lit(None).cast("string")
    for head, name in SECTION_HEADS.items():
        section = F.when(F.trim("text").startswith(head), name).otherwise(section)
    chapter = F.nullif(F.regexp_extract("text", r"^\s*(\d{2})\s+\D", 1), F.lit(""))
    marked = lines.withColumns({"__chapter": F.when(section.isNull(), chapter), "__section": section})
    carried = marked.select(key, "page_number", "line_number", "text", F.last("__chapter", ignorenulls=True).over(order).alias("chapter"), F.last("__section", ignorenulls=True).over(order).alias("section"))
    body = carried.where(F.col("section").isNotNull() & F.trim("text").rlike(r"^\d"))
    pairs = F.posexplode(F.regexp_extract_all("text", F.lit(f"({ANSWER_CELL})"), F.lit(1)))
    each = body.select(key, "chapter", "section", "page_number", "line_number", pairs.alias("nth", "pair"))
    out = each.select(key, "chapter", "section", F.regexp_extract("pair", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_extract("pair", r"^\d+\s*(\S+)$", 1).alias("answer"), "page_number", "line_number", "nth")
    last = F.max_by("answer", F.struct("page_number", "line_number", "nth"))
    return out.groupBy(key, "chapter", "section", "number").agg(last.alias("answer"))


# Confidence of an answer by where it came from.
ANSWER_CONFIDENCE = {"inline": 1.0, "quick": 0.95, "solution": 0.9, "number": 0.7}


def computed_confidence(problem_type: Column, answer: Column) -> Column:
    """Of an answer found beside a solution of the same number: higher if it looks like the problem's kind of answer."""
    given = F.coalesce(answer, F.lit("")) != ""
    choice = (problem_type == "multiple_choice") & answer.rlike(rf"^\s*(?:[{CIRCLED}]|[1-5])\s*$")
    numeric = (problem_type == "short_answer") & answer.rlike(r"^-?\d+\.?\d*$")
    return F.when(~given, 0.3).when(choice, 0.8).when(numeric, 0.7).otherwise(0.5)


def match_answers(problems: DataFrame, quick: DataFrame, solutions: DataFrame, numbers: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """problem_id, answer, source, confidence: inline before quick table before solution before bare number before what stands beside a solution.

    problems needs problem_type where beside (number, answer; the answer may be null) is given.
    """
    keys = ["chapter", "section", "number"]
    joined = (
        problems.join(quick.select(*keys, F.col("answer").alias("quick")), keys, "left")
        .join(solutions.select(*keys, F.col("answer").alias("solution")), keys, "left")
        .join(numbers.select("number", F.col("answer").alias("by_number")), "number", "left")
    )
    found = {"inline": F.col("inline_answer"), "quick": F.col("quick"), "solution": F.col("solution"), "number": F.col("by_number")}
    there = {name: value.isNotNull() for name, value in found.items()}
    trust = {name: F.lit(ANSWER_CONFIDENCE[name]) for name in found}
    if beside is not None:
        joined = joined.join(beside.select("number", F.col("answer").alias("beside"), F.lit(True).alias("is_beside")), "number", "left")
        found["beside"], there["beside"], trust["beside"] = F.col("beside"), F.col("is_beside"), computed_confidence(F.col("problem_type"), F.col("beside"))
    answer, source, confidence = (F.lit(None).cast(kind) for kind in ("string", "string", "double"))
    for name in reversed(found):
        answer = F.when(there[name], found[name]).otherwise(answer)
        source = F.when(there[name], name).otherwise(source)
        confidence = F.when(there[name], trust[name]).otherwise(confidence)
    return joined.select("problem_id", answer.alias("answer"), source.alias("source"), confidence.alias("confidence"))


# Position, points and format of the questions of an exam, by number from and to.
EXAM_RULES = (
    (1, 2, "normal", 2, "multiple_choice_5"),
    (3, 8, "normal", 3, "multiple_choice_5"),
    (9, 14, "normal", 4, "multiple_choice_5"),
    (15, 15, "semi_killer", 4, "multiple_choice_5"),
    (16, 19, "normal", 3, "short_answer"),
    (20, 20, "semi_killer", 4, "short_answer"),
    (21, 21, "killer", 4, "short_answer"),
    (22, 22, "semi_killer", 4, "short_answer"),
    (23, 23, "normal", 2, "multiple_choice_5"),
    (24, 27, "normal", 3, "multiple_choice_5"),
    (28, 28, "semi_killer", 4, "multiple_choice_5"),
    (29, 30, "killer", 4, "short_answer"),
)
# Points of the rounded difficulties one to five.
DIFFICULTY_POINTS = (2, 2, 3, 4, 4)


def question_number(raw: Column) -> Column:
    """15 of '15', '15.', 'Q15'; null for others."""
    return F.regexp_extract(F.trim(raw), r"^[Qq#]*(\d+)\.*$", 1).try_cast("int")


MOST_RULED = max(last for _, last, *_ in EXAM_RULES)


def rule_of(number: int) -> Column:
    """struct<position, points, form> of a question number, null without a rule."""
    kind = "struct<position: string, points: int, form: string>"
    found = [rule for first, last, *rule in EXAM_RULES if first <= number <= last]
    return F.struct(*map(F.lit, found[0])).cast(kind) if found else F.lit(None).cast(kind)


def apply_exam_rules(problems: DataFrame) -> DataFrame:
    """Adds position_type and point_value, fills question_format, and stores ai_answer.

    Exam problems take the rule of their number, else estimates from their difficulty, and the answer goes
    to answer_text.  Textbook problems keep no rule; their answer goes to answer_latex, as answer_text has the book's.
    """
    ruled = problems.withColumn("__rule", F.get(F.array(*map(rule_of, range(MOST_RULED + 1))), question_number(F.col("problem_number"))))
    position, points, form = (F.col(f"__rule.{name}") for name in ("position", "points", "form"))
    level = F.col("difficulty").cast("double")
    by_level = F.coalesce(F.get(F.array(*map(F.lit, DIFFICULTY_POINTS)), F.bround(level).cast("int") - 1), F.lit(3))
    place = F.when(level >= 4.5, "killer").when(level >= 3.5, "semi_killer").otherwise("normal")
    exam = ~F.col("is_textbook")
    filled = ruled.withColumns(
        {
            "position_type": F.when(exam, F.coalesce(position, place)),
            "point_value": F.when(exam, F.coalesce(points, by_level)),
            "question_format": F.when(exam, F.coalesce("question_format", form)).otherwise(F.col("question_format")),
            "answer_text": F.when(exam, F.coalesce("ai_answer", "answer_text")).otherwise(F.col("answer_text")),
            "answer_latex": F.when(~exam, F.col("ai_answer")),
        }
    )
    return filled.drop("__rule")


def with_curriculum_node(df: DataFrame, nodes: DataFrame, year: int, subject: str, unit: str, name: str) -> DataFrame:
    """Adds name: the node of that curriculum with the row's labels, null if there is none.  nodes: year, subject, unit, node_id."""
    own = nodes.where(F.col("year") == year).select(F.col("subject").alias(subject), F.col("unit").alias(unit), F.col("node_id").alias(name))
    return df.join(own, [subject, unit], "left")


# The least area of a figure, and the types of lines that are figures.
LEAST_FIGURE = 5000
FIGURE_TYPES = ("image", "figure")


def figure_boxes(lines: DataFrame, least: float = LEAST_FIGURE) -> DataFrame:
    """Boxes (x, y, w, h) of figures, with the other columns of their lines: the box of a line of a figure's type, and the image box its raw data has.

    lines: line_type, bbox_x, bbox_y, bbox_w, bbox_h, data_type and data_box (struct<x, y, w, h>, null for none).  Missing
    widths and heights are nothing; a line without a place has no box of its own, one of both kinds two.
    """
    own = F.struct(F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), F.col("bbox_w").alias("w"), F.col("bbox_h").alias("h"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = F.struct(*(zero(F.col(f"data_box.{f}")).alias(f) for f in "xywh"))
    boxes = F.array(F.when(F.col("line_type").isin(*FIGURE_TYPES) & F.col("bbox_x").isNotNull(), own), F.when((F.col("data_type") == "image") & F.col("data_box").isNotNull(), raw))
    kept = [c for c in lines.columns if c not in ("line_type", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "data_type", "data_box")]
    each = lines.select(*kept, F.explode(F.array_compact(boxes)).alias("box"))
    return each.where(zero(F.col("box.w")) * zero(F.col("box.h")) >= least).select(*kept, "box.*")


def merged_layout(current: Column, incoming: Column) -> Column:
    """struct<layout, replaced> of two layouts as JSON objects: an incoming one replaces the current, unless it is none, is equal, or is flat where the current has boxed blocks."""
    is_object = lambda c: F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))
    boxed = lambda c: F.coalesce(is_object(c) & F.get_json_object(c, "$.boxed_blocks[0]").isNotNull(), F.lit(False))
    replaced = is_object(incoming) & ~(~boxed(incoming) & boxed(current)) & ~current.eqNullSafe(incoming)
    return F.struct(F.when(replaced, incoming).otherwise(current).alias("layout"), replaced.alias("replaced"))


def with_page_image(problems: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """problems with image, that of the page (key, page_number, image) on which they start; null where there is none."""
    images = pages.select(key, F.col("page_number").alias("start_page"), "image")
    return problems.join(images, [key, "start_page"], "left")


def classified(subject: Column, allowed: list[str], units: dict[str, Column], confidence: Column) -> Column:
    """struct of subject, units and confidence: units of an unknown subject are unknown too, the confidence has three digits."""
    known = F.coalesce(subject.isin(*allowed), F.lit(False))
    return F.struct(F.when(known, subject).alias("subject"), *(F.when(known, u).alias(n) for n, u in units.items()), F.bround(confidence, 3).alias("confidence"))


def refined(subject: Column, allowed: list[str], difficulty: Column, common: list[str], confidence: Column) -> Column:
    """struct of a refined result: an unknown subject becomes the first, the difficulty stays in 1 to 5 (3 if missing) with one digit, the confidence is 0.5 if missing."""
    named = F.when(F.coalesce(subject.isin(*allowed), F.lit(False)), subject).otherwise(allowed[0])
    level = F.bround(F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(difficulty, F.lit(3.0)))), 1)
    return F.struct(named.alias("subject"), level.alias("difficulty"), named.isin(*common).alias("is_common"), F.coalesce(confidence, F.lit(0.5)).alias("confidence"))


def fingerprints(df: DataFrame, *columns: str) -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns)), 256)


def new_only(incoming: DataFrame, existing: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows whose fingerprint is neither in existing nor earlier in incoming."""
    marked = incoming.withColumn("fingerprint", fingerprints(incoming, *columns))
    known = existing.select(fingerprints(existing, *columns).alias("fingerprint")).distinct()
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))
    return marked.join(known, "fingerprint", "left_anti").withColumn("__n", first).where("__n = 1").drop("__n")


def changed_fields(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the comma-joined names of columns that differ; nulls equal nulls."""
    joined = old.select(key, *(F.col(c).alias(f"__{c}") for c in columns)).join(new.select(key, *columns), key)
    names = [F.when(~F.col(f"__{c}").eqNullSafe(F.col(c)), F.lit(c)) for c in columns]
    return joined.select(key, F.concat_ws(",", *names).alias("changed"))


def merge_partial(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with columns overwritten where new has a value."""
    joined = old.join(new.select(key, *(F.col(c).alias(f"__{c}") for c in columns)), key, "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))


# Heads and labels of boxes in a problem's text, and where its choices begin.
VIEW_HEAD = r"<\s*보\s*기\s*>|^\s*보기\s*$"
VIEW_ITEM = r"^\s*[ㄱ-ㅁ][.\s]"
CONDITION = r"^\s*\([가-마]\)"
CHOICE_START = rf"^\s*[{CIRCLED}]"


def boxed_layout(lines: DataFrame, key: str) -> DataFrame:
    """The stem of each problem as blocks in order: key, block, kind (text, view or condition), n_lines, n_columns and text.

    A view is a head with the labelled items after it, or two such items; two condition labels in a row are a
    condition box.  What comes from the first choice on is no stem.  Items of a box whose places differ by no
    more than a line's height (0.85 of the median, 18 at least) stand in one row of its grid.
    """
    order = Window.partitionBy(key).orderBy("line_number")
    kind = F.when(F.col("text").rlike(VIEW_HEAD), "head").when(F.col("text").rlike(VIEW_ITEM), "view").when(F.col("text").rlike(CONDITION), "condition").otherwise("text")
    stem = lines.withColumn("__choice", F.max(F.col("text").rlike(CHOICE_START)).over(order)).where("not __choice").withColumn("kind", kind)
    side = F.when(F.col("kind") == "head", "view").otherwise(F.col("kind"))
    runs = stem.withColumn("side", side).withColumn("__new", F.coalesce((F.lag("side").over(order) != F.col("side")) | (F.col("kind") == "head"), F.lit(True)))
    runs = runs.withColumn("run", F.count_if("__new").over(order))
    own = Window.partitionBy(key, "run")
    boxed = (F.col("side") != "text") & (F.max(F.col("kind") == "head").over(own) | (F.count("*").over(own) >= 2))
    runs = runs.withColumn("boxed", boxed)
    opens = F.coalesce((F.lag("run").over(order) != F.col("run")) & (F.col("boxed") | F.lag("boxed").over(order)), F.lit(True))
    blocks = runs.withColumn("__opens", opens).withColumn("block", F.count_if("__opens").over(order))
    item = F.col("boxed") & (F.col("kind") != "head")
    inside = Window.partitionBy(key, "block")
    height = F.greatest(F.lit(18.0), 0.85 * F.median(F.when(item, F.col("bbox_h"))).over(inside))
    placed = blocks.withColumn("__item", item).withColumn("__height", F.coalesce(height, F.lit(24.0)))
    by_place = Window.partitionBy(key, "block", "__item").orderBy("bbox_y", "line_number")
    step = F.coalesce(F.col("bbox_y") - F.lag("bbox_y").over(by_place) > F.col("__height"), F.lit(True))
    rows = placed.withColumn("__step", step).withColumn("__row", F.when(F.col("__item"), F.count_if("__step").over(by_place)))
    rows = rows.withColumn("__wide", F.when(F.col("__item"), F.count("*").over(Window.partitionBy(key, "block", "__item", "__row"))))
    made = rows.groupBy(key, "block").agg(
        F.max(F.when(F.col("boxed"), F.col("side")).otherwise("text")).alias("kind"), F.count("*").alias("n_lines"), F.coalesce(F.max("__wide"), F.lit(1)).cast("int").alias("n_columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda r: r["text"]), "\n").alias("text"),
    )
    return made


def assessment_items(xml: Column) -> Column:
    """array<struct<id, prompt, choices, answer>> of the assessmentItem elements in a document."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)(<assessmentItem\b.*?</assessmentItem>)"), F.lit(1))

    def parse(item: Column) -> Column:
        return F.struct(
            F.regexp_extract(item, r'identifier="([^"]*)"', 1).alias("id"),
            F.trim(F.regexp_replace(F.regexp_extract(item, r"(?s)<prompt>(.*?)</prompt>", 1), r"<[^>]+>", "")).alias("prompt"),
            F.regexp_extract_all(item, F.lit(r"(?s)<simpleChoice\b[^>]*>(.*?)</simpleChoice>"), F.lit(1)).alias("choices"),
            F.regexp_extract(item, r"(?s)<correctResponse>.*?<value>(.*?)</value>", 1).alias("answer"),
        )

    return F.transform(items, parse)


def as_assessment_item(id_: Column, prompt: Column, choices: Column, answer: Column) -> Column:
    from ..functions.numerics import xml_escape

    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(F.lit('<simpleChoice identifier="'), (i + 1).cast("string"), F.lit('">'), xml_escape(c), F.lit("</simpleChoice>"))), "")
    return F.concat(F.lit('<assessmentItem identifier="'), id_, F.lit('"><correctResponse><value>'), xml_escape(answer), F.lit("</value></correctResponse><prompt>"), xml_escape(prompt), F.lit("</prompt>"), listed, F.lit("</assessmentItem>"))


def as_assessment_test(title: Column, items: Column) -> Column:
    """A test document that refers to its items by identifier, in their order."""
    from ..functions.numerics import xml_escape

    listed = F.array_join(F.transform(items, lambda i: F.concat(F.lit('<assessmentItemRef identifier="'), xml_escape(i), F.lit('" href="'), xml_escape(i), F.lit('.xml"/>'))), "")
    return F.concat(F.lit('<assessmentTest title="'), xml_escape(title), F.lit('"><testPart><assessmentSection>'), listed, F.lit("</assessmentSection></testPart></assessmentTest>"))


def test_items(xml: Column) -> Column:
    """The identifiers that a test document refers to."""
    from ..functions.numerics import xml_unescape

    return F.transform(F.regexp_extract_all(xml, F.lit(r'<assessmentItemRef\b[^>]*identifier="([^"]*)"'), F.lit(1)), xml_unescape)


def revision_log(changes: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Numbered revisions with a JSON snapshot and the names of fields that changed since the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    names = [F.when(~F.lag(c).over(w).eqNullSafe(F.col(c)) & (F.row_number().over(w) > 1), F.lit(c)) for c in columns]
    return changes.select(key, F.row_number().over(w).alias("revision"), F.to_json(F.struct(*columns)).alias("snapshot"), F.concat_ws(",", *names).alias("changed"))


def batches_of(df: DataFrame, work, schema: str, partitions: int) -> DataFrame:
    """Fan-out and fan-in: rows dealt over partitions, each batch handled by work, results as one table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return df.repartition(partitions).mapInPandas(run, schema)
