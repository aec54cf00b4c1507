"""Workbook pages with coded items, answer checks, and weakness signals of tutor messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numerics as N
from .documents import CIRCLED

# Section heads of workbooks, in order of appearance, and the words that open inline blocks.
SECTIONS = (("예제", "example"), ("유제", "practice"), ("Level 1", "level1"), ("Level 2", "level2"), ("Level 3", "level3"), ("대표기출문제", "past_exam"))
HINT_HEAD, SOLUTION_HEAD, ANSWER_HEAD = "잠깐", "풀이", "답"
END_HEADS = ("한눈에 보는 정답", "정답과 풀이")


def coded_items(lines: DataFrame, key: str) -> DataFrame:
    """One row an item: section, number, code, chapter, stem, hint, solution and answer.

    The state machine is windows: the section and chapter are the last ones seen, an item opens at a
    code or at a numbered example head, and the block of a line is the last block head in its item.
    An item without a number takes the one after the last in its chapter and section.
    """
    order = Window.partitionBy(key).orderBy("page_number", "line_number")
    text = F.trim("text")
    section = reduce(lambda out, s: F.when(text.startswith(s[0]), s[1]).otherwise(out), SECTIONS, F.lit(None).cast("string"))
    marked = lines.where(text != "").withColumns(
        {
            "head": section,
            "code": F.nullif(F.regexp_extract(text, r"^\[(\d{4,6}-\d{3,5})\]", 1), F.lit("")),
            "example": F.nullif(F.regexp_extract(text, rf"^{SECTIONS[0][0]}\s*(\d+)", 1), F.lit("")).cast("int"),
            "chapter_head": F.nullif(F.regexp_extract(text, r"^(\d{2}\s+[^\d\s].*)$", 1), F.lit("")),
            "ends": reduce(lambda out, h: out | text.startswith(h), END_HEADS, F.lit(False)),
        }
    )
    carried = marked.withColumns(
        {
            "section": F.last("head", ignorenulls=True).over(order),
            "chapter": F.last("chapter_head", ignorenulls=True).over(order),
            "stopped": F.max(F.col("ends").cast("int")).over(order),
            "opens": F.col("code").isNotNull() | F.col("example").isNotNull(),
            "closes": F.col("chapter_head").isNotNull() | (F.col("head").isNotNull() & F.col("example").isNull()),
        }
    ).where("stopped = 0")
    item = F.sum((F.col("opens") | F.col("closes")).cast("int")).over(order)
    inside = Window.partitionBy(key, "item").orderBy("page_number", "line_number")
    placed = carried.withColumn("item", item).withColumns({"in_item": F.first("opens").over(inside), "row": F.row_number().over(inside)}).where("in_item")
    stripped = F.trim("text")
    block = F.when(stripped.startswith(HINT_HEAD), "hint").when(stripped == SOLUTION_HEAD, "solution").when(stripped.rlike(rf"^{ANSWER_HEAD}\s+\S"), "answer")
    blocks = placed.withColumn("block_head", block).withColumn("block", F.coalesce(F.last("block_head", ignorenulls=True).over(inside), F.lit("stem")))
    bare = F.nullif(F.regexp_extract(stripped, r"^(\d{1,3})$", 1), F.lit("")).cast("int")
    number = F.coalesce("example", F.when((F.col("row") == 2) & (F.col("block") == "stem"), bare))
    body = F.when(F.col("example").isNotNull(), F.trim(F.regexp_replace("text", rf"^\s*{SECTIONS[0][0]}\s*\d+", ""))).otherwise(stripped)
    own = blocks.withColumns({"number": number, "body": body})
    own = own.withColumn("body", F.when(F.col("code").isNotNull() | (F.col("number").isNotNull() & F.col("example").isNull()), None).otherwise(F.col("body")))

    def joined(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when((F.col("block") == name) & F.col("block_head").isNull() & (F.col("body") != ""), F.struct("page_number", "line_number", "body"))))
        return F.nullif(F.array_join(F.transform(rows, lambda r: r["body"]), "\n"), F.lit(""))

    answer = F.max(F.when(F.col("block_head") == "answer", F.regexp_extract(stripped, rf"^{ANSWER_HEAD}\s+(.+)$", 1)))
    items = own.groupBy(key, "item").agg(
        F.first("section").alias("section"), F.first("chapter", ignorenulls=True).alias("chapter"), F.max("code").alias("code"), F.min("number").alias("given"), F.min("page_number").alias("start_page"),
        joined("stem").alias("stem"), joined("hint").alias("hint"), joined("solution").alias("solution"), answer.alias("answer"),
    )
    items = items.where("stem is not null")
    group = Window.partitionBy(key, F.substring("chapter", 1, 2), "section").orderBy("item")
    run = F.sum(F.col("given").isNotNull().cast("int")).over(group)
    in_run = Window.partitionBy(key, F.substring("chapter", 1, 2), "section", "__run").orderBy("item")
    since = F.first("given").over(in_run)
    counted = items.withColumn("__run", run).withColumn("number", F.coalesce("given", F.coalesce(since, F.lit(0)) + F.row_number().over(in_run) - since.isNotNull().cast("int")))
    return counted.drop("__run", "given")


def answer_value(x: Column) -> Column:
    """A mathematical answer without wrappers, delimiters, blanks and closing punctuation."""
    steps = ((r"\\(?:text|mathrm|operatorname|boxed)\{([^{}]+)\}", "$1"), (r"\\(?:left|right)|\$|\\[()\[\]]|[{}]|\s+|[.。,]", ""))
    return F.lower(reduce(lambda v, s: F.regexp_replace(v, *s), steps, x))


def answer_candidates(solution: Column) -> Column:
    """Answers a solution states: after the answer word, else its last formula."""
    stated = F.regexp_extract_all(solution, F.lit(r"정?답(?:은|:)?\s*\$*([^\n.$]+)"), F.lit(1))
    formulas = F.regexp_extract_all(solution, F.lit(r"\$\$?([^$\n]+)\$\$?"), F.lit(1))
    last = F.slice(formulas, F.greatest(F.size(formulas), F.lit(1)), F.lit(1))
    return F.filter(F.transform(F.when(F.size(stated) > 0, F.concat(stated, last)).otherwise(last), answer_value), lambda v: v != "")


def answer_consistent(problem_type: Column, answer: Column, choices: Column, label: Column, solution: Column) -> Column:
    """Whether answer, correct choice and solution agree; what a solution does not state cannot contradict."""
    candidates = answer_candidates(solution)
    labels = lambda x: F.regexp_extract_all(x, F.lit(f"([{CIRCLED}])"), F.lit(1))
    place = F.instr(F.lit(CIRCLED), label)
    valid = (place > 0) & (place <= F.size(choices))
    in_answer, in_solution = labels(answer), labels(solution)
    bodies = F.array(answer_value(answer), answer_value(F.translate(answer, CIRCLED, "")))
    chosen = answer_value(F.try_element_at(choices, F.greatest(place, F.lit(1))))
    says = F.exists(candidates, lambda c: F.array_contains(bodies, c) | (c == chosen)) | F.array_contains(bodies, chosen)
    choice_ok = valid & F.forall(in_answer, lambda x: x == label) & F.when(F.size(in_solution) > 0, F.array_contains(in_solution, label)).otherwise(says)
    short_ok = (F.size(candidates) == 0) | F.array_contains(candidates, answer_value(answer))
    return F.coalesce(answer != "", F.lit(False)) & F.coalesce(F.when(problem_type == "multiple_choice", choice_ok).otherwise(short_ok), F.lit(False))


def plain_table(x: Column) -> Column:
    """Cell text of a LaTeX table.  Every backslash is stripped before rows could be split at them."""
    steps = ((r"\\begin\{tabular\}\{[^}]*\}|\\end\{tabular\}|\\hline", ""), (r"\\multicolumn\{\d+\}\{[^}]*\}\{([^}]*)\}", "$1"), (r"\\mathbf\{(\d+)\}", "$1"), (r"[$\\{}]", ""), (r"&", " "), (r"\s+", " "))
    return F.trim(reduce(lambda v, s: F.regexp_replace(v, *s), steps, x))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes (x, y, w, h); null for none."""
    low = lambda f: F.array_min(F.transform(boxes, lambda b: b[f]))
    high = lambda f, s: F.array_max(F.transform(boxes, lambda b: b[f] + b[s]))
    box = F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w") - low("x")).alias("w"), (high("y", "h") - low("y")).alias("h"))
    return F.when(F.size(boxes) > 0, box)


# Kinds of error, each with the words that name it, in order of precedence.
ERROR_WORDS = (
    ("concept_gap", r"\bconcept_gap\b|개념\s*(부족|오류|이해)|정의|공식|원리|개념부터"),
    ("pattern_gap", r"\bpattern_gap\b|유형|패턴|접근\s*방법|전략|풀이\s*방향|논리"),
    ("calculation_error", r"\bcalculation_error\b|계산\s*실수|연산\s*실수|전개\s*실수|부호\s*계산|산술"),
    ("careless_mistake", r"\bcareless_mistake\b|부주의|조건을?\s*놓|잘못\s*읽|단순\s*실수|기호를?\s*빼먹"),
)
# Words of confusion, the confidence of a signal with and without an image and what is added to it for confusion, for a
# kind of error and for its name, the least and the most confidence, and the length of the evidence.
CONFUSION = r"모르겠|헷갈|어려|막혔|이해가 안|왜 안|잘 안|도와줘|힌트"
WITH_IMAGE, WITHOUT_IMAGE, FOR_CONFUSION, FOR_ERROR, FOR_NAME = 0.8, 0.38, 0.08, 0.08, 0.06
LEAST_CONFIDENCE, MOST_CONFIDENCE, EVIDENCE_LENGTH = 0.2, 0.95, 500
SIGNAL = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "problem_id", "error_type")] + [T.StructField("confidence", T.DoubleType()), T.StructField("evidence", T.StringType())])


def inferred_signal(student: Column, tutor: Column, has_image: Column) -> Column:
    """source, error_type, confidence and evidence (its beginning) of one exchange."""
    both = F.concat(F.lower(student), F.lit("\n"), F.lower(tutor))
    kind = reduce(lambda out, e: F.when(both.rlike(e[1]), e[0]).otherwise(out), reversed(ERROR_WORDS), F.lit(None).cast("string"))
    named = both.rlike("|".join(rf"\b{name}\b" for name, _ in ERROR_WORDS))
    bonus = lambda c, x: F.when(c, x).otherwise(0.0)
    confidence = F.when(has_image, WITH_IMAGE).otherwise(WITHOUT_IMAGE) + bonus(student.rlike(CONFUSION), FOR_CONFUSION) + bonus(kind.isNotNull(), FOR_ERROR) + bonus(named, FOR_NAME)
    evidence = F.substring(F.concat_ws("\n\n", F.nullif(F.trim(student), F.lit("")), F.nullif(F.trim(tutor), F.lit(""))), 1, EVIDENCE_LENGTH)
    return F.struct(F.when(has_image, "worked_solution").otherwise("tutor_message").alias("source"), kind.alias("error_type"), N.clamp(confidence, LEAST_CONFIDENCE, MOST_CONFIDENCE).alias("confidence"), evidence.alias("evidence"))


def stored_signal(metadata: Column) -> Column:
    """The signal in a message's JSON metadata if all its required fields have their types, else null."""
    v = F.try_parse_json(metadata)
    read = lambda f: F.try_variant_get(v, f"$.weaknessSignal.{f}", "string")
    typed = lambda f, kind: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.weaknessSignal.{f}", "variant")).rlike(kind), F.lit(False))
    source = read("source")
    good = source.isin("tutor_message", "worked_solution") & typed("problemId", "^STRING$") & (F.length(read("problemId")) > 0) & typed("confidence", "^(BIGINT|DECIMAL.*|DOUBLE)$") & typed("evidence", "^STRING$")
    kind = F.when(read("errorType").isin(*[n for n, _ in ERROR_WORDS]), read("errorType"))
    confidence = F.try_variant_get(v, "$.weaknessSignal.confidence", "double")
    return F.when(good, F.struct(source.alias("source"), read("problemId").alias("problem_id"), kind.alias("error_type"), confidence.alias("confidence"), read("evidence").alias("evidence")))


def normalised_choices(existing: Column, derived: Column, least: int = 4) -> Column:
    """The stored choices if there are enough, else the derived ones if those are, else none."""
    return F.when(F.size(existing) >= least, existing).when(F.size(derived) >= least, derived).otherwise(F.array().cast("array<string>"))
