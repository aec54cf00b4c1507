"""Workbook items, answer checks and weakness signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import documents as D
from ..operators import workbook as B
from ..sources.domain import Tables
from .registry import query


@query("I6_coded_items", """SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY problem_id) AS INTEGER) AS number, 'practice' AS section, lpad(CAST(problem_id AS VARCHAR), 5, '0') || '-0001' AS code, stem, CASE WHEN difficulty > 3 THEN CAST(difficulty AS VARCHAR) END AS answer FROM problems""")
def i6(t: Tables):
    code = F.concat(F.lit("["), F.lpad(F.col("problem_id").cast("string"), 5, "0"), F.lit("-0001]"))
    answer = F.when(F.col("difficulty") > 3, F.concat(F.lit("답 "), F.col("difficulty").cast("string"))).otherwise("")
    parts = t.problems.select("subject", "problem_id", F.posexplode(F.array(code, F.col("stem"), answer)).alias("i", "text"))
    head = t.problems.select("subject").distinct().select("subject", F.lit(-1).alias("problem_id"), F.lit(0).alias("i"), F.lit("유제").alias("text"))
    lines = head.unionByName(parts).select("subject", F.lit(1).alias("page_number"), (F.col("problem_id") * 3 + F.col("i")).alias("line_number"), "text")
    return B.coded_items(lines, "subject").select("subject", "number", "section", "code", "stem", "answer")


HEAD = "CASE " + " ".join(f"WHEN starts_with(t, '{word}') THEN '{name}'" for word, name in B.SECTIONS) + " END"
BLOCK = f"CASE WHEN starts_with(t, '{B.HINT_HEAD}') THEN 'hint' WHEN t = '{B.SOLUTION_HEAD}' THEN 'solution' WHEN regexp_matches(t, '^{B.ANSWER_HEAD}\\s+\\S') THEN 'answer' END"
PART = lambda name: f"nullif(string_agg(CASE WHEN block = '{name}' AND opened IS NULL AND body <> '' THEN body END, chr(10) ORDER BY rn), '') AS {name}"


@query("I6_workbook_items", rf"""WITH l AS (SELECT *, trim(text) AS t, row_number() OVER (PARTITION BY book ORDER BY page_number, line_number) AS rn FROM workbook_lines WHERE trim(text) <> ''),
  m AS (SELECT *, {HEAD} AS head, nullif(regexp_extract(t, '^\[(\d{{4,6}}-\d{{3,5}})\]', 1), '') AS code, TRY_CAST(regexp_extract(t, '^예제\s*(\d+)', 1) AS INTEGER) AS example, nullif(regexp_extract(t, '^(\d{{2}}\s+[^\d\s].*)$', 1), '') AS chapter_head FROM l),
  c AS (SELECT *, last_value(head IGNORE NULLS) OVER w AS section, last_value(chapter_head IGNORE NULLS) OVER w AS chapter, bool_or(starts_with(t, '한눈에 보는 정답') OR starts_with(t, '정답과 풀이')) OVER w AS stopped, code IS NOT NULL OR example IS NOT NULL AS opens FROM m WINDOW w AS (PARTITION BY book ORDER BY rn)),
  i AS (SELECT *, count(*) FILTER (WHERE opens OR chapter_head IS NOT NULL OR head IS NOT NULL) OVER (PARTITION BY book ORDER BY rn) AS item FROM c WHERE NOT stopped),
  b AS (SELECT *, {BLOCK} AS opened, first_value(opens) OVER w AS inside, row_number() OVER w AS nth FROM i WINDOW w AS (PARTITION BY book, item ORDER BY rn)),
  d AS (SELECT *, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY book, item ORDER BY rn), 'stem') AS block FROM b WHERE inside),
  e AS (SELECT *, coalesce(example, CASE WHEN nth = 2 AND block = 'stem' THEN TRY_CAST(regexp_extract(t, '^(\d{{1,3}})$', 1) AS INTEGER) END) AS number FROM d),
  f AS (SELECT *, CASE WHEN code IS NOT NULL OR (number IS NOT NULL AND example IS NULL) THEN NULL WHEN example IS NOT NULL THEN trim(regexp_replace(text, '^\s*예제\s*\d+', '')) ELSE t END AS body FROM e),
  g AS (SELECT book, item, arg_min(section, rn) AS section, arg_min(chapter, rn) FILTER (WHERE chapter IS NOT NULL) AS chapter, max(code) AS code, min(number) AS given, min(page_number) AS start_page, {PART("stem")}, {PART("hint")}, {PART("solution")}, max(CASE WHEN opened = 'answer' THEN regexp_extract(t, '^답\s+(.+)$', 1) END) AS answer FROM f GROUP BY 1, 2),
  r AS (SELECT *, count(given) OVER (PARTITION BY book, chapter[:2], section ORDER BY item) AS run FROM g WHERE stem IS NOT NULL),
  s AS (SELECT *, first_value(given) OVER w AS since, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY book, chapter[:2], section, run ORDER BY item))
  SELECT book, section, chapter, code, CAST(coalesce(given, coalesce(since, 0) + k - CASE WHEN since IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS number, start_page, stem, hint, solution, answer FROM s""")
def i6_items(t: Tables):
    return B.coded_items(t.workbook_lines, "book").select("book", "section", "chapter", "code", F.col("number").cast("int").alias("number"), "start_page", "stem", "hint", "solution", "answer")


HEIGHT = "greatest(18.0, 0.85 * median(bbox_h) FILTER (WHERE boxed AND kind <> 'head') OVER (PARTITION BY problem_id, block))"


@query("I9_boxed_layout", f"""WITH c AS (SELECT *, bool_or(regexp_matches(text, '{D.CHOICE_START}')) OVER (PARTITION BY problem_id ORDER BY line_number) AS choices FROM stem_lines),
  k AS (SELECT *, CASE WHEN regexp_matches(text, '{D.VIEW_HEAD}') THEN 'head' WHEN regexp_matches(text, '{D.VIEW_ITEM}') THEN 'view' WHEN regexp_matches(text, '{D.CONDITION}') THEN 'condition' ELSE 'text' END AS kind FROM c WHERE NOT choices),
  s AS (SELECT *, CASE kind WHEN 'head' THEN 'view' ELSE kind END AS side FROM k), n AS (SELECT *, coalesce(lag(side) OVER w <> side OR kind = 'head', true) AS fresh FROM s WINDOW w AS (PARTITION BY problem_id ORDER BY line_number)),
  r AS (SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY problem_id ORDER BY line_number) AS run FROM n),
  b AS (SELECT *, side <> 'text' AND (bool_or(kind = 'head') OVER w OR count(*) OVER w >= 2) AS boxed FROM r WINDOW w AS (PARTITION BY problem_id, run)),
  o AS (SELECT *, coalesce(lag(run) OVER w <> run AND (boxed OR lag(boxed) OVER w), true) AS opens FROM b WINDOW w AS (PARTITION BY problem_id ORDER BY line_number)),
  p AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY problem_id ORDER BY line_number) AS block FROM o), h AS (SELECT *, coalesce({HEIGHT}, 24.0) AS height FROM p),
  t AS (SELECT *, CASE WHEN boxed AND kind <> 'head' AND bbox_y - lag(bbox_y) OVER w <= height THEN 0 ELSE 1 END AS step FROM h WINDOW w AS (PARTITION BY problem_id, block, boxed AND kind <> 'head' ORDER BY bbox_y, line_number)),
  g AS (SELECT *, sum(step) OVER (PARTITION BY problem_id, block, boxed AND kind <> 'head' ORDER BY bbox_y, line_number ROWS UNBOUNDED PRECEDING) AS grid FROM t),
  x AS (SELECT *, CASE WHEN boxed AND kind <> 'head' THEN count(*) OVER (PARTITION BY problem_id, block, boxed AND kind <> 'head', grid) END AS wide FROM g)
  SELECT problem_id, block, max(CASE WHEN boxed THEN side ELSE 'text' END) AS kind, count(*) AS n_lines, CAST(coalesce(max(wide), 1) AS INTEGER) AS n_columns, string_agg(text, chr(10) ORDER BY line_number) AS text FROM x GROUP BY 1, 2""")
def i9(t: Tables):
    return D.boxed_layout(t.stem_lines, "problem_id")


@query("I16_problem_normalise", """WITH c AS (SELECT *, CASE WHEN problem_id % 7 <> 0 THEN list_transform(range(difficulty), lambda i: concat('old', i)) END AS had, CASE WHEN time_sec % 3 <> 0 THEN list_transform(range(time_sec // 10 % 7), lambda i: concat('new', i)) END AS found FROM problems)
  SELECT problem_id, array_to_string(CASE WHEN len(had) >= 4 THEN had WHEN len(found) >= 4 THEN found ELSE [] END, ',') AS choices FROM c""")
def i16(t: Tables):
    some = lambda name, n: F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(name), i.cast("string")))
    existing = F.when(F.col("problem_id") % 7 != 0, some("old", F.col("difficulty")))
    derived = F.when(F.col("time_sec") % 3 != 0, some("new", F.floor(F.col("time_sec") / 10) % 7))
    return t.problems.select("problem_id", F.array_join(B.normalised_choices(existing, derived), ",").alias("choices"))


@query("I20_consistency_check", "SELECT problem_id, CASE WHEN problem_id % 3 = 0 THEN true WHEN problem_id % 3 = 1 THEN false ELSE difficulty % 5 = 2 END AS consistent FROM problems")
def i20(t: Tables):
    kind = F.when(F.col("problem_id") % 3 == 2, "multiple_choice").otherwise("short_answer")
    answer = F.when(F.col("problem_id") % 3 == 2, "③").otherwise(F.concat(F.lit("$"), F.col("problem_id").cast("string"), F.lit("$")))
    label = F.substring(F.lit(D.CIRCLED), F.col("difficulty") % 5 + 1, F.lit(1))
    solution = F.when(F.col("problem_id") % 3 == 2, "따라서 정답은 ③").when(F.col("problem_id") % 3 == 1, "정답은 $-1$").otherwise(F.concat(F.lit("정답은 \\boxed{"), F.col("problem_id").cast("string"), F.lit("}.")))
    choices = F.array(*map(F.lit, "abcde"))
    return t.problems.select("problem_id", B.answer_consistent(kind, answer, choices, label, solution).alias("consistent"))


@query("H20_answer_candidates", "SELECT problem_id, CASE WHEN problem_id % 2 = 0 THEN concat('x=', problem_id) ELSE CAST(difficulty AS VARCHAR) END AS first FROM problems")
def h20(t: Tables):
    stated = F.concat(F.lit("풀면 $a$ 이고 정답은 $x = "), F.col("problem_id").cast("string"), F.lit("$"))
    formula = F.concat(F.lit("따라서 $y$ 그리고 $"), F.col("difficulty").cast("string"), F.lit("$"))
    found = B.answer_candidates(F.when(F.col("problem_id") % 2 == 0, stated).otherwise(formula))
    return t.problems.select("problem_id", F.try_element_at(found, F.lit(1)).alias("first"))


@query("H21_latex_table", r"SELECT problem_id, concat(problem_id, ' ', difficulty, ' ', stem) AS cells FROM problems")
def h21(t: Tables):
    raw = F.concat(F.lit("\\begin{tabular}{|c|c|}\\hline \\mathbf{"), F.col("problem_id").cast("string"), F.lit("} & "), F.col("difficulty").cast("string"), F.lit(" & \\multicolumn{2}{c}{"), F.col("stem"), F.lit("}\\end{tabular}"))
    return t.problems.select("problem_id", B.plain_table(raw).alias("cells"))


@query("H34_union_box", "SELECT submission_id, min(order_index) AS x, max(order_index + seconds) - min(order_index) AS w FROM answers GROUP BY submission_id")
def h34(t: Tables):
    box = F.struct(F.col("order_index").cast("double").alias("x"), F.lit(0.0).alias("y"), F.col("seconds").alias("w"), F.lit(1.0).alias("h"))
    boxes = t.answers.groupBy("submission_id").agg(B.union_box(F.collect_list(box)).alias("b"))
    return boxes.select("submission_id", F.col("b.x").cast("int").alias("x"), "b.w")


@query("H39_stored_signal", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS confidence, CASE WHEN event_id % 4 = 0 THEN 'concept_gap' END AS error_type FROM learning_events WHERE event_id % 4 NOT IN (2, 3)")
def h39(t: Tables):
    n = F.col("event_id") % 4
    confidence = F.when(n == 2, F.lit('"high"')).otherwise(F.col("value").cast("string"))
    source = F.when(n == 3, "other").otherwise("tutor_message")
    kind = F.when(n == 0, "concept_gap").otherwise("unheard_of")
    metadata = F.concat(F.lit('{"weaknessSignal": {"source": "'), source, F.lit('", "problemId": "p", "evidence": "e", "errorType": "'), kind, F.lit('", "confidence": '), confidence, F.lit("}}"))
    found = t.learning_events.select("event_id", B.stored_signal(metadata).alias("s")).where("s is not null")
    return found.select("event_id", "s.confidence", "s.error_type")


STUDENT = ["잘 모르겠어요 헷갈려", "정의가 뭐야", "유형을 몰라", "부호 계산이 어려워", "조건을 놓쳤다", "this careless_mistake", "개념 오류 도와줘", "", "Plain"]
TUTOR = ["네", "a CONCEPT_GAP here", "풀이 방향을 보자", "산술 전개 실수", "", "concept_gaps"]
EXCHANGES = f"""SELECT conv_id, turn, [{", ".join(f"'{w}'" for w in STUDENT)}][1 + (conv_id + turn) % {len(STUDENT)}] AS student, concat([{", ".join(f"'{w}'" for w in TUTOR)}][1 + (conv_id * 7 + turn) % {len(TUTOR)}], ' ', CASE WHEN turn % 2 = 0 THEN text ELSE '' END) AS tutor, conv_id % 4 = 0 AS has_image FROM tutor_messages"""
KINDS = "CASE " + " ".join(f"WHEN regexp_matches(words, '{p}') THEN '{n}'" for n, p in B.ERROR_WORDS) + " END"
NAMED = "regexp_matches(words, '" + "|".join(rf"\b{n}\b" for n, _ in B.ERROR_WORDS) + "')"


@query("H40_inferred_signal", f"""WITH x AS (SELECT *, concat(lower(student), chr(10), lower(tutor)) AS words FROM ({EXCHANGES})), k AS (SELECT *, {KINDS} AS kind FROM x)
  SELECT conv_id, turn, CASE WHEN has_image THEN 'worked_solution' ELSE 'tutor_message' END AS source, kind AS error_type, round(greatest(0.2, least(0.95, CASE WHEN has_image THEN 0.8 ELSE 0.38 END + CASE WHEN regexp_matches(student, '{B.CONFUSION}') THEN 0.08 ELSE 0 END
    + CASE WHEN kind IS NOT NULL THEN 0.08 ELSE 0 END + CASE WHEN {NAMED} THEN 0.06 ELSE 0 END))::DOUBLE, 6) AS confidence, sha256(substring(concat_ws(chr(10) || chr(10), nullif(trim(student), ''), nullif(trim(tutor), '')), 1, 500)) AS evidence FROM k""")
def h40(t: Tables):
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (n % len(words)).cast("int"))
    student = pick(STUDENT, F.col("conv_id") + F.col("turn"))
    tutor = F.concat(pick(TUTOR, F.col("conv_id") * 7 + F.col("turn")), F.lit(" "), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(""))
    signal = B.inferred_signal(student, tutor, F.col("conv_id") % 4 == 0)
    return t.tutor_messages.select("conv_id", "turn", signal.alias("s")).select("conv_id", "turn", "s.source", "s.error_type", N.js_round_n(F.col("s.confidence"), 6).alias("confidence"), F.sha2("s.evidence", 256).alias("evidence"))

