"""Documents into problems: sources, segmentation, answers, dedup and revisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import documents as D
from ..sources.domain import Tables
from .registry import query

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents"
NOISE = r"(trim(text) = '' OR regexp_matches(trim(text), '^-?\s*\d{1,3}\s*-?$') OR regexp_matches(trim(text), '^(?:page|p\.)\s*\d+$'))"


def numbered_lines(t: Tables):
    """Problem stems as numbered lines of books of fifty problems at most, with text between.  No window is needed to make them."""
    n = F.expr("problem_id % 50 + 1")
    book = F.concat_ws("/", "subject", F.expr("problem_id div 1250").cast("string"))
    p = t.problems.select(book.alias("subject"), "stem", "difficulty", F.col("problem_id").alias("line_number"), n.cast("string").alias("n"))
    text = F.when(F.col("difficulty") > 2, F.concat("n", F.lit(". "), F.col("stem"))).otherwise(F.concat("n", F.lit(".5 "), F.col("stem")))
    return p.select("subject", F.lit(1).alias("page_number"), "line_number", text.alias("text"))


NUMBERED = "SELECT concat(subject, '/', CAST(problem_id // 1250 AS BIGINT)) AS subject, problem_id AS line_number, CASE WHEN difficulty > 2 THEN concat(problem_id % 50 + 1, '. ', stem) ELSE concat(problem_id % 50 + 1, '.5 ', stem) END AS text, CASE WHEN difficulty > 2 THEN problem_id % 50 + 1 END AS opens FROM problems"


@query("A4_json_pages_source", "SELECT doc_id, 1 AS page_number, CAST(1 AS INTEGER) AS line_number, text FROM documents WHERE trim(text, ' ') <> ''")
def a4(t: Tables):
    line = F.struct("text", F.lit("text").alias("type"))
    page = lambda n: F.struct(F.lit(n).alias("page"), F.array(line).alias("lines"))
    packed = t.documents.select("doc_id", F.to_json(F.struct(F.array(page(0), page(1)).alias("pages"))).alias("json"))
    return D.page_lines(packed, "doc_id", "json").select("doc_id", "page_number", "line_number", "text")


@query("A5_polygon_to_bbox", "SELECT problem_id, CASE WHEN difficulty > 1 THEN CAST(least(difficulty, time_sec) AS DOUBLE) END AS x, CASE WHEN difficulty > 1 THEN CAST(abs(difficulty - time_sec) AS DOUBLE) END AS w, CASE WHEN difficulty > 1 THEN 5.0::DOUBLE END AS h FROM problems")
def a5(t: Tables):
    point = lambda x, y: F.array(F.col(x).cast("double"), F.lit(float(y)))
    points = F.when(F.col("difficulty") > 1, F.array(point("difficulty", 3), point("time_sec", 8))).otherwise(F.array(point("difficulty", 3)))
    return t.problems.select("problem_id", D.polygon_box(points).alias("b")).select("problem_id", "b.x", "b.w", "b.h")


@query("A7_qti_round_trip", "SELECT problem_id, stem AS prompt, 4 AS n_choices, CAST(difficulty AS VARCHAR) AS answer FROM problems")
def a7(t: Tables):
    choices = F.array(F.col("subject"), F.col("stem"), F.lit("a < b"), F.lit('"c" & d'))
    xml = D.as_assessment_item(F.col("problem_id").cast("string"), F.col("stem"), choices, F.col("difficulty").cast("string"))
    items = t.problems.select(F.explode(D.assessment_items(F.concat(F.lit("<test>"), xml, F.lit("</test>")))).alias("i"))
    return items.select(F.col("i.id").cast("long").alias("problem_id"), "i.prompt", F.size("i.choices").alias("n_choices"), "i.answer")


@query("A6_external_answer_pages", "SELECT doc_id, CAST(1 + doc_id % 2 AS INTEGER) AS page_number, CAST(CASE WHEN doc_id % 3 = 0 THEN 7 ELSE 1 END AS INTEGER) AS line_number, text FROM documents WHERE trim(text, ' ') <> ''")
def a6(t: Tables):
    """A bare list of pages, as an outside service returns it; some lines bring their number."""
    number = F.when(F.col("doc_id") % 3 == 0, 7)
    line = F.struct("text", F.lit("text").alias("type"), number.alias("line_number"))
    pages = F.array(F.struct((1 + F.col("doc_id") % 2).cast("int").alias("page"), F.array(line, F.struct(F.lit("  ").alias("text"), F.lit("text").alias("type"), F.lit(None).cast("int").alias("line_number"))).alias("lines")))
    packed = t.documents.where("text is not null").select("doc_id", F.to_json(pages).alias("json"))
    return D.page_lines(packed, "doc_id", "json").select("doc_id", "page_number", "line_number", "text")


@query("A8_qti_package", """SELECT subject, concat('<assessmentTest title="', replace(subject, '#', '#'), ' &amp; more"><testPart><assessmentSection>', string_agg(concat('<assessmentItemRef identifier="', problem_id, '" href="', problem_id, '.xml"/>'), '' ORDER BY problem_id), '</assessmentSection></testPart></assessmentTest>') AS xml,
  count(*) AS n_read, CAST(min(problem_id) AS VARCHAR) AS first FROM problems WHERE review_status <> 'rejected' GROUP BY subject""")
def a8(t: Tables):
    ids = F.transform(F.array_sort(F.collect_list("problem_id")), lambda i: i.cast("string"))
    packed = t.problems.where("review_status <> 'rejected'").groupBy("subject").agg(ids.alias("ids"))
    made = packed.select("subject", D.as_assessment_test(F.concat("subject", F.lit(" & more")), F.col("ids")).alias("xml"))
    read = made.withColumn("items", D.test_items(F.col("xml")))
    return read.select("subject", "xml", F.size("items").cast("long").alias("n_read"), F.col("items")[0].alias("first"))


@query("I1_noise_filter", f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT {NOISE}) AS kept FROM ({LINES}) GROUP BY doc_id")
def i1(t: Tables):
    lines = D.text_lines(t.documents)
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(~D.is_noise(F.col("text"))).alias("kept"))


SEGMENTED = f"SELECT *, CAST(sum(CASE WHEN opens IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY line_number) AS BIGINT) AS segment FROM ({NUMBERED})"


@query("I2_exam_segmentation", f"SELECT subject, line_number, segment, CAST(max(opens) OVER (PARTITION BY subject, segment) AS INTEGER) AS number FROM ({SEGMENTED})")
def i2(t: Tables):
    return D.segments(numbered_lines(t), "subject").select("subject", "line_number", "segment", "number")


@query("I3_segment_assemble", f"SELECT subject, segment, CAST(max(opens) AS INTEGER) AS number, count(*) AS n_lines, string_agg(text, chr(10) ORDER BY line_number) AS text FROM ({SEGMENTED}) GROUP BY subject, segment")
def i3(t: Tables):
    return D.assembled(D.segments(numbered_lines(t), "subject"), "subject").select("subject", "segment", "number", "n_lines", "text")


@query("I4_inline_choices", """SELECT problem_id, CASE difficulty WHEN 1 THEN concat(stem, chr(10), '② b ① a') WHEN 4 THEN concat(stem, ' ① a ② b ③ c') WHEN 6 THEN '' ELSE stem END AS stem, CASE difficulty WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 5 THEN 4 ELSE 0 END AS n_choices,
  CASE difficulty WHEN 2 THEN CAST(time_sec AS VARCHAR) WHEN 3 THEN concat('e', time_sec) WHEN 5 THEN 'd' END AS last_choice FROM problems""")
def i4(t: Tables):
    z = F.col("time_sec").cast("string")
    shapes = {
        1: F.lit("\n② b ① a"), 2: F.concat(F.lit("\n① f(1)=0 ② b ③ c\r\n④ d ⑤ "), z), 3: F.concat(F.lit(" (1) a (2) b (3) c (4) d (5) e"), z), 4: F.lit(" ① a ② b ③ c"), 5: F.lit("\n① a\n② b\n③ c\n④ d "),
    }
    text = F.lit(None).cast("string")  # the hardest have no text
    for level, tail in shapes.items():
        text = F.when(F.col("difficulty") == level, F.concat(F.col("stem"), tail)).otherwise(text)
    parsed = D.with_choices(t.problems.select("problem_id", text.alias("text")))
    return parsed.select("problem_id", "stem", F.size("choices").alias("n_choices"), F.try_element_at("choices", F.lit(-1)).alias("last_choice"))


@query("I10_quick_answers", """SELECT problem_id, CASE WHEN difficulty = 6 THEN 0 WHEN difficulty = 1 THEN 1 WHEN problem_id % 7 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN difficulty = 6 THEN NULL WHEN difficulty = 1 OR problem_id % 7 = 1 THEN '3' ELSE '1' END AS first,
  CASE WHEN difficulty NOT IN (1, 6) AND problem_id % 7 <> 1 THEN CAST(1 + time_sec % 5 AS VARCHAR) END AS other FROM problems""")
def i10(t: Tables):
    mark = F.translate((1 + F.col("time_sec") % 5).cast("string"), "12345", D.CIRCLED)
    number = F.lpad((F.col("problem_id") % 7).cast("string"), 4, "0")
    runs = F.when(F.col("difficulty") == 6, F.lit("정답 없음 12 a")).when(F.col("difficulty") == 1, F.lit("0001①0001③")).otherwise(F.concat(F.lit("0001 ① "), number, mark, F.when(F.col("problem_id") % 7 == 1, F.lit(" 1③")).otherwise("")))
    answers = t.problems.select("problem_id", D.quick_answers(runs).alias("m"), (F.col("problem_id") % 7).cast("int").alias("k"))
    other = F.when(F.col("k") != 1, F.try_element_at("m", F.col("k")))
    return answers.select("problem_id", F.size("m").alias("n"), F.try_element_at("m", F.lit(1)).alias("first"), other.alias("other"))


@query("I11_answer_blocks", f"SELECT subject, CAST(max(opens) AS INTEGER) AS number, sha256(string_agg(text, chr(10) ORDER BY line_number)) AS block FROM ({SEGMENTED}) GROUP BY subject, segment HAVING max(opens) IS NOT NULL")
def i11(t: Tables):
    blocks = D.assembled(D.segments(numbered_lines(t), "subject"), "subject").where("number is not null")
    return blocks.select("subject", "number", F.sha2("text", 256).alias("block"))


FIGURES = """SELECT p_partkey AS line_id, CASE p_size % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'figure' WHEN 2 THEN 'text' WHEN 3 THEN 'diagram' END AS line_type, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS bbox_x, CAST(p_size + 1 AS DOUBLE) AS bbox_y,
  CASE WHEN p_size % 11 <> 0 THEN CAST(p_size * 4 AS DOUBLE) END AS bbox_w, CAST(50 AS DOUBLE) AS bbox_h, CASE p_size % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'text' END AS data_type, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size * 3 AS DOUBLE) END AS data_w, p_size % 9 <> 0 AS has_box FROM {part}"""


@query("I15_figure_filter", f"""WITH f AS ({FIGURES.format(part="part")}), b AS (SELECT line_id, bbox_x AS x, bbox_y AS y, bbox_w AS w, bbox_h AS h FROM f WHERE line_type IN ('image', 'figure') AND bbox_x IS NOT NULL
  UNION ALL SELECT line_id, 5, 0, coalesce(data_w, 0), 60 FROM f WHERE data_type = 'image' AND has_box) SELECT line_id, x, y, w, h FROM b WHERE coalesce(w, 0) * coalesce(h, 0) >= 5000""")
def i15(t: Tables):
    lines = t.spark.sql(FIGURES, part=t.part)
    box = F.struct(F.lit(5.0).alias("x"), F.lit(None).cast("double").alias("y"), F.col("data_w").alias("w"), F.lit(60.0).alias("h"))
    return D.figure_boxes(lines.withColumn("data_box", F.when(F.col("has_box"), box)).drop("data_w", "has_box"))


@query("I17_fingerprint_dedup", "SELECT min(doc_id) AS doc_id FROM documents WHERE source <> 'src3' AND trim(text, ' ') NOT IN (SELECT trim(text, ' ') FROM documents WHERE source = 'src3') GROUP BY trim(text, ' ')")
def i17(t: Tables):
    docs = t.documents.select("doc_id", "text", "source")  # all rows: those of one source are there already, the others come in
    return D.new_only(docs.where("source <> 'src3'"), docs.where("source = 'src3'"), ["text"], ["doc_id"]).select("doc_id")


FLAT, BOXED = "concat('{{\"x\": ', CAST(p_size % 2 AS STRING), '}}')", "concat('{{\"boxed_blocks\": [{{\"kind\": \"', p_brand, '\"}}], \"x\": 1}}')"
LAYOUTS = f"""SELECT p_partkey AS problem_id, CASE p_size % 4 WHEN 0 THEN {FLAT} WHEN 1 THEN {BOXED} WHEN 2 THEN '{{{{"boxed_blocks": []}}}}' END AS now,
  CASE p_partkey % 6 WHEN 0 THEN {FLAT} WHEN 1 THEN {BOXED} WHEN 2 THEN '[1, 2]' WHEN 3 THEN '"text"' WHEN 4 THEN '{{{{"boxed_blocks": []}}}}' END AS next FROM {{part}}"""


@query("I18_layout_merge", f"""WITH l AS ({LAYOUTS.format(part="part")}), r AS (SELECT *, coalesce(prefix(next, '{{'), false) AND NOT (NOT contains(next, '"kind"') AND contains(coalesce(now, ''), '"kind"')) AND now IS DISTINCT FROM next AS replaced FROM l)
  SELECT problem_id, CASE WHEN replaced THEN next ELSE now END AS layout, replaced FROM r""")
def i18(t: Tables):
    return t.spark.sql(LAYOUTS, part=t.part).select("problem_id", D.merged_layout(F.col("now"), F.col("next")).alias("m")).select("problem_id", "m.*")


@query("I19_page_image_lookup", "SELECT p.problem_id, g.label AS image FROM problems p LEFT JOIN (SELECT DISTINCT subject, difficulty * 5 AS page_number, concat(subject, '/', difficulty) AS label FROM problems WHERE difficulty % 4 <> 0) g ON g.subject = p.subject AND g.page_number = time_sec // 30")
def i19(t: Tables):
    pages = t.problems.where("difficulty % 4 <> 0").select("subject", (F.col("difficulty") * 5).alias("page_number"), F.concat_ws("/", "subject", "difficulty").alias("image")).distinct()
    problems = t.problems.select("problem_id", "subject", F.expr("cast(time_sec div 30 as int)").alias("start_page"))
    return D.with_page_image(problems, pages, "subject").select("problem_id", "image")


@query("I21_result_whitelist", """SELECT problem_id, CASE WHEN known THEN subject END AS subject, CASE WHEN known THEN unit END AS unit, CASE WHEN known THEN stem END AS minor, round_even(time_sec / 64.0::DOUBLE, 3) AS confidence, greatest(1, least(6, time_sec / 40.0::DOUBLE)) AS difficulty,
  array_to_string(list_filter(string_split(stem, ' '), lambda w: w IN ('red', 'small', 'ring')), ',') AS tags FROM (SELECT *, subject IN ('Brand#1', 'Brand#2', 'Brand#3') AS known FROM problems)""")
def i21(t: Tables):
    tags = F.filter(F.split("stem", " "), lambda w: w.isin("red", "small", "ring"))
    found = D.classified(F.col("subject"), ["Brand#1", "Brand#2", "Brand#3"], {"unit": F.col("unit"), "minor": F.col("stem")}, F.col("time_sec") / 64.0)
    return t.problems.select("problem_id", found.alias("c"), N.clamp(F.col("time_sec") / 40.0, 1.0, 6.0).alias("difficulty"), F.array_join(tags, ",").alias("tags")).select("problem_id", "c.*", "difficulty", "tags")


@query("I22_partial_merge", "SELECT problem_id, CASE WHEN problem_id % 2 = 0 THEN 'new' ELSE unit END AS unit, CASE WHEN problem_id % 3 = 0 THEN 'x' ELSE stem END AS stem FROM problems")
def i22(t: Tables):
    old = t.problems.select("problem_id", "unit", "stem")
    new = old.select("problem_id", F.when(F.col("problem_id") % 2 == 0, "new").alias("unit"), F.when(F.col("problem_id") % 3 == 0, "x").alias("stem"))
    return D.merge_partial(old, new, "problem_id", ["unit", "stem"])


SECTION = " ".join(f"WHEN starts_with(trim(text), '{head}') THEN '{name}'" for head, name in reversed(D.SECTION_HEADS.items()))
CELL = D.ANSWER_CELL


@query("I12_answer_tables", rf"""WITH m AS (SELECT *, CASE {SECTION} END AS head FROM answer_lines),
  c AS (SELECT *, last_value(CASE WHEN head IS NULL THEN nullif(regexp_extract(text, '^\s*(\d{{2}})\s+[^\d]', 1), '') END IGNORE NULLS) OVER w AS chapter, last_value(head IGNORE NULLS) OVER w AS section FROM m WINDOW w AS (PARTITION BY book ORDER BY page_number, line_number)),
  p AS (SELECT *, unnest(regexp_extract_all(text, '{CELL}')) AS pair, unnest(range(len(regexp_extract_all(text, '{CELL}')))) AS nth FROM c WHERE section IS NOT NULL AND regexp_matches(trim(text), '^\d'))
  SELECT book, chapter, section, CAST(regexp_extract(pair, '^(\d+)', 1) AS INTEGER) AS number, max_by(regexp_extract(pair, '^\d+\s*(\S+)$', 1), (page_number, line_number, nth)) AS answer FROM p GROUP BY 1, 2, 3, 4""")
def i12(t: Tables):
    return D.answer_table(t.answer_lines, "book")


@query("I14_answer_match", f"""WITH p AS (SELECT *, coalesce(unit, 'none') AS chapter, CAST(problem_id % 4 AS VARCHAR) AS section, CASE WHEN time_sec % 90 = 0 THEN CAST(difficulty AS VARCHAR) END AS inline_answer FROM problems),
  b AS (SELECT *, CASE difficulty WHEN 5 THEN '④' WHEN 4 THEN '12.5' WHEN 3 THEN 'x + 1' END AS beside FROM p)
  SELECT problem_id, CASE WHEN inline_answer IS NOT NULL THEN inline_answer WHEN section = '1' AND difficulty <= 3 THEN chapter WHEN chapter = 'PROMO' THEN concat('s', section) WHEN difficulty = 6 THEN '6' WHEN difficulty >= 2 THEN beside END AS answer,
    CASE WHEN inline_answer IS NOT NULL THEN 'inline' WHEN section = '1' AND difficulty <= 3 THEN 'quick' WHEN chapter = 'PROMO' THEN 'solution' WHEN difficulty = 6 THEN 'number' WHEN difficulty >= 2 THEN 'beside' END AS source,
    CASE WHEN inline_answer IS NOT NULL THEN 1.0 WHEN section = '1' AND difficulty <= 3 THEN 0.95 WHEN chapter = 'PROMO' THEN 0.9 WHEN difficulty = 6 THEN 0.7 WHEN difficulty = 2 THEN 0.3
      WHEN difficulty = 5 AND problem_type = 'multiple_choice' THEN 0.8 WHEN difficulty = 4 AND problem_type = 'short_answer' THEN 0.7 WHEN difficulty >= 3 THEN 0.5 END::DOUBLE AS confidence FROM b""")
def i14(t: Tables):
    inline = F.when(F.col("time_sec") % 90 == 0, F.col("difficulty").cast("string"))
    problems = t.problems.select("problem_id", "problem_type", F.coalesce("unit", F.lit("none")).alias("chapter"), (F.col("problem_id") % 4).cast("string").alias("section"), F.col("difficulty").alias("number"), inline.alias("inline_answer"))
    keys = problems.select("chapter", "section", "number").distinct()
    quick = keys.where("section = '1' and number <= 3").withColumn("answer", F.col("chapter"))
    solutions = keys.where("chapter = 'PROMO'").withColumn("answer", F.concat(F.lit("s"), "section"))
    numbers = keys.where("number = 6").select("number").distinct().withColumn("answer", F.col("number").cast("string"))
    answer = F.when(F.col("number") == 5, "④").when(F.col("number") == 4, "12.5").when(F.col("number") == 3, "x + 1")
    beside = keys.where("number between 2 and 5").select("number").distinct().withColumn("answer", answer)
    return D.match_answers(problems, quick, solutions, numbers, beside)


RULE = lambda k: "CASE " + " ".join(f"WHEN q BETWEEN {r[0]} AND {r[1]} THEN {r[k] if isinstance(r[k], int) else repr(r[k])}" for r in D.EXAM_RULES) + " END"


@query("I23_apply_exam_rules", rf"""WITH p AS (SELECT problem_id, subject, unit, problem_type = 'essay' AS textbook, CASE problem_id % 3 WHEN 0 THEN concat('Q', problem_id % 40) WHEN 1 THEN concat(' ', problem_id % 40, '. ') ELSE 'none' END AS raw, CASE WHEN time_sec % 110 <> 0 THEN difficulty - 0.5::DOUBLE END AS level,
    CASE WHEN difficulty = 2 THEN 'given' END AS form, CASE WHEN time_sec % 40 <> 0 THEN concat('a', difficulty) END AS ai, CASE WHEN problem_id % 2 = 0 THEN 'book' END AS old FROM problems),
  n AS (SELECT *, TRY_CAST(nullif(regexp_extract(trim(raw), '^[Qq#]*(\d+)\.*$', 1), '') AS INTEGER) AS q FROM p),
  y15 AS (SELECT subject, unit, min(problem_id) AS node FROM problems WHERE review_status = 'approved' GROUP BY 1, 2), y22 AS (SELECT subject, unit, min(problem_id) AS node FROM problems WHERE review_status = 'auto_approved' GROUP BY 1, 2)
  SELECT problem_id, CASE WHEN NOT textbook THEN coalesce({RULE(2)}, CASE WHEN level >= 4.5 THEN 'killer' WHEN level >= 3.5 THEN 'semi_killer' ELSE 'normal' END) END AS position_type,
    CASE WHEN NOT textbook THEN coalesce({RULE(3)}, [2, 2, 3, 4, 4][CAST(round_even(level, 0) AS INTEGER)], 3) END AS point_value, CASE WHEN NOT textbook THEN coalesce(form, {RULE(4)}) ELSE form END AS question_format,
    CASE WHEN NOT textbook THEN coalesce(ai, old) ELSE old END AS answer_text, CASE WHEN textbook THEN ai END AS answer_latex, y15.node AS node_2015, y22.node AS node_2022 FROM n LEFT JOIN y15 USING (subject, unit) LEFT JOIN y22 USING (subject, unit)""")
def i23(t: Tables):
    n = (F.col("problem_id") % 40).cast("string")
    raw = F.when(F.col("problem_id") % 3 == 0, F.concat(F.lit("Q"), n)).when(F.col("problem_id") % 3 == 1, F.concat(F.lit(" "), n, F.lit(". "))).otherwise("none")
    made = t.problems.select(
        "problem_id", "subject", "unit", (F.col("problem_type") == "essay").alias("is_textbook"), raw.alias("problem_number"), F.when(F.col("time_sec") % 110 != 0, F.col("difficulty") - 0.5).alias("difficulty"),
        F.when(F.col("difficulty") == 2, "given").alias("question_format"), F.when(F.col("time_sec") % 40 != 0, F.concat(F.lit("a"), F.col("difficulty").cast("string"))).alias("ai_answer"), F.when(F.col("problem_id") % 2 == 0, "book").alias("answer_text"),
    )
    year = F.when(F.col("review_status") == "approved", 2015).when(F.col("review_status") == "auto_approved", 2022)
    nodes = t.problems.withColumn("year", year).where("year is not null").groupBy("year", "subject", "unit").agg(F.min("problem_id").alias("node_id"))
    out = D.apply_exam_rules(made)
    for y in (2015, 2022):
        out = D.with_curriculum_node(out, nodes, y, "subject", "unit", f"node_{y}")
    return out.select("problem_id", "position_type", "point_value", "question_format", "answer_text", "answer_latex", "node_2015", "node_2022")


@query("I24_refined_result", """SELECT problem_id, subject, difficulty, subject IN ('Brand#2', 'Brand#4') AS is_common, CASE WHEN time_sec % 3 = 0 THEN 0.5 ELSE time_sec / 512.0::DOUBLE END AS confidence FROM (
  SELECT problem_id, time_sec, CASE WHEN unit IS NOT NULL AND subject IN ('Brand#1', 'Brand#2', 'Brand#4') THEN subject ELSE 'Brand#1' END AS subject, round_even(greatest(1, least(5, CASE WHEN time_sec % 7 = 0 THEN 3.0 ELSE difficulty - 0.75 END::DOUBLE)), 1) AS difficulty FROM problems)""")
def i24(t: Tables):
    subject = F.when(F.col("unit").isNotNull(), F.col("subject"))
    level = F.when(F.col("time_sec") % 7 != 0, F.col("difficulty") - 0.75)
    confidence = F.when(F.col("time_sec") % 3 != 0, F.col("time_sec") / 512.0)
    return t.problems.select("problem_id", D.refined(subject, ["Brand#1", "Brand#2", "Brand#4"], level, ["Brand#2", "Brand#4"], confidence).alias("r")).select("problem_id", "r.*")


@query("K8_revision_log", "SELECT problem_id, CAST(row_number() OVER (PARTITION BY problem_id ORDER BY submission_id, answer_no) AS INTEGER) AS revision, CASE WHEN lag(seconds) OVER w IS DISTINCT FROM seconds AND row_number() OVER w > 1 THEN 'seconds' ELSE '' END AS changed FROM numbered_answers WINDOW w AS (PARTITION BY problem_id ORDER BY submission_id, answer_no)")
def k8(t: Tables):
    log = D.revision_log(t.numbered_answers, "problem_id", ["submission_id", "answer_no"], ["seconds"])
    return log.select("problem_id", "revision", "changed")
