"""Ranking and layout windows, scalar functions and graph walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import retrieval as J
from ..operators import tables as O
from ..sources.domain import Tables
from .registry import query


@query("E1_row_number_global", "SELECT problem_id, CAST(row_number() OVER (ORDER BY weight DESC, problem_id) AS INTEGER) AS rank FROM problems ORDER BY weight DESC, problem_id LIMIT 100")
def e1(t: Tables):
    order = [F.desc("weight"), F.col("problem_id")]
    first = t.problems.select("problem_id", "weight").orderBy(*order).limit(100)  # cut first: only what is asked for meets in one place
    return first.select("problem_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("E2_row_number_dedup", "SELECT submission_id FROM (SELECT submission_id, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY submitted_at DESC, score DESC NULLS LAST, submission_id DESC) AS n FROM submissions) WHERE n = 1")
def e2(t: Tables):
    w = Window.partitionBy("assignment_id", "student_id").orderBy(F.desc("submitted_at"), F.desc_nulls_last("score"), F.desc("submission_id"))
    return t.submissions.withColumn("n", F.row_number().over(w)).where("n = 1").select("submission_id")


@query("E3_total_count_over", "SELECT problem_id, count(*) OVER (PARTITION BY subject) AS total FROM problems WHERE difficulty = 5")
def e3(t: Tables):
    return t.problems.where("difficulty = 5").select("problem_id", F.count("*").over(Window.partitionBy("subject")).alias("total"))


@query("E4_competition_rank", "SELECT student_id, CAST(rank() OVER (PARTITION BY class_id ORDER BY xp DESC) AS INTEGER) AS rank FROM students")
def e4(t: Tables):
    return t.students.select("student_id", F.rank().over(Window.partitionBy("class_id").orderBy(F.desc("xp"))).alias("rank"))


@query("E5_leaderboard", "SELECT class_id, student_id, CAST(n AS INTEGER) AS position FROM (SELECT class_id, student_id, row_number() OVER (PARTITION BY class_id ORDER BY xp DESC, student_id) AS n FROM students) WHERE n <= 10")
def e5(t: Tables):
    w = Window.partitionBy("class_id").orderBy(F.desc("xp"), "student_id")
    return t.students.select("class_id", "student_id", F.row_number().over(w).alias("position")).where("position <= 10")


@query("E6_latest_per_group", "SELECT subject, problem_id FROM (SELECT subject, problem_id, rank() OVER (PARTITION BY subject ORDER BY difficulty DESC, time_sec DESC) AS r FROM problems) WHERE r = 1")
def e6(t: Tables):
    w = Window.partitionBy("subject").orderBy(F.desc("difficulty"), F.desc("time_sec"))
    return t.problems.select("subject", "problem_id", F.rank().over(w).alias("r")).where("r = 1").drop("r")


@query("E7_longest_streak", """SELECT submission_id, max(len) AS longest FROM (SELECT submission_id, g, count(*) AS len FROM (SELECT submission_id, is_correct, sum(CASE WHEN is_correct THEN 0 ELSE 1 END) OVER (PARTITION BY submission_id ORDER BY answer_no) AS g FROM numbered_answers WHERE is_correct IS NOT NULL) WHERE is_correct GROUP BY 1, 2) GROUP BY 1""")
def e7(t: Tables):
    return A.longest_run(t.numbered_answers.where("is_correct is not null"), "submission_id", "answer_no")


@query("E8_top_and_bottom_share", """SELECT class_id, student_id, CASE WHEN hi <= k THEN 'top' ELSE 'bottom' END AS part FROM (SELECT class_id, student_id, greatest(1, floor(count(*) OVER (PARTITION BY class_id) * 0.27)) AS k, row_number() OVER (PARTITION BY class_id ORDER BY xp DESC, student_id) AS hi, row_number() OVER (PARTITION BY class_id ORDER BY xp, student_id DESC) AS lo FROM students) WHERE hi <= k OR lo <= k""")
def e8(t: Tables):
    ranked = O.group_ranks(t.students.select("class_id", "student_id", "xp"), ["class_id"], [F.desc("xp"), F.col("student_id")], "hi", "n")
    k = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 0.27))
    part = F.when(F.col("hi") <= k, "top").when(F.col("hi") > F.col("n") - k, "bottom")
    return ranked.select("class_id", "student_id", part.alias("part")).where("part is not null")


@query("E9_running_segment", "SELECT submission_id, answer_no, CAST(sum(CASE WHEN is_correct THEN 1 ELSE 0 END) OVER (PARTITION BY submission_id ORDER BY answer_no) AS BIGINT) AS segment FROM numbered_answers")
def e9(t: Tables):
    w = Window.partitionBy("submission_id").orderBy("answer_no").rowsBetween(Window.unboundedPreceding, 0)
    return t.numbered_answers.select("submission_id", "answer_no", F.sum(F.when(F.col("is_correct"), 1).otherwise(0)).over(w).alias("segment"))


@query("E10_next_revision", "SELECT problem_id, max(answer_no) + 1 AS next_revision FROM numbered_answers GROUP BY problem_id")
def e10(t: Tables):
    return t.numbered_answers.groupBy("problem_id").agg((F.max("answer_no") + 1).alias("next_revision"))


@query("E11_page_layout", "SELECT problem_id, subject, CAST((n - 1) // 6 AS INTEGER) AS page, CAST(least(1, (n - 1) % 6 // 3) AS INTEGER) AS col FROM (SELECT problem_id, subject, row_number() OVER (PARTITION BY subject ORDER BY problem_id) AS n FROM problems)")
def e11(t: Tables):
    i = F.row_number().over(Window.partitionBy("subject").orderBy("problem_id")) - 1
    placed = t.problems.select("problem_id", "subject", i.alias("i"))
    return placed.select("problem_id", "subject", F.expr("cast(i div 6 as int)").alias("page"), F.expr("cast(least(1, (i % 6) div 3) as int)").alias("col"))


@query("E12_layout_plan_validation", "SELECT subject, bool_and(n = 1) AND sum(span) <= 600 AS valid FROM (SELECT subject, problem_id, count(*) AS n, sum(1 + difficulty) AS span FROM problems GROUP BY 1, 2) GROUP BY 1")
def e12(t: Tables):
    each = t.problems.groupBy("subject", "problem_id").agg(F.count("*").alias("n"), F.sum(1 + F.col("difficulty")).alias("span"))
    return each.groupBy("subject").agg((F.bool_and(F.col("n") == 1) & (F.sum("span") <= 600)).alias("valid"))


@query("H1_rounding_rules", "SELECT submission_id, CAST(floor(score / 8 + 0.5) AS BIGINT) AS js, floor(score / 8 * 10 + 0.5) / 10 AS js1, CAST(round(CAST(score / 8 AS DECIMAL(30,10)), 1) AS DOUBLE) AS pg1, round_even(score / 8, 0) AS py FROM submissions WHERE score IS NOT NULL")
def h1(t: Tables):
    x = F.col("score") / 8
    return t.submissions.where("score is not null").select("submission_id", N.js_round(x).alias("js"), N.js_round_n(x, 1).alias("js1"), N.pg_round(x).alias("pg1"), N.py_round(x).alias("py"))


@query("H5_clamp_logistic_floor", "SELECT problem_id, greatest(2, least(5, difficulty)) AS clamped, floor(1 / (1 + exp(3.5 - difficulty)) * 1e9 + 0.5) / 1e9 AS logistic, CAST(floor(weight / 100) + 1 AS BIGINT) AS level, CAST(ceil(weight / 100) AS BIGINT) AS up FROM problems")
def h5(t: Tables):
    d, w = F.col("difficulty"), F.col("weight")
    return t.problems.select("problem_id", N.clamp(d, 2, 5).cast("int").alias("clamped"), N.js_round_n(N.logistic(d - 3.5), 9).alias("logistic"), (F.floor(w / 100) + 1).alias("level"), F.ceil(w / 100).alias("up"))


@query("H9_linear_decay", """SELECT problem_id, CASE WHEN time_sec IS NULL THEN 0.5 WHEN time_sec < lo THEN greatest(0, 1.0 - (lo - time_sec) / greatest(lo, 60)::DOUBLE) WHEN time_sec > hi THEN greatest(0, 1.0 - (time_sec - hi) / greatest(hi, 120)::DOUBLE) ELSE 1.0 END::DOUBLE AS time_score
  FROM (SELECT problem_id, time_sec, [30, 60, 90, 150, 240, 360][difficulty] AS lo, [120, 180, 300, 420, 600, 900][difficulty] AS hi FROM problems)""")
def h9(t: Tables):
    return t.problems.select("problem_id", J.time_score(F.col("difficulty"), F.col("time_sec")).alias("time_score"))


@query("H10_calendar", """SELECT event_id, CAST(client_ts AS DATE) AS day, CAST(date_trunc('week', client_ts) AS DATE) AS monday, CAST(date_trunc('week', client_ts) AS DATE) + 6 AS sunday, CAST(date_trunc('month', client_ts) AS DATE) AS month_start,
  CAST(date_trunc('month', client_ts) + INTERVAL 1 MONTH AS DATE) AS month_end, CAST(client_ts AS DATE) - 14 AS two_weeks_ago, client_ts < TIMESTAMP '2024-01-30 23:55:00' - INTERVAL 5 MINUTE AS idle FROM learning_events""")
def h10(t: Tables):
    ts = F.col("client_ts")
    monday, month = F.to_date(F.date_trunc("week", ts)), F.to_date(F.date_trunc("month", ts))
    idle = ts < F.lit("2024-01-30 23:55:00").cast("timestamp") - F.expr("interval 5 minutes")
    return t.learning_events.select("event_id", F.to_date(ts).alias("day"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"), month.alias("month_start"), F.add_months(month, 1).alias("month_end"), F.date_sub(F.to_date(ts), 14).alias("two_weeks_ago"), idle.alias("idle"))


@query("H15_recurrence", "SELECT class_id, CAST(d AS DATE) AS day, n = 1 AS is_parent FROM (SELECT class_id, d, row_number() OVER (PARTITION BY class_id ORDER BY d) AS n FROM classes, unnest(generate_series(DATE '2024-01-01' + CAST(class_id % 7 AS INTEGER), DATE '2024-01-01' + CAST(class_id % 7 AS INTEGER) + 84, INTERVAL 7 DAY)) u(d))")
def h15(t: Tables):
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("class_id") % 7).cast("int"))
    days = F.posexplode(F.sequence(start, F.date_add(start, 84), F.expr("interval 7 days")))
    return t.classes.select("class_id", days.alias("i", "day")).select("class_id", "day", (F.col("i") == 0).alias("is_parent"))


@query("H17_text_normalisation", r"""SELECT problem_id, regexp_replace(lower(trim(concat('  ', stem, ' X '))), '\s+', '', 'g') AS answer, translate('①③⑤', '①②③④⑤', '12345') AS digits, try_cast(nullif(regexp_extract(concat('Q', problem_id, '. x'), '^\D*(\d+)', 1), '') AS INTEGER) AS number,
  regexp_replace(concat(stem, chr(13), chr(10), 'b', chr(13)), '\r\n?', chr(10), 'g') AS unix, substring(stem, 1, 5) AS cut, string_split(concat(subject, '::', coalesce(unit, '')), '::')[2] AS unit_part FROM problems""")
def h17(t: Tables):
    stem = F.col("stem")
    return t.problems.select(
        "problem_id",
        N.normalized_answer(F.concat(F.lit("  "), stem, F.lit(" X "))).alias("answer"),
        N.circled_to_digit(F.lit("①③⑤")).alias("digits"),
        F.nullif(F.regexp_extract(F.concat(F.lit("Q"), F.col("problem_id").cast("string"), F.lit(". x")), r"^\D*(\d+)", 1), F.lit("")).cast("int").alias("number"),
        F.regexp_replace(F.concat(stem, F.lit("\r\nb\r")), r"\r\n?", "\n").alias("unix"),
        F.substring(stem, 1, 5).alias("cut"),
        F.split(F.concat_ws("::", "subject", F.coalesce("unit", F.lit(""))), "::", -1)[1].alias("unit_part"),
    )


@query("H19_latex_answer", r"""SELECT problem_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\\(?:text|boxed|mathrm)\{([^{}]*)\}', '\1', 'g'), '\\[()\[\]]|\$', '', 'g'), '[.。]\s*$', '', 'g'), '\s+', '', 'g')) AS answer FROM (SELECT problem_id, concat('\boxed{', stem, '} $', difficulty, '$.') AS a FROM problems)""")
def h19(t: Tables):
    raw = F.concat(F.lit("\\boxed{"), F.col("stem"), F.lit("} $"), F.col("difficulty").cast("string"), F.lit("$."))
    return t.problems.select("problem_id", N.latex_answer(raw).alias("answer"))


@query("H24_regex_functions", r"""SELECT doc_id, regexp_matches(text, '[0-9]{3,}') AS has_number, nullif(regexp_extract(text, '([A-Za-z]+)\.', 1), '') AS first_end, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT) AS capitals FROM documents""")
def h24(t: Tables):
    return t.documents.select("doc_id", F.col("text").rlike("[0-9]{3,}").alias("has_number"), F.nullif(F.regexp_extract("text", r"([A-Za-z]+)\.", 1), F.lit("")).alias("first_end"), F.regexp_count("text", F.lit("[A-Z][a-z]+")).cast("long").alias("capitals"))


@query("H25_embedding_text", "SELECT problem_id, concat_ws(chr(10), subject, unit, stem) AS body, sha256(concat_ws(chr(10), subject, unit, stem)) AS hash FROM problems")
def h25(t: Tables):
    body = F.concat_ws("\n", "subject", "unit", "stem")
    return t.problems.select("problem_id", body.alias("body"), F.sha2(body, 256).alias("hash"))


@query("H26_keyword_hits", "SELECT problem_id, CAST(contains(stem, 'red') AS INTEGER) + CAST(contains(stem, 'ring') AS INTEGER) + CAST(contains(stem, 'small') AS INTEGER) AS hits FROM problems")
def h26(t: Tables):
    words = F.array(*map(F.lit, ("red", "ring", "small")))
    return t.problems.select("problem_id", F.size(F.filter(words, lambda w: F.contains(F.col("stem"), w))).alias("hits"))


@query("H30_record_diff", "WITH o AS (SELECT * FROM problems), n AS (SELECT problem_id, CASE WHEN problem_id % 3 = 0 THEN 'X' ELSE subject END AS subject, unit, CASE WHEN problem_id % 2 = 0 THEN difficulty + 1 ELSE difficulty END AS difficulty FROM problems) SELECT problem_id, concat_ws(',', CASE WHEN o.subject IS DISTINCT FROM n.subject THEN 'subject' END, CASE WHEN o.unit IS DISTINCT FROM n.unit THEN 'unit' END, CASE WHEN o.difficulty IS DISTINCT FROM n.difficulty THEN 'difficulty' END) AS changed FROM o JOIN n USING (problem_id)")
def h30(t: Tables):
    from ..operators.documents import changed_fields

    old = t.problems.select("problem_id", "subject", "unit", "difficulty")
    new = old.withColumns({"subject": F.when(F.col("problem_id") % 3 == 0, "X").otherwise(F.col("subject")), "difficulty": F.when(F.col("problem_id") % 2 == 0, F.col("difficulty") + 1).otherwise(F.col("difficulty"))})
    return changed_fields(old, new, "problem_id", ["subject", "unit", "difficulty"])


@query("H31_json_reads", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_type(payload, '$.isCorrect') = 'BOOLEAN' AND json_extract_string(payload, '$.isCorrect') = 'true' AS right_answer, CASE WHEN json_type(payload, '$.durationMs') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(payload, '$.durationMs') AS DOUBLE) END AS duration FROM learning_events")
def h31(t: Tables):
    payload = F.col("payload")
    there = F.get_json_object(payload, "$.isCorrect").isNotNull()
    right = F.when(there, F.coalesce(N.json_boolean(payload, "$.isCorrect"), F.lit(False)))
    return t.learning_events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), right.alias("right_answer"), N.json_number(payload, "$.durationMs").alias("duration"))


@query("H33_array_functions", "SELECT submission_id, array_to_string(list_sort(list_distinct(list(problem_id))), ',') AS uniq, len(list_filter(list(problem_id), lambda x: x % 2 = 0)) AS evens, list_contains(list(problem_id), 5) AS has5 FROM answers GROUP BY submission_id")
def h33(t: Tables):
    got = t.answers.groupBy("submission_id").agg(F.collect_list("problem_id").alias("ps"))
    return got.select("submission_id", F.array_join(F.transform(F.array_sort(F.array_distinct("ps")), lambda x: x.cast("string")), ",").alias("uniq"), F.size(F.filter("ps", lambda x: x % 2 == 0)).cast("long").alias("evens"), F.array_contains("ps", F.lit(5).cast("long")).alias("has5"))


@query("H35_exact_median", "SELECT subject, median(time_sec) AS median_time, greatest(18, 0.85 * median(time_sec)) AS threshold FROM problems GROUP BY subject")
def h35(t: Tables):
    median = F.percentile("time_sec", 0.5)
    return t.problems.groupBy("subject").agg(median.alias("median_time")).withColumn("threshold", F.greatest(F.lit(18.0), 0.85 * F.col("median_time")))


@query("H36_error_type_inference", "SELECT problem_id, CASE WHEN difficulty <= 2 THEN 'careless' WHEN problem_type = 'essay' THEN 'concept' WHEN problem_type = 'short_answer' THEN 'calculation' ELSE 'pattern' END AS error_type FROM problems")
def h36(t: Tables):
    d = F.col("difficulty")
    kind = F.when(d <= 2, "careless").when(F.col("problem_type") == "essay", "concept").when(F.col("problem_type") == "short_answer", "calculation").otherwise("pattern")
    return t.problems.select("problem_id", kind.alias("error_type"))


@query("H38_label_lookup", "SELECT c.node_id, coalesce(l3.node_id, l2.node_id, l1.node_id) AS found FROM (SELECT node_id, label, CASE WHEN level = 3 THEN label WHEN level = 2 THEN label ELSE label END AS k FROM nodes) c LEFT JOIN (SELECT label, min(node_id) AS node_id FROM nodes WHERE level = 3 GROUP BY 1) l3 ON l3.label = c.k LEFT JOIN (SELECT label, min(node_id) AS node_id FROM nodes WHERE level = 2 GROUP BY 1) l2 ON l2.label = c.k LEFT JOIN (SELECT label, min(node_id) AS node_id FROM nodes WHERE level = 1 GROUP BY 1) l1 ON l1.label = c.k")
def h38(t: Tables):
    nodes = t.nodes
    out = nodes.select("node_id", "label")
    for level in (3, 2, 1):
        named = nodes.where(F.col("level") == level).groupBy("label").agg(F.min("node_id").alias(f"at{level}"))
        out = out.join(named, "label", "left")
    return out.select("node_id", F.coalesce("at3", "at2", "at1").alias("found"))


@query("H41_difficulty_band", "SELECT problem_id, CASE WHEN p < 0.4 THEN 1 WHEN p <= 0.7 THEN 2 ELSE 3 END AS low, CASE WHEN p < 0.4 THEN 2 WHEN p <= 0.7 THEN 3 ELSE 4 END AS high FROM (SELECT problem_id, CAST(count(*) FILTER (WHERE is_correct) AS DOUBLE) / count(*) AS p FROM answers WHERE is_correct IS NOT NULL GROUP BY 1)")
def h41(t: Tables):
    p = F.col("p_value")
    low = F.when(p < 0.4, 1).when(p <= 0.7, 2).otherwise(3)
    return A.item_p_values(t.answers).select("problem_id", low.alias("low"), (low + 1).alias("high"))


@query("H42_xml_functions", r"""SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_plain, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS n_escaped, true AS round_trip FROM pages""")
def h42(t: Tables):
    escaped = N.xml_escape(F.col("html"))
    return t.pages.select("page_id", F.length(N.strip_tags(F.col("html"))).cast("long").alias("n_plain"), F.length(escaped).cast("long").alias("n_escaped"), (N.xml_unescape(escaped) == F.col("html")).alias("round_trip"))


@query("R1_subtree_filter", "WITH RECURSIVE tree AS (SELECT node_id FROM nodes WHERE node_id = 'r2' UNION ALL SELECT n.node_id FROM nodes n JOIN tree t ON n.parent_id = t.node_id) SELECT node_id FROM tree")
def r1(t: Tables):
    return G.subtree(t.nodes, "r2")


@query("R2_tree_build", "SELECT p.node_id, count(*) AS n_children, string_agg(c.node_id, ',' ORDER BY c.label, c.node_id) AS children FROM nodes p JOIN nodes c ON c.parent_id = p.node_id GROUP BY p.node_id")
def r2(t: Tables):
    children = F.array_sort(F.collect_list(F.struct("label", "node_id")))
    grouped = t.nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n_children"), children.alias("c"))
    return grouped.select("node_id", "n_children", F.array_join(F.transform("c", lambda x: x["node_id"]), ",").alias("children"))


@query("R3_tree_with_mastery", """SELECT n.node_id, n.parent_id, coalesce(m.c, 0) AS correct, coalesce(m.k, 0) AS total FROM nodes n LEFT JOIN (SELECT concat('n', node_id) AS node_id, count(*) FILTER (WHERE is_correct) AS c, count(is_correct) AS k FROM answers JOIN problems USING (problem_id) GROUP BY 1) m USING (node_id)""")
def r3(t: Tables):
    joined = t.answers.join(t.problems, "problem_id").groupBy(F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("node_id"))
    return t.nodes.join(joined.agg(F.count_if("is_correct").alias("correct"), F.count("is_correct").alias("total")), "node_id", "left").select("node_id", "parent_id", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("total", F.lit(0)).alias("total"))


@query("R4_mastery_map", "SELECT subject, unit, count(*) FILTER (WHERE is_correct) AS correct, count(is_correct) AS total FROM answers JOIN problems USING (problem_id) WHERE unit IS NOT NULL GROUP BY 1, 2")
def r4(t: Tables):
    return t.answers.join(t.problems.where("unit is not null"), "problem_id").groupBy("subject", "unit").agg(F.count_if("is_correct").alias("correct"), F.count("is_correct").alias("total"))


NODE_ACCURACY = "SELECT node_id AS node, 100.0 * count(*) FILTER (WHERE is_correct) / count(*) AS accuracy FROM answers JOIN problems USING (problem_id) WHERE is_correct IS NOT NULL GROUP BY 1"


@query("R5_knowledge_graph_nodes", f"SELECT node, CAST(floor(accuracy + 0.5) AS BIGINT) AS accuracy FROM (SELECT from_node AS node FROM prerequisites UNION SELECT to_node FROM prerequisites UNION SELECT node FROM ({NODE_ACCURACY})) LEFT JOIN ({NODE_ACCURACY}) USING (node)")
def r5(t: Tables):
    graded = t.answers.where("is_correct is not null").join(t.problems, "problem_id")
    accuracy = graded.groupBy(F.col("node_id").alias("node")).agg(N.js_round(100 * F.count_if("is_correct") / F.count("*")).alias("accuracy"))
    ends = t.prerequisites.select(F.explode(F.array("from_node", "to_node")).alias("node"))
    return ends.union(accuracy.select("node")).distinct().join(accuracy, "node", "left")


@query("R6_weakness_roots", """WITH RECURSIVE acc AS (SELECT student_id, node_id AS node, 100.0 * count(*) FILTER (WHERE is_correct) / count(*) AS a FROM answers JOIN submissions USING (submission_id) JOIN problems USING (problem_id) WHERE is_correct IS NOT NULL GROUP BY 1, 2),
  steps AS (SELECT s.student_id, e.from_node, e.to_node FROM (SELECT DISTINCT student_id FROM acc) s CROSS JOIN prerequisites e LEFT JOIN acc y ON y.student_id = s.student_id AND y.node = e.from_node WHERE coalesce(y.a, -1) < 50),
  climb AS (SELECT student_id, node FROM acc WHERE a < 50 UNION SELECT c.student_id, e.from_node FROM climb c JOIN steps e ON e.student_id = c.student_id AND e.to_node = c.node)
  SELECT DISTINCT c.student_id, c.node AS root FROM climb c LEFT JOIN steps e ON e.student_id = c.student_id AND e.to_node = c.node WHERE e.to_node IS NULL""")
def r6(t: Tables):
    joined = t.answers.where("is_correct is not null").join(t.submissions, "submission_id").join(t.problems, "problem_id")
    accuracy = joined.groupBy("student_id", F.col("node_id").alias("node")).agg((100 * F.count_if("is_correct") / F.count("*")).alias("accuracy"))
    return G.weakness_roots(accuracy, t.prerequisites, "student_id")


@query("R7_topological_layers", "WITH RECURSIVE walk AS (SELECT DISTINCT from_node AS node, 0 AS layer FROM prerequisites UNION SELECT e.to_node, w.layer + 1 FROM walk w JOIN prerequisites e ON e.from_node = w.node) SELECT node, CAST(max(layer) AS INTEGER) AS layer FROM walk GROUP BY node")
def r7(t: Tables):
    return G.layers(t.prerequisites)


@query("R8_sub_problem_hierarchy", "SELECT c.problem_id, p.problem_id AS parent_id FROM problems c JOIN problems p ON p.problem_id = c.problem_id // 10 AND p.problem_id < c.problem_id")
def r8(t: Tables):
    parents = t.problems.select(F.col("problem_id").alias("parent_id"))
    return t.problems.select("problem_id", F.expr("problem_id div 10").alias("parent_id")).where("parent_id < problem_id").join(parents, "parent_id")


@query("R9_taxonomy_lookup", "SELECT p.problem_id, n.label AS topic, r.label AS area FROM problems p JOIN nodes n ON n.node_id = concat('n', p.node_id) JOIN nodes r ON r.node_id = n.parent_id")
def r9(t: Tables):
    topics = t.nodes.where("level = 2").alias("n").join(t.nodes.where("level = 1").alias("r"), F.col("n.parent_id") == F.col("r.node_id")).select(F.col("n.node_id").alias("key"), F.col("n.label").alias("topic"), F.col("r.label").alias("area"))
    return t.problems.select("problem_id", F.concat(F.lit("n"), F.col("node_id").cast("string")).alias("key")).join(topics, "key").drop("key")


#: Prerequisites as a tree of many levels: each unit below half its number.
CHAIN = "SELECT CAST(n_nationkey AS STRING) AS node_id, CASE WHEN n_nationkey > 0 THEN CAST(CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey - 1 ELSE floor(n_nationkey / 2) END AS BIGINT) AS STRING) END AS parent_id, n_name AS label, 0 AS level FROM {nation}"


@query("R1_deep_subtree", f"WITH RECURSIVE c AS ({CHAIN.format(nation='nation')}), tree AS (SELECT node_id FROM c WHERE node_id = '2' UNION ALL SELECT c.node_id FROM c JOIN tree t ON c.parent_id = t.node_id) SELECT node_id FROM tree")
def r1_deep(t: Tables):
    return G.subtree(t.spark.sql(CHAIN, nation=t.nation), "2")


@query("R10_deep_flatten", f"WITH RECURSIVE c AS ({CHAIN.format(nation='nation')}), tree AS (SELECT node_id, label AS path FROM c WHERE parent_id IS NULL UNION ALL SELECT c.node_id, concat_ws('/', t.path, c.label) FROM c JOIN tree t ON c.parent_id = t.node_id) SELECT node_id, path FROM tree")
def r10_deep(t: Tables):
    return G.paths(t.spark.sql(CHAIN, nation=t.nation)).select("node_id", "path")


@query("R10_tree_flatten", "SELECT n.node_id, concat_ws('/', r.label, n.label) AS path FROM nodes n JOIN nodes r ON r.node_id = n.parent_id WHERE n.level = 2 UNION ALL SELECT node_id, label FROM nodes WHERE level = 1 UNION ALL SELECT c.node_id, concat_ws('/', r.label, n.label, c.label) FROM nodes c JOIN nodes n ON n.node_id = c.parent_id JOIN nodes r ON r.node_id = n.parent_id WHERE c.level = 3")
def r10(t: Tables):
    return G.paths(t.nodes).select("node_id", "path")


@query("R11_tree_rollup", "SELECT r.node_id, count(*) AS leaves, count(*) FILTER (WHERE c.label LIKE '%7') AS marked FROM nodes c JOIN nodes n ON n.node_id = c.parent_id JOIN nodes r ON r.node_id = n.parent_id WHERE c.level = 3 GROUP BY r.node_id")
def r11(t: Tables):
    nodes = t.nodes
    leaves = nodes.where("level = 3").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("leaves"), F.count_if(F.col("label").like("%7")).alias("marked"))
    upper = leaves.join(nodes.select("node_id", "parent_id"), "node_id").groupBy(F.col("parent_id").alias("node_id"))
    return upper.agg(F.sum("leaves").alias("leaves"), F.sum("marked").alias("marked"))
