"""Scans, filters, joins, set operations, sorting and table rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import tables as O
from ..sources.domain import Tables
from .registry import query


@query("A1_table_scan", "SELECT problem_id, subject, difficulty FROM problems WHERE review_status = 'approved' AND difficulty >= 4")
def a1(t: Tables):
    return t.problems.where("review_status = 'approved' and difficulty >= 4").select("problem_id", "subject", "difficulty")


@query("A2_point_lookup", "SELECT submission_id, student_id, status, score FROM submissions WHERE submission_id = 17")
def a2(t: Tables):
    return t.submissions.where("submission_id = 17").select("submission_id", "student_id", "status", "score")


@query("A3_ordered_multi_get", "SELECT i.position, p.problem_id, p.subject FROM (VALUES (0, 42), (1, 7), (2, 999999), (3, 13)) i(position, id) JOIN problems p ON p.problem_id = i.id")
def a3(t: Tables):
    return O.ordered_lookup(t.problems, "problem_id", [42, 7, 999999, 13]).select("position", "problem_id", "subject")


@query("A10_keyed_upsert", """WITH daily AS (SELECT student_id, CAST(client_ts AS DATE) AS day, count(*) AS n FROM learning_events WHERE client_ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
  fresh AS (SELECT student_id, CAST(client_ts AS DATE) AS day, count(*) AS n FROM learning_events WHERE client_ts >= TIMESTAMP '2024-01-15' GROUP BY ALL)
  SELECT * FROM fresh UNION ALL SELECT d.* FROM daily d WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.student_id = d.student_id AND f.day = d.day)""")
def a10(t: Tables):
    by_day = lambda df: df.groupBy("student_id", F.to_date("client_ts").alias("day")).agg(F.count("*").alias("n"))
    events = t.learning_events
    return O.keyed_upsert(by_day(events.where("client_ts < timestamp'2024-01-20'")), by_day(events.where("client_ts >= timestamp'2024-01-15'")), ["student_id", "day"])


@query("A14_source_registry_dedup", """SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY source, sha256(text)) AS registered_as,
  doc_id = min(doc_id) OVER (PARTITION BY source, sha256(text)) AS is_new FROM documents""")
def a14(t: Tables):
    hashed = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    first = hashed.groupBy("source", "content_hash").agg(F.min("doc_id").alias("registered_as"))
    return hashed.join(first, ["source", "content_hash"]).select("doc_id", "content_hash", "registered_as", (F.col("doc_id") == F.col("registered_as")).alias("is_new"))


@query("A16_insert_select", "SELECT student_id, class_id, CAST(30000 AS INTEGER) AS amount, 'pending' AS status, '2024-02' AS billing_month FROM students")
def a16(t: Tables):
    return t.students.select("student_id", "class_id", F.lit(30000).alias("amount"), F.lit("pending").alias("status"), F.lit("2024-02").alias("billing_month"))


@query("A17_conditional_bulk_update", """SELECT submission_id, CASE WHEN status = 'submitted' AND submitted_at < TIMESTAMP '1997-01-01' THEN 'late' ELSE status END AS status,
  status = 'submitted' AND submitted_at < TIMESTAMP '1997-01-01' AS changed FROM submissions""")
def a17(t: Tables):
    stale = (F.col("status") == "submitted") & (F.col("submitted_at") < F.lit("1997-01-01").cast("timestamp"))
    return O.conditional_update(t.submissions, stale, status=F.lit("late")).select("submission_id", "status", "changed")


@query("A18_cascade_delete", """SELECT a.submission_id, count(*) AS n_answers FROM answers a WHERE a.submission_id NOT IN (SELECT submission_id FROM submissions WHERE status = 'returned') GROUP BY a.submission_id""")
def a18(t: Tables):
    gone = t.submissions.where("status = 'returned'").select("submission_id")
    left = O.cascade_delete(t.submissions, {"answers": (t.answers, "submission_id")}, gone, "submission_id")["answers"]
    return left.groupBy("submission_id").agg(F.count("*").alias("n_answers"))


@query("B1_dynamic_filter", "SELECT problem_id FROM problems WHERE subject = 'Brand#3' AND difficulty = 2")
def b1(t: Tables):
    return t.problems.where(O.equals_if_given(subject="Brand#3", difficulty=2, unit=None)).select("problem_id")


@query("B2_optional_parameters", "SELECT problem_id, unit FROM problems WHERE (NULL IS NULL OR subject = NULL) AND unit = 'PROMO'")
def b2(t: Tables):
    return t.problems.where(O.equals_if_given(subject=None, unit="PROMO")).select("problem_id", "unit")


@query("B3_in_list", "SELECT submission_id, status FROM submissions WHERE status IN ('graded', 'returned')")
def b3(t: Tables):
    return t.submissions.where(F.col("status").isin("graded", "returned")).select("submission_id", "status")


@query("B4_not_in", "SELECT problem_id FROM problems WHERE problem_id NOT IN (SELECT problem_id FROM answers WHERE is_correct)")
def b4(t: Tables):
    return O.excluding(t.problems, t.answers.where("is_correct"), ["problem_id"]).select("problem_id")


@query("B5_closed_range", "SELECT submission_id, score FROM submissions WHERE score BETWEEN 40 AND 60")
def b5(t: Tables):
    return t.submissions.where(F.col("score").between(40, 60)).select("submission_id", "score")


@query("B6_half_open_range", "SELECT event_id, client_ts FROM learning_events WHERE client_ts >= TIMESTAMP '2024-01-05' AND client_ts < TIMESTAMP '2024-01-06'")
def b6(t: Tables):
    return t.learning_events.where("client_ts >= timestamp'2024-01-05' and client_ts < timestamp'2024-01-06'").select("event_id", "client_ts")


@query("B7_or_group", "SELECT submission_id FROM submissions WHERE class_id = 3 OR score >= 90")
def b7(t: Tables):
    return t.submissions.where((F.col("class_id") == 3) | (F.col("score") >= 90)).select("submission_id")


@query("B8_substring_ignore_case", "SELECT problem_id, stem FROM problems WHERE contains(lower(stem), lower('RED'))")
def b8(t: Tables):
    return t.problems.where(F.contains(F.lower("stem"), F.lower(F.lit("RED")))).select("problem_id", "stem")


@query("B9_json_like", "SELECT problem_id FROM problems WHERE json_extract_string(source_json, '$.title') LIKE '%ring%'")
def b9(t: Tables):
    return t.problems.where(F.get_json_object("source_json", "$.title").like("%ring%")).select("problem_id")


@query("B10_json_path_equality", "SELECT problem_id, CAST(json_extract_string(source_json, '$.year') AS INTEGER) AS year FROM problems WHERE CAST(json_extract_string(source_json, '$.year') AS INTEGER) = 2018")
def b10(t: Tables):
    return t.problems.select("problem_id", F.get_json_object("source_json", "$.year").cast("int").alias("year")).where("year = 2018")


@query("B11_array_contains", "SELECT problem_id FROM problems WHERE list_contains(string_split(stem, ' '), 'ring')")
def b11(t: Tables):
    return t.problems.where(F.array_contains(F.split("stem", " "), "ring")).select("problem_id")


@query("B12_json_type_guard", "SELECT event_id, json_type(payload, '$.isCorrect') = 'BOOLEAN' AS typed FROM learning_events WHERE json_type(payload) = 'OBJECT' AND json_extract(payload, '$.isCorrect') IS NOT NULL")
def b12(t: Tables):
    v = F.try_parse_json("payload")
    typed = F.schema_of_variant(F.try_variant_get(v, "$.isCorrect", "variant"))
    return t.learning_events.where(F.schema_of_variant(v).startswith("OBJECT")).select("event_id", (typed == "BOOLEAN").alias("typed")).where("typed is not null")


@query("B13_array_any_match", "SELECT submission_id FROM (SELECT submission_id, list(problem_id) AS ps FROM answers GROUP BY submission_id) WHERE len(list_filter(ps, lambda p: p % 100 = 7)) > 0")
def b13(t: Tables):
    grouped = t.answers.groupBy("submission_id").agg(F.collect_list("problem_id").alias("ps"))
    return grouped.where(F.exists("ps", lambda p: p % 100 == 7)).select("submission_id")


@query("B14_is_null", "SELECT submission_id, problem_id, order_index FROM answers WHERE is_correct IS NULL")
def b14(t: Tables):
    return t.answers.where(F.col("is_correct").isNull()).select("submission_id", "problem_id", "order_index")


@query("B15_row_level_security", "SELECT s.submission_id FROM submissions s JOIN students u USING (student_id) JOIN classes c ON c.class_id = u.class_id WHERE c.organization_id = 2")
def b15(t: Tables):
    mine = O.visible_students(t.students, t.classes, "teacher", organization=2)
    return t.submissions.join(mine, "student_id", "left_semi").select("submission_id")


@query("B16_soft_delete", "SELECT problem_id FROM problems WHERE unit IS NULL")
def b16(t: Tables):
    return t.problems.where("unit is null").select("problem_id")


@query("B17_document_scope", "SELECT doc_id, CASE WHEN source = 'src1' THEN 'mine' WHEN lang = 'en' THEN 'shared' END AS scope FROM documents WHERE source = 'src1' OR lang = 'en'")
def b17(t: Tables):
    scope = F.when(F.col("source") == "src1", "mine").when(F.col("lang") == "en", "shared")
    return t.documents.select("doc_id", scope.alias("scope")).where("scope is not null")


@query("B18_projection", "SELECT problem_id AS id, subject, CASE WHEN review_status = 'approved' THEN stem END AS visible_stem FROM problems")
def b18(t: Tables):
    return t.problems.select(F.col("problem_id").alias("id"), "subject", F.when(F.col("review_status") == "approved", F.col("stem")).alias("visible_stem"))


@query("B19_empty_or_null", "SELECT problem_id, coalesce(nullif(unit, ''), 'none') AS unit FROM problems")
def b19(t: Tables):
    return t.problems.select("problem_id", N.or_else(F.col("unit"), "none").alias("unit"))


@query("B20_rate_limit", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY student_id, date_trunc('hour', client_ts) ORDER BY client_ts, event_id) AS n FROM learning_events) WHERE n <= 2")
def b20(t: Tables):
    w = Window.partitionBy("student_id", F.date_trunc("hour", "client_ts")).orderBy("client_ts", "event_id")
    return t.learning_events.withColumn("n", F.row_number().over(w)).where("n <= 2").select("event_id")


@query("C1_inner_join_chain", "SELECT s.class_id, s.status, count(*) AS n FROM answers a JOIN submissions s USING (submission_id) JOIN assignments g USING (assignment_id) GROUP BY s.class_id, s.status")
def c1(t: Tables):
    joined = t.answers.join(t.submissions, "submission_id").join(t.assignments.select("assignment_id"), "assignment_id")
    return joined.groupBy("class_id", "status").agg(F.count("*").alias("n"))


@query("C2_left_outer_join", "SELECT a.submission_id, a.order_index, a.problem_id, p.subject FROM answers a LEFT JOIN (SELECT * FROM problems WHERE difficulty > 3) p USING (problem_id)")
def c2(t: Tables):
    return t.answers.join(t.problems.where("difficulty > 3"), "problem_id", "left").select("submission_id", "order_index", "problem_id", "subject")


@query("C3_left_join_filtered_right", "SELECT u.student_id, count(s.submission_id) AS n FROM students u LEFT JOIN submissions s ON s.student_id = u.student_id AND s.status = 'graded' AND s.score >= 80 GROUP BY u.student_id")
def c3(t: Tables):
    good = t.submissions.where("status = 'graded' and score >= 80").select("student_id", "submission_id")
    return t.students.join(good, "student_id", "left").groupBy("student_id").agg(F.count("submission_id").alias("n"))


@query("C4_semi_join", "SELECT submission_id FROM submissions WHERE assignment_id IN (SELECT assignment_id FROM assignments WHERE class_id = 4)")
def c4(t: Tables):
    return t.submissions.join(t.assignments.where("class_id = 4"), "assignment_id", "left_semi").select("submission_id")


@query("C5_relation_exists", "SELECT student_id FROM students u WHERE EXISTS (SELECT 1 FROM submissions s WHERE s.student_id = u.student_id AND s.status = 'submitted')")
def c5(t: Tables):
    return t.students.join(t.submissions.where("status = 'submitted'"), "student_id", "left_semi").select("student_id")


@query("C6_stale_statistics", """WITH stats AS (SELECT problem_id, max(answered_at) AS computed_at FROM answers WHERE answered_at < TIMESTAMP '1999-01-01' GROUP BY problem_id)
  SELECT DISTINCT a.problem_id FROM answers a WHERE a.is_correct IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stats s WHERE s.problem_id = a.problem_id AND s.computed_at >= a.answered_at)""")
def c6(t: Tables):
    answers = t.answers
    stats = answers.where("answered_at < timestamp'1999-01-01'").groupBy(F.col("problem_id").alias("p")).agg(F.max("answered_at").alias("computed_at"))
    fresh = (answers["problem_id"] == stats["p"]) & (stats["computed_at"] >= answers["answered_at"])
    return answers.where("is_correct is not null").join(stats, fresh, "left_anti").select("problem_id").distinct()


@query("C7_full_outer_join", """WITH l AS (SELECT student_id, count(*) AS n FROM submissions WHERE score >= 95 GROUP BY student_id), r AS (SELECT student_id, count(*) AS m FROM learning_events WHERE value > 60 GROUP BY student_id)
  SELECT coalesce(l.student_id, r.student_id) AS student_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM l FULL JOIN r ON l.student_id = r.student_id""")
def c7(t: Tables):
    left = t.submissions.where("score >= 95").groupBy("student_id").agg(F.count("*").alias("n"))
    right = t.learning_events.where("value > 60").groupBy("student_id").agg(F.count("*").alias("m"))
    return left.join(right, "student_id", "full").na.fill(0, ["n", "m"])


@query("C8_self_join", "SELECT c.node_id, p.label AS parent_label, g.label AS grand_label FROM nodes c JOIN nodes p ON c.parent_id = p.node_id LEFT JOIN nodes g ON p.parent_id = g.node_id")
def c8(t: Tables):
    n = t.nodes
    c, p, g = n.alias("c"), n.alias("p"), n.alias("g")
    joined = c.join(p, F.col("c.parent_id") == F.col("p.node_id")).join(g, F.col("p.parent_id") == F.col("g.node_id"), "left")
    return joined.select("c.node_id", F.col("p.label").alias("parent_label"), F.col("g.label").alias("grand_label"))


# Nine grade bands, as (grade, least score).
BANDS = [(1, 92), (2, 85), (3, 76), (4, 64), (5, 50), (6, 36), (7, 24), (8, 12), (9, 0)]


@query("C9_range_join", """WITH bands AS (SELECT * FROM (VALUES (1, 92, 101), (2, 85, 92), (3, 76, 85), (4, 64, 76), (5, 50, 64), (6, 36, 50), (7, 24, 36), (8, 12, 24), (9, 0, 12)) b(grade, low, high))
  SELECT submission_id, grade FROM submissions JOIN bands ON score >= low AND score < high""")
def c9(t: Tables):
    uppers = [101, *(low for _, low in BANDS[:-1])]
    bands = t.spark.createDataFrame([(g, low, up) for (g, low), up in zip(BANDS, uppers, strict=True)], "grade int, low int, high int")
    # nine rows: the only side that is ever broadcast here has a fixed size
    return t.submissions.join(F.broadcast(bands), (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high"))).select("submission_id", "grade")


@query("C10_hash_join_one_to_one", "SELECT s.submission_id, u.name, c.title FROM submissions s LEFT JOIN students u USING (student_id) LEFT JOIN classes c ON c.class_id = u.class_id")
def c10(t: Tables):
    return t.submissions.select("submission_id", "student_id").join(t.students.select("student_id", "name", "class_id"), "student_id", "left").join(t.classes, "class_id", "left").select("submission_id", "name", "title")


@query("C11_composite_key_join", """WITH w AS (SELECT DISTINCT submission_id, problem_id FROM answers WHERE is_correct = false)
  SELECT w.submission_id, w.problem_id, count(*) AS tries, count(a.is_correct) AS graded FROM w LEFT JOIN answers a ON a.submission_id = w.submission_id AND a.problem_id = w.problem_id GROUP BY w.submission_id, w.problem_id""")
def c11(t: Tables):
    wrong = t.answers.where("is_correct = false").select("submission_id", "problem_id").distinct()
    return wrong.join(t.answers, ["submission_id", "problem_id"], "left").groupBy("submission_id", "problem_id").agg(F.count("*").alias("tries"), F.count("is_correct").alias("graded"))


@query("C12_two_hop_filter", "SELECT a.submission_id, a.order_index, a.problem_id FROM answers a JOIN submissions s USING (submission_id) JOIN classes c ON c.class_id = s.class_id WHERE c.organization_id = 1")
def c12(t: Tables):
    mine = t.submissions.join(t.classes.where("organization_id = 1"), "class_id", "left_semi").select("submission_id")
    return t.answers.join(mine, "submission_id", "left_semi").select("submission_id", "order_index", "problem_id")


@query("C13_ordered_bridge", "SELECT submission_id, string_agg(CAST(problem_id AS VARCHAR), ',' ORDER BY answer_no) AS problems FROM numbered_answers GROUP BY submission_id")
def c13(t: Tables):
    ordered = F.array_sort(F.collect_list(F.struct("answer_no", "problem_id")))
    return t.numbered_answers.groupBy("submission_id").agg(F.array_join(F.transform(ordered, lambda x: x["problem_id"].cast("string")), ",").alias("problems"))


@query("C14_latest_one", "SELECT student_id, submission_id FROM (SELECT student_id, submission_id, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, submission_id DESC) AS n FROM submissions) WHERE n = 1")
def c14(t: Tables):
    return t.submissions.groupBy("student_id").agg(F.max_by("submission_id", F.struct("submitted_at", "submission_id")).alias("submission_id"))


@query("C15_relation_count", "SELECT c.class_id, count(s.student_id) AS n_students FROM classes c LEFT JOIN students s ON s.class_id = c.class_id GROUP BY c.class_id")
def c15(t: Tables):
    counts = t.students.groupBy("class_id").agg(F.count("*").alias("n_students"))
    return t.classes.join(counts, "class_id", "left").select("class_id", F.coalesce("n_students", F.lit(0)).alias("n_students"))


@query("C16_precedence_join", """WITH own AS (SELECT problem_id, min(student_answer) AS a FROM answers WHERE is_correct GROUP BY problem_id), quick AS (SELECT problem_id, max(student_answer) AS b FROM answers WHERE is_correct = false GROUP BY problem_id)
  SELECT p.problem_id, coalesce(own.a, quick.b) AS answer, CASE WHEN own.a IS NOT NULL THEN 1.0 WHEN quick.b IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence
  FROM problems p LEFT JOIN own USING (problem_id) LEFT JOIN quick USING (problem_id)""")
def c16(t: Tables):
    own = t.answers.where("is_correct").groupBy("problem_id").agg(F.min("student_answer").alias("a"))
    quick = t.answers.where("is_correct = false").groupBy("problem_id").agg(F.max("student_answer").alias("b"))
    joined = t.problems.select("problem_id").join(own, "problem_id", "left").join(quick, "problem_id", "left")
    return joined.select("problem_id", F.coalesce("a", "b").alias("answer"), F.when(F.col("a").isNotNull(), 1.0).when(F.col("b").isNotNull(), 0.9).otherwise(0.0).alias("confidence"))


@query("C17_delete_using", """SELECT submission_id FROM submissions WHERE submission_id NOT IN
  (SELECT submission_id FROM (SELECT submission_id, row_number() OVER (PARTITION BY assignment_id, student_id ORDER BY submitted_at DESC, submission_id DESC) AS n FROM submissions) WHERE n > 1)""")
def c17(t: Tables):
    best = O.latest_per(t.submissions, ["assignment_id", "student_id"], F.desc("submitted_at"), F.desc("submission_id"))
    return best.select("submission_id")


@query("C18_cross_product_slots", "SELECT u.subject, d.difficulty, CAST(u.n * d.part AS DOUBLE) AS quota FROM (SELECT subject, count(*) AS n FROM problems GROUP BY subject) u CROSS JOIN (VALUES (1, 0.25), (2, 0.5), (3, 0.25)) d(difficulty, part)")
def c18(t: Tables):
    share = F.explode(F.array(*(F.struct(F.lit(d).alias("difficulty"), F.lit(p).alias("part")) for d, p in ((1, 0.25), (2, 0.5), (3, 0.25)))))
    units = t.problems.groupBy("subject").agg(F.count("*").alias("n")).withColumn("d", share)
    return units.select("subject", "d.difficulty", (F.col("n") * F.col("d.part")).alias("quota"))


@query("C19_nested_include", "SELECT r.r_name AS organization, c.title, count(*) AS n_students, string_agg(u.name, ',' ORDER BY u.student_id) FILTER (WHERE u.xp > 900) AS top_names FROM region r JOIN classes c ON c.organization_id = r.r_regionkey JOIN students u ON u.class_id = c.class_id GROUP BY r.r_name, c.title")
def c19(t: Tables):
    joined = t.region.join(t.classes, F.col("organization_id") == F.col("r_regionkey")).join(t.students, "class_id")
    top = F.array_sort(F.collect_list(F.when(F.col("xp") > 900, F.struct("student_id", "name"))))
    grouped = joined.groupBy(F.col("r_name").alias("organization"), "title").agg(F.count("*").alias("n_students"), top.alias("top"))
    return grouped.select("organization", "title", "n_students", F.when(F.size("top") > 0, F.array_join(F.transform("top", lambda x: x["name"]), ",")).alias("top_names"))


@query("C20_role_scoped_list", "SELECT submission_id FROM submissions WHERE class_id IN (SELECT class_id FROM classes WHERE organization_id = 3) AND status = 'graded' ORDER BY submitted_at DESC, submission_id LIMIT 50")
def c20(t: Tables):
    mine = O.visible_students(t.students, t.classes, "teacher", organization=3)
    seen = t.submissions.join(mine, "student_id", "left_semi").where("status = 'graded'")
    return seen.orderBy(F.desc("submitted_at"), "submission_id").limit(50).select("submission_id")


@query("C21_pending_counts", "SELECT a.assignment_id, count(s.submission_id) AS pending FROM assignments a LEFT JOIN submissions s ON s.assignment_id = a.assignment_id AND s.status = 'submitted' GROUP BY a.assignment_id")
def c21(t: Tables):
    open_ones = t.submissions.where("status = 'submitted'").groupBy("assignment_id").agg(F.count("*").alias("pending"))
    return t.assignments.select("assignment_id").join(open_ones, "assignment_id", "left").na.fill(0, ["pending"])


@query("F1_order_by", "SELECT student_id, score, submission_id FROM submissions WHERE score > 97 ORDER BY score DESC, student_id, submission_id")
def f1(t: Tables):
    return t.submissions.where("score > 97").orderBy(F.desc("score"), "student_id", "submission_id").select("student_id", "score", "submission_id")


@query("F2_nulls_last", "SELECT submission_id, score FROM submissions ORDER BY score DESC NULLS LAST, submission_id LIMIT 100")
def f2(t: Tables):
    return t.submissions.orderBy(F.desc_nulls_last("score"), "submission_id").limit(100).select("submission_id", "score")


@query("F3_order_by_expression", "SELECT problem_id FROM problems ORDER BY CASE WHEN difficulty > 3 THEN weight / difficulty ELSE 0 END DESC, problem_id LIMIT 20")
def f3(t: Tables):
    return t.problems.orderBy(F.when(F.col("difficulty") > 3, F.col("weight") / F.col("difficulty")).otherwise(0).desc(), "problem_id").limit(20).select("problem_id")


@query("F4_offset_page", "SELECT problem_id, (SELECT count(*) FROM problems WHERE review_status = 'approved') AS total FROM problems WHERE review_status = 'approved' ORDER BY problem_id LIMIT 20 OFFSET 40")
def f4(t: Tables):
    approved = t.problems.where("review_status = 'approved'")
    total = approved.agg(F.count("*").alias("total"))
    return O.page(approved.select("problem_id"), [F.col("problem_id")], 3, 20).join(F.broadcast(total), how="cross")


@query("F5_top_k", "SELECT subject, count(*) AS n FROM problems GROUP BY subject ORDER BY n DESC, subject LIMIT 5")
def f5(t: Tables):
    return t.problems.groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").limit(5)


@query("F6_top_k_then_threshold", "SELECT * FROM (SELECT student_id, submission_id, score, CAST(row_number() OVER (PARTITION BY student_id ORDER BY score DESC, submission_id) AS INTEGER) AS rank FROM submissions WHERE score IS NOT NULL) WHERE rank <= 3 AND score >= 50")
def f6(t: Tables):
    scored = t.submissions.where("score is not null").select("student_id", "submission_id", "score")
    return O.top_then_threshold(scored, ["student_id"], [F.desc("score"), F.col("submission_id")], 3, F.col("score") >= 50)


@query("F7_overfetch_top_k", """WITH c AS (SELECT problem_id, subject, node_id, review_status, row_number() OVER (PARTITION BY subject ORDER BY weight DESC, problem_id) AS n FROM problems WHERE weight >= 950)
  SELECT problem_id, subject FROM (SELECT problem_id, subject, row_number() OVER (PARTITION BY subject ORDER BY n) AS m FROM c WHERE n <= 25 AND review_status = 'approved' AND node_id < 20) WHERE m <= 5""")
def f7(t: Tables):
    near = O.top_then_threshold(t.problems.where("weight >= 950"), ["subject"], [F.desc("weight"), F.col("problem_id")], 25, (F.col("review_status") == "approved") & (F.col("node_id") < 20))
    return near.withColumn("m", F.row_number().over(Window.partitionBy("subject").orderBy("rank"))).where("m <= 5").select("problem_id", "subject")


@query("F8_relaxing_first_match", """WITH r AS (SELECT class_id AS request_id, concat('Brand#', class_id % 25 + 1) AS subject, class_id % 6 + 1 AS d, CASE class_id % 3 WHEN 0 THEN 'PROMO' WHEN 1 THEN 'ECONOMY' ELSE 'none' END AS u FROM classes),
  m AS (SELECT request_id, problem_id, CASE WHEN p.unit = r.u AND p.difficulty = r.d THEN 0 WHEN p.unit = r.u THEN 1 ELSE 2 END AS level FROM r JOIN problems p USING (subject))
  SELECT request_id, problem_id, CAST(level AS INTEGER) AS level FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY level, problem_id) AS n FROM m) WHERE n = 1""")
def f8(t: Tables):
    unit = F.when(F.col("class_id") % 3 == 0, "PROMO").when(F.col("class_id") % 3 == 1, "ECONOMY").otherwise("none")
    requests = t.classes.select(F.col("class_id").alias("request_id"), F.concat(F.lit("Brand#"), (F.col("class_id") % 25 + 1).cast("string")).alias("subject"), (F.col("class_id") % 6 + 1).alias("difficulty"), unit.alias("unit"))
    found = O.relaxing_first_match(requests, t.problems, [["subject", "unit", "difficulty"], ["subject", "unit"], ["subject"]], "problem_id")
    return found.select("request_id", "problem_id", "level")


@query("F9_stable_sort", "SELECT submission_id, problem_id, answer_no FROM numbered_answers ORDER BY is_correct NULLS FIRST, submission_id, answer_no")
def f9(t: Tables):
    return t.numbered_answers.orderBy("is_correct", "submission_id", "answer_no").select("submission_id", "problem_id", "answer_no")


@query("F10_byte_order_sort", "SELECT concat(subject, '::', unit) AS k, row_number() OVER (ORDER BY concat(subject, '::', unit)) AS n FROM (SELECT DISTINCT subject, unit FROM problems WHERE unit IS NOT NULL)")
def f10(t: Tables):
    keys = t.problems.where("unit is not null").select(F.concat_ws("::", "subject", "unit").alias("k")).distinct()
    return O.global_rank(keys, [F.col("k")], "n")


@query("F11_unordered_take", "SELECT problem_id FROM problems WHERE review_status = 'approved' ORDER BY problem_id LIMIT 10")
def f11(t: Tables):
    return t.problems.where("review_status = 'approved'").orderBy("problem_id").limit(10).select("problem_id")


@query("F12_capped_take", "SELECT event_id FROM learning_events ORDER BY client_ts DESC, event_id LIMIT 200")
def f12(t: Tables):
    return t.learning_events.orderBy(F.desc("client_ts"), "event_id").limit(min(500, 200)).select("event_id")


@query("G1_union_all", "SELECT class_id AS id FROM classes UNION ALL SELECT r_regionkey FROM region")
def g1(t: Tables):
    return t.classes.select(F.col("class_id").alias("id")).union(t.region.select("r_regionkey"))


@query("G2_union_distinct", "SELECT student_id FROM submissions WHERE status = 'graded' UNION SELECT student_id FROM learning_events")
def g2(t: Tables):
    return t.submissions.where("status = 'graded'").select("student_id").union(t.learning_events.select("student_id")).distinct()


@query("G3_set_difference", "SELECT problem_id FROM problems EXCEPT SELECT problem_id FROM answers")
def g3(t: Tables):
    return O.excluding(t.problems.select("problem_id"), t.answers, ["problem_id"])


@query("G4_missing_members", "SELECT id FROM (VALUES (CAST(3 AS BIGINT)), (CAST(-1 AS BIGINT)), (CAST(99999999 AS BIGINT))) v(id) WHERE id NOT IN (SELECT student_id FROM students) ORDER BY id LIMIT 1")
def g4(t: Tables):
    asked = t.spark.createDataFrame([(3,), (-1,), (99999999,)], "id long")
    return asked.join(t.students, asked["id"] == F.col("student_id"), "left_anti").orderBy("id").limit(1)


@query("G5_priority_union", """WITH u AS (SELECT subject, problem_id, 1 AS priority FROM problems WHERE difficulty = 6 UNION ALL SELECT subject, problem_id, 2 FROM problems WHERE review_status = 'pending' UNION ALL SELECT subject, problem_id, 3 FROM problems WHERE unit = 'PROMO')
  SELECT subject, problem_id, priority FROM (SELECT subject, problem_id, min(priority) AS priority, row_number() OVER (PARTITION BY subject ORDER BY min(priority), problem_id) AS n FROM u GROUP BY subject, problem_id) WHERE n <= 10""")
def g5(t: Tables):
    p = t.problems
    sources = [p.where(c).select("subject", "problem_id", F.lit(k).alias("priority")) for k, c in ((1, "difficulty = 6"), (2, "review_status = 'pending'"), (3, "unit = 'PROMO'"))]
    return O.priority_union(sources, ["subject", "problem_id"], "priority", 10, "subject", "problem_id")
