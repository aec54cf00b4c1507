"""Search, similarity, review scores, recommendations and composition."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerics as N
from ..operators import compose as C
from ..operators import retrieval as J
from ..operators import review as R
from ..operators import tables as O
from ..operators.search import SearchIndex
from ..sources.domain import Tables
from .registry import query

TOKENS = r"list_filter(regexp_split_to_array(lower(stem), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("J1_token_build", f"SELECT problem_id, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS tokens FROM problems")
def j1(t: Tables):
    return t.problems.select("problem_id", F.array_join(F.array_sort(J.tokens(F.col("stem"))), " ").alias("tokens"))


@functools.cache
def index_at(app: str, spark, files: tuple, sf_dir: str) -> SearchIndex:
    return SearchIndex.build(Tables(spark, sf_dir).problems.select("problem_id", "stem"), "problem_id", "stem")


def problem_index(t: Tables) -> SearchIndex:
    """The index of the problems' stems: built once for the files of a table, read by every search."""
    return index_at(t.spark.sparkContext.applicationId, t.spark, tuple(t.part.inputFiles()), t.sf_dir)


@query("J2_keyword_match", f"SELECT problem_id FROM problems WHERE list_contains({TOKENS}, 'red') AND list_contains({TOKENS}, 'ring')")
def j2(t: Tables):
    return problem_index(t).holding(["red", "ring"]).select("problem_id")


@query("J2_scanned_match", f"SELECT problem_id FROM problems WHERE list_contains({TOKENS}, 'old') AND list_contains({TOKENS}, 'gear')")
def j2_scanned(t: Tables):
    """Without an index: for texts that are searched once."""
    return J.keyword_matches(t.problems, "stem", ["old", "gear"]).select("problem_id")


@query("J2_phrase_match", f"SELECT problem_id FROM problems WHERE contains(concat(' ', array_to_string({TOKENS}, ' '), ' '), ' hot gear ')")
def j2_phrase(t: Tables):
    return problem_index(t).phrase(["hot", "gear"])


RANKED = f"""WITH w AS (SELECT problem_id, {TOKENS} AS ws FROM problems), c AS (SELECT problem_id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'hot')) AS a, len(list_filter(ws, lambda x: x = 'ring')) AS b FROM w),
  s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
  SELECT problem_id, floor((ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))) * 1000000 + 0.5) / 1000000 AS score FROM c, s"""


@query("J3_keyword_top", f"SELECT * FROM ({RANKED}) WHERE score > 0 ORDER BY score DESC, problem_id LIMIT 25")
def j3_top(t: Tables):
    return problem_index(t).best(["hot", "ring"], 25).select("problem_id", N.js_round_n(F.col("score"), 6).alias("score"))


@query("J3_scanned_rank", f"SELECT * FROM ({RANKED}) WHERE score > 0")
def j3_scanned(t: Tables):
    return J.bm25(t.problems, "problem_id", "stem", ["hot", "ring"]).withColumn("score", N.js_round_n(F.col("score"), 6))


@query("J3_keyword_rank", f"""WITH w AS (SELECT problem_id, {TOKENS} AS ws FROM problems), c AS (SELECT problem_id, len(ws) AS l, len(list_filter(ws, lambda x: x = 'red')) AS a, len(list_filter(ws, lambda x: x = 'small')) AS b FROM w),
  s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
  SELECT * FROM (SELECT problem_id, floor((ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m))) * 1000000 + 0.5) / 1000000 AS score FROM c, s) WHERE score > 0""")
def j3(t: Tables):
    return problem_index(t).scored(["red", "small"]).withColumn("score", N.js_round_n(F.col("score"), 6))


QUERY_VECTOR = "SELECT embedding FROM embeddings WHERE vec_id = 7"


@query("J4_cosine_similarity", f"SELECT vec_id, floor(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(({QUERY_VECTOR}) AS DOUBLE[])) * 10000 + 0.5) / 10000 AS score FROM embeddings")
def j4(t: Tables):
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", N.js_round_n(N.cosine(F.col("embedding"), F.col("q")), 4).alias("score"))


@query("J5_semantic_search", f"SELECT vec_id FROM embeddings WHERE label < 5 ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(({QUERY_VECTOR}) AS DOUBLE[])) DESC, vec_id LIMIT 20")
def j5(t: Tables):
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return J.nearest_to(t.embeddings.where("label < 5"), "vec_id", "embedding", q, 20).select("vec_id")


@query("J6_knn_all_pairs", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s) SELECT vec_id, neighbour, floor(c * 10000 + 0.5) / 10000 AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 AND c >= 0.2""")
def j6(t: Tables):
    return J.knn_all_pairs(t.embeddings, "vec_id", "embedding", least=0.2)


@query("J6_index_recall", "SELECT count(*) FILTER (WHERE vec_id % 100 = 0) AS queries, count(*) AS indexed, true AS recalled FROM embeddings")
def j6_recall(t: Tables):
    """Whether the index, with 24 of some 32 cells searched, finds nine in ten of the ten nearest vectors of ids divisible by 100, all vectors being indexed.

    These vectors have next to no clusters, so that most cells must be searched: a test holds the recall of clustered ones at a quarter.
    """
    rows = t.embeddings.select("vec_id", "embedding")
    index = J.vector_index(rows, "vec_id", "embedding", cell_rows=max(1, -(-rows.count() // 32)), probes=24)
    found = J.search_index(index, index.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("vec_id", "neighbour")
    asked = rows.where("vec_id % 100 = 0")
    others = rows.select(F.col("vec_id").alias("neighbour"), F.col("embedding").alias("other"))
    exact = J.nearest_of_each(asked, others, "vec_id", "embedding", 10)
    counted = exact.join(found.withColumn("hit", F.lit(1)), ["vec_id", "neighbour"], "left").agg(F.countDistinct("vec_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("recalled"))
    indexed = index.agg(F.countDistinct("vec_id").alias("indexed"))
    return counted.join(F.broadcast(indexed), how="cross").select("queries", "indexed", "recalled")  # one row each


@query("J7_hybrid_search_rrf", f"""WITH kw AS (SELECT problem_id AS id, row_number() OVER (ORDER BY len({TOKENS}), problem_id) AS rank FROM problems WHERE list_contains({TOKENS}, 'red')),
  sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(({QUERY_VECTOR}) AS DOUBLE[])), 12) DESC, vec_id) AS rank FROM embeddings)
  SELECT id, floor((coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0)) * 1000000000 + 0.5) / 1000000000 AS score, count(*) OVER () AS total FROM kw FULL JOIN sem USING (id) ORDER BY coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + sem.rank), 0) DESC, id LIMIT 20""")
def j7(t: Tables):
    hits = problem_index(t).holding(["red"]).select(F.col("problem_id").alias("id"), (-F.col("length")).cast("double").alias("score"))
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))
    scored = t.embeddings.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.round(N.cosine(F.col("embedding"), F.col("q")), 12).alias("score"))
    page = J.fused_page([hits, scored], "id", 20)
    return page.select("id", N.js_round_n(F.col("score"), 9).alias("score"), "total")


@query("J8_similar_agreement", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.vec_id, a.label AS own, b.label AS theirs, b.vec_id AS neighbour, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, neighbour) AS rank FROM s), n AS (SELECT vec_id, sum(CASE WHEN own = theirs THEN floor(c * 10000 + 0.5) / 10000 ELSE 0 END) / sum(floor(c * 10000 + 0.5) / 10000) AS agreement FROM r WHERE rank <= 5 AND c >= 0.2 GROUP BY 1)
  SELECT vec_id, floor(coalesce(agreement, 0.5) * 1000 + 0.5) / 1000 AS agreement FROM e LEFT JOIN n USING (vec_id)""")
def j8(t: Tables):
    near = J.knn_all_pairs(t.embeddings, "vec_id", "embedding", k=5, least=0.2)
    out = J.similar_agreement(near, t.embeddings.select("vec_id", F.col("label").alias("subject")), "vec_id")
    return out.withColumn("agreement", N.js_round_n(F.col("agreement"), 3))


# Reviewed problems: a curriculum of the units of approved problems (subjects ending in 5 are unknown), concepts from the stem, a chapter for textbook problems, an answer key for some of them.
KEYWORDS = {1: ["red", "ring"], 2: ["small", "bolt"], 3: [], 4: ["hot", "gear"]}
REVIEWED = """SELECT p.*, NOT suffix(p.subject, '5') AS subject_known, unit IS NOT NULL AND EXISTS (SELECT 1 FROM problems q WHERE q.subject = p.subject AND q.unit = p.unit AND q.review_status = 'approved') AS unit_known,
  CASE WHEN difficulty = 6 THEN [] ELSE string_split(stem, ' ') END AS concepts, CASE problem_id % 5 WHEN 1 THEN ['red', 'ring'] WHEN 2 THEN ['small', 'bolt'] WHEN 3 THEN [] WHEN 4 THEN ['hot', 'gear'] END AS keywords,
  CASE problem_id % 6 WHEN 0 THEN concat(upper(p.subject), ' I') WHEN 1 THEN concat('part ', coalesce(unit, 'NONE')) WHEN 2 THEN 'on PRO and more' WHEN 3 THEN '' END AS chapter, CASE WHEN difficulty % 2 = 0 THEN ' ③ ' ELSE '2' END AS found,
  CASE problem_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '2' WHEN 2 THEN '' END AS key, CASE WHEN time_sec % 20 = 0 THEN 'matched' ELSE 'open' END AS key_status FROM problems p"""
CONSISTENCY = """CASE WHEN NOT subject_known THEN 0 ELSE (CASE WHEN unit IS NULL THEN 0.25 WHEN unit_known THEN 0.5 ELSE 0 END) + CASE WHEN len(concepts) = 0 THEN 0.1 WHEN keywords IS NULL OR len(keywords) = 0 THEN 0.25
  ELSE CASE len(list_filter(keywords, lambda k: contains(lower(array_to_string(concepts, ' ')), k))) WHEN 0 THEN 0 WHEN 1 THEN 0.3 ELSE 0.5 END END END::DOUBLE"""
CHAPTER = """CASE WHEN coalesce(chapter, '') = '' THEN 0.5 WHEN contains(lower(chapter), lower(subject)) THEN 1.0 WHEN unit IS NOT NULL AND contains(lower(chapter), lower(unit)) THEN 0.9
  WHEN unit IS NOT NULL AND len(list_filter(string_split(lower(chapter), ' '), lambda w: length(w) > 1 AND contains(unit, w))) > 0 THEN 0.8 ELSE 0.3 END::DOUBLE"""
CROSS = "CASE WHEN key_status <> 'matched' OR coalesce(key, '') = '' THEN 0.5 WHEN translate(trim(found), '①②③④⑤', '12345') = translate(trim(key), '①②③④⑤', '12345') THEN 1.0 ELSE 0.0 END::DOUBLE"
CONFIDENCE = """CASE WHEN difficulty = 5 THEN 0 WHEN difficulty = 1 THEN b WHEN difficulty = 2 THEN a ELSE (a + b) / 2 END"""


def reviewed(t: Tables):
    p = t.problems
    tree = p.where("review_status = 'approved' and unit is not null").select("subject", "unit", F.lit(True).alias("unit_known")).distinct()
    mod = lambda n: F.col("problem_id") % n
    words = F.lit(None).cast("array<string>")
    for k, ws in KEYWORDS.items():
        words = F.when(mod(5) == k, F.array(*map(F.lit, ws)).cast("array<string>")).otherwise(words)
    made = {
        "subject_known": ~F.endswith("subject", F.lit("5")),
        "concepts": F.when(F.col("difficulty") == 6, F.array().cast("array<string>")).otherwise(F.split("stem", " ")),
        "keywords": words,
        "chapter": F.when(mod(6) == 0, F.concat(F.upper("subject"), F.lit(" I"))).when(mod(6) == 1, F.concat(F.lit("part "), F.coalesce("unit", F.lit("NONE")))).when(mod(6) == 2, "on PRO and more").when(mod(6) == 3, ""),
        "found": F.when(F.col("difficulty") % 2 == 0, " ③ ").otherwise("2"),
        "key": F.when(mod(4) == 0, "3").when(mod(4) == 1, "2").when(mod(4) == 2, ""),
        "key_status": F.when(F.col("time_sec") % 20 == 0, "matched").otherwise("open"),
    }
    # the curriculum has a few units for each subject
    return p.join(tree, ["subject", "unit"], "left").withColumn("unit_known", F.coalesce("unit_known", F.lit(False))).withColumns(made)


def consistency():
    return R.subject_consistency(F.col("subject_known"), F.col("unit"), F.col("unit_known"), F.col("concepts"), F.col("keywords"))


def confidence():
    given = lambda bad, x: F.when(~F.col("difficulty").isin(bad, 5), x)
    return J.ai_confidence(given(1, F.col("time_sec") / 400), given(2, (F.col("weight") - 900) / 100))


@query("J9_subject_consistency", f"SELECT problem_id, {CONSISTENCY} AS consistency FROM ({REVIEWED})")
def j9(t: Tables):
    return reviewed(t).select("problem_id", consistency().alias("consistency"))


@query("J10_ai_confidence", f"SELECT problem_id, floor({CONFIDENCE} * 1e6 + 0.5) / 1e6 AS confidence FROM (SELECT problem_id, difficulty, greatest(0, least(1, time_sec / 400.0::DOUBLE)) AS a, greatest(0, least(1, (weight - 900) / 100)) AS b FROM problems)")
def j10(t: Tables):
    return t.problems.select("problem_id", N.js_round_n(confidence(), 6).alias("confidence"))


@query("J10_chapter_match", f"SELECT problem_id, {CHAPTER} AS score FROM ({REVIEWED})")
def j10_chapter(t: Tables):
    return reviewed(t).select("problem_id", R.chapter_match(F.col("subject"), F.col("unit"), F.col("chapter")).alias("score"))


@query("J10_answer_cross_check", f"SELECT problem_id, {CROSS} AS score FROM ({REVIEWED})")
def j10_answer(t: Tables):
    return reviewed(t).select("problem_id", R.answer_cross_check(F.col("found"), F.col("key"), F.col("key_status")).alias("score"))


TIME_SCORE = """CASE WHEN time_sec < [30, 60, 90, 150, 240, 360][difficulty] THEN greatest(0, 1.0::DOUBLE - ([30, 60, 90, 150, 240, 360][difficulty] - time_sec) / greatest(60, [30, 60, 90, 150, 240, 360][difficulty])::DOUBLE)
  WHEN time_sec > [120, 180, 300, 420, 600, 900][difficulty] THEN greatest(0, 1.0::DOUBLE - (time_sec - [120, 180, 300, 420, 600, 900][difficulty]) / greatest(120, [120, 180, 300, 420, 600, 900][difficulty])::DOUBLE) ELSE 1 END"""


@query("J11_auto_review", f"""WITH r AS ({REVIEWED}), f AS (SELECT *, {CONFIDENCE} AS ai, {CONSISTENCY} AS consistent, {TIME_SCORE} AS timing, CASE WHEN review_status = 'rejected' THEN 0.2 ELSE 0.9 END::DOUBLE AS alike, {CHAPTER} AS chapters, {CROSS} AS crossed,
    CASE WHEN chapter IS NULL OR chapter = '' THEN 'exam' WHEN key_status = 'matched' THEN 'textbook_with_key' ELSE 'textbook' END AS kind
    FROM (SELECT *, greatest(0, least(1, time_sec / 400.0::DOUBLE)) AS a, greatest(0, least(1, (weight - 900) / 100)) AS b FROM r)),
  s AS (SELECT *, CASE kind WHEN 'exam' THEN 0.3 * ai + 0.25 * consistent + 0.2 * timing + 0.25 * alike WHEN 'textbook_with_key' THEN 0.15 * ai + 0.15 * consistent + 0.1 * timing + 0.15 * alike + 0.2 * chapters + 0.25 * crossed
    ELSE 0.25 * ai + 0.2 * consistent + 0.1 * timing + 0.15 * alike + 0.3 * chapters END::DOUBLE AS score FROM f),
  c AS (SELECT *, list_filter([CASE WHEN NOT subject_known THEN 'subject_valid' END, CASE WHEN NOT (subject_known AND unit_known) THEN 'unit_matches_subject' END, CASE WHEN time_sec % 70 = 0 THEN 'has_solution_strategy' END,
    CASE WHEN len(concepts) = 0 THEN 'has_required_concepts' END, CASE WHEN problem_id % 11 = 0 THEN 'difficulty_in_range' END, CASE WHEN round(score, 9) < CASE kind WHEN 'textbook_with_key' THEN 0.8 ELSE 0.85 END THEN 'confidence_above_threshold' END], lambda x: x IS NOT NULL) AS failed FROM s)
  SELECT problem_id, floor(score * 1e6 + 0.5) / 1e6 AS score, CASE WHEN len(failed) = 0 THEN 'auto_approved' ELSE 'pending_review' END AS decision, array_to_string(failed, ',') AS failed FROM c""")
def j11(t: Tables):
    r = reviewed(t)
    with_chapter, keyed = F.coalesce("chapter", F.lit("")) != "", F.col("key_status") == "matched"
    kind = F.when(~with_chapter, "exam").when(keyed, "textbook_with_key").otherwise("textbook")
    similar = F.when(F.col("review_status") == "rejected", 0.2).otherwise(0.9)
    factors = (confidence(), consistency(), J.time_score(F.col("difficulty"), F.col("time_sec")), similar, R.chapter_match(F.col("subject"), F.col("unit"), F.col("chapter")), R.answer_cross_check(F.col("found"), F.col("key"), F.col("key_status")))
    refined = F.when(F.col("problem_id") % 11 != 0, F.col("difficulty").cast("double"))
    strategy = F.when(F.col("time_sec") % 70 != 0, F.col("stem"))
    checks = {
        "subject_valid": F.col("subject_known"), "unit_matches_subject": F.col("subject_known") & F.col("unit_known"), "has_solution_strategy": F.coalesce(strategy, F.lit("")) != "",
        "has_required_concepts": F.size("concepts") > 0, "difficulty_in_range": refined.between(1.0, 6.0),
    }
    made = R.review(kind, factors, checks)
    return r.select("problem_id", N.js_round_n(made["score"], 6).alias("score"), made["decision"].alias("decision"), F.array_join(made["failed"], ",").alias("failed"))


WRONG = "SELECT s.student_id, a.problem_id, a.answered_at, p.node_id FROM answers a JOIN submissions s USING (submission_id) JOIN problems p USING (problem_id) WHERE a.is_correct = false"
# open errors, and moments of tutoring: ungraded answers, of which two in three have a known cause
NOW = "TIMESTAMP '1998-06-30'"
MOMENTS = f"""SELECT s.student_id, a.problem_id, CASE WHEN p.node_id <> 13 THEN p.node_id END AS node_id, a.answered_at AS asked, a.is_correct, a.seconds, a.order_index,
  row_number() OVER (PARTITION BY s.student_id ORDER BY a.answered_at, a.submission_id, a.order_index, a.problem_id, a.grader_id) AS nth
  FROM answers a JOIN submissions s USING (submission_id) JOIN problems p USING (problem_id) WHERE a.answered_at >= {NOW} - INTERVAL 30 DAY AND a.answered_at < {NOW}"""
AREAS = f"""m AS ({MOMENTS}), e AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY asked DESC, nth) AS place FROM m WHERE is_correct = false AND seconds <= 40),
  g AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY asked, nth) AS place FROM m WHERE is_correct IS NULL AND order_index % 3 <> 0),
  u AS (SELECT student_id, node_id, problem_id, 1 AS weight, place AS place FROM e WHERE place <= 20 UNION ALL SELECT student_id, node_id, problem_id, CASE WHEN seconds > 25 THEN 2 ELSE 1 END, 1000000000 + place FROM g),
  h AS (SELECT student_id, node_id, CAST(sum(weight) AS BIGINT) AS weight, min(place) AS first, min_by(problem_id, place) AS problem_id FROM u WHERE node_id IS NOT NULL GROUP BY 1, 2),
  areas AS (SELECT student_id, node_id, weight, problem_id, k AS area FROM (SELECT *, CAST(row_number() OVER (PARTITION BY student_id ORDER BY weight DESC, first) AS INTEGER) AS k FROM h) WHERE k <= 3)"""


@query("J12_weak_areas", f"WITH {AREAS} SELECT * FROM areas")
def j12(t: Tables):
    return weak_areas(t)


def weak_areas(t: Tables):
    now = F.lit("1998-06-30").cast("timestamp")
    joined = t.answers.where((F.col("answered_at") < now) & (F.col("answered_at") >= now - F.expr("interval 30 days"))).join(t.submissions.select("submission_id", "student_id"), "submission_id").join(t.problems.select("problem_id", "node_id"), "problem_id")
    nth = F.row_number().over(Window.partitionBy("student_id").orderBy("answered_at", "submission_id", "order_index", "problem_id", "grader_id"))
    node = F.when(F.col("node_id") != 13, F.col("node_id"))
    moments = joined.select("student_id", "problem_id", node.alias("node_id"), F.col("answered_at").alias("at"), "is_correct", "seconds", "order_index", nth.alias("nth"))
    wrong = moments.where("is_correct = false and seconds <= 40")
    signals = moments.where("is_correct is null and order_index % 3 <> 0").withColumn("source", F.when(F.col("seconds") > 25, "worked_solution").otherwise("question"))
    return J.weak_areas(wrong, signals, now)


@query("J13_remediation_select", f"""WITH {AREAS}, known AS (SELECT DISTINCT s.student_id, a.problem_id FROM answers a JOIN submissions s USING (submission_id)),
  c AS (SELECT x.student_id, x.area, p.problem_id, row_number() OVER (PARTITION BY x.student_id, x.area ORDER BY p.difficulty, p.problem_id) AS own FROM areas x JOIN problems p USING (node_id) WHERE p.review_status = 'approved'
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.student_id = x.student_id AND k.problem_id = p.problem_id))
  SELECT * FROM (SELECT student_id, area, problem_id, CAST(row_number() OVER (PARTITION BY student_id ORDER BY area, own) AS INTEGER) AS place FROM c WHERE own <= 3) WHERE place <= 5""")
def j13(t: Tables):
    pool = t.problems.where("review_status = 'approved'").select("problem_id", "node_id", "difficulty")
    answered = t.answers.select("submission_id", "problem_id").join(t.submissions.select("submission_id", "student_id"), "submission_id")
    return J.remediation(weak_areas(t).select("student_id", "node_id", "area"), answered, pool, each=3, total=5)


@query("J14_recommendations", f"""WITH u AS (SELECT DISTINCT student_id, problem_id, 1 AS priority FROM ({WRONG}) WHERE answered_at >= TIMESTAMP '2000-06-01' UNION ALL SELECT DISTINCT s.student_id, a.problem_id, 3 FROM answers a JOIN submissions s USING (submission_id) WHERE is_correct IS NULL)
  SELECT student_id, problem_id, priority FROM (SELECT student_id, problem_id, min(priority) AS priority, row_number() OVER (PARTITION BY student_id ORDER BY min(priority), problem_id) AS n FROM u GROUP BY 1, 2) WHERE n <= 10""")
def j14(t: Tables):
    joined = t.answers.join(t.submissions.select("submission_id", "student_id"), "submission_id")
    source = lambda c, k: joined.where(c).select("student_id", "problem_id", F.lit(k).alias("priority"))
    sources = [source("is_correct = false and answered_at >= timestamp'2000-06-01'", 1), source("is_correct is null", 3)]
    return O.priority_union(sources, ["student_id", "problem_id"], "priority", 10, "student_id", "problem_id")


def exam_plan(t: Tables):
    """An exam of ten slots for each subject from the shares of its units, and the problems that may be used."""
    kind = F.col("problem_type").alias("kind")
    weights = t.problems.where("unit is not null").groupBy(F.col("subject").alias("exam"), "subject", "unit").agg(F.count("*").alias("percentage"))
    slots = C.build_slots(weights, ["multiple_choice", "short_answer", "multiple_choice", "essay"], 10, 2, 4)
    usable = t.problems.where("review_status in ('approved', 'auto_approved')")
    return slots, usable.select("problem_id", "subject", "unit", kind, "difficulty", (F.col("problem_id") % 17).alias("source"))


@query("J15_exam_composition")
def j15(t: Tables):
    slots, usable = exam_plan(t)
    return C.compose_exam(slots, usable, 10)


@query("J16_composition_preview", "SELECT c.class_id, count(p.problem_id) AS available, CASE WHEN count(p.problem_id) = 0 THEN 'impossible' WHEN count(p.problem_id) < 5 THEN 'tight' ELSE 'ok' END AS feasibility FROM classes c LEFT JOIN problems p ON p.node_id = c.class_id AND p.difficulty BETWEEN 1 + c.class_id % 3 AND 3 + c.class_id % 3 AND p.review_status = 'approved' GROUP BY 1")
def j16(t: Tables):
    p = t.problems.where("review_status = 'approved'").select("problem_id", "node_id", "difficulty")
    low = 1 + F.col("class_id") % 3
    joined = t.classes.join(p, (F.col("node_id") == F.col("class_id")) & F.col("difficulty").between(low, low + 2), "left").groupBy("class_id")
    counted = joined.agg(F.count("problem_id").alias("available"))
    return counted.withColumn("feasibility", F.when(F.col("available") == 0, "impossible").when(F.col("available") < 5, "tight").otherwise("ok"))


@query("J17_usage_exclusion", "SELECT problem_id FROM problems WHERE problem_id NOT IN (SELECT a.problem_id FROM answers a JOIN submissions s USING (submission_id) WHERE s.class_id = 3 AND a.answered_at >= TIMESTAMP '2000-01-01') AND review_status <> 'rejected'")
def j17(t: Tables):
    used = t.answers.where("answered_at >= timestamp'2000-01-01'").join(t.submissions.where("class_id = 3"), "submission_id", "left_semi")
    return O.excluding(t.problems.where("review_status <> 'rejected'").select("problem_id"), used, ["problem_id"])


CHOSEN = "SELECT class_id, coalesce(min_by(assignment_id, (due_at, assignment_id)) FILTER (WHERE due_at >= TIMESTAMP '1998-07-30'), max_by(assignment_id, (created_at, assignment_id))) AS assignment_id FROM assignments GROUP BY class_id"


def chosen_assignments(t: Tables):
    """The nearest assignment that is still due, else the newest."""
    future = F.col("due_at") >= F.lit("1998-07-30").cast("timestamp")
    nearest = F.min_by(F.when(future, F.col("assignment_id")), F.when(future, F.struct("due_at", "assignment_id")))
    return t.assignments.groupBy("class_id").agg(F.coalesce(nearest, F.max_by("assignment_id", F.struct("created_at", "assignment_id"))).alias("assignment_id"))


MONITOR = f"""WITH c AS ({CHOSEN}), n AS (SELECT submission_id, count(*) AS answered FROM answers GROUP BY 1), l AS (SELECT *, row_number() OVER (PARTITION BY student_id, assignment_id ORDER BY submitted_at DESC, submission_id DESC) AS k FROM submissions)
  SELECT u.student_id, u.class_id, c.assignment_id, coalesce(n.answered, 0) AS submitted, l.score, CASE WHEN l.submission_id IS NULL THEN 'not_started' WHEN l.status IN ('graded', 'returned') THEN 'completed' ELSE 'in_progress' END AS status,
    l.submission_id IS NOT NULL AND l.status NOT IN ('graded', 'returned') AND l.submitted_at < TIMESTAMP '1998-07-30' - INTERVAL 10 MINUTE AS stuck
  FROM students u LEFT JOIN c USING (class_id) LEFT JOIN l ON l.student_id = u.student_id AND l.assignment_id = c.assignment_id AND l.k = 1 LEFT JOIN n USING (submission_id)"""


def class_board(rows: DataFrame) -> DataFrame:
    """The status of students, one row each, from their latest submission (nulls: none) to the assignment their class shows."""
    done = F.col("status").isin("graded", "returned")
    status = F.when(F.col("submission_id").isNull(), "not_started").when(done, "completed").otherwise("in_progress")
    stuck = F.coalesce(~done & (F.col("submitted_at") < F.lit("1998-07-29 23:50:00").cast("timestamp")), F.lit(False))
    return rows.select("student_id", "class_id", "assignment_id", F.coalesce("submitted", F.lit(0)).cast("long").alias("submitted"), "score", status.alias("status"), stuck.alias("stuck"))


@query("J18_class_monitor", MONITOR)
def j18(t: Tables):
    latest = O.latest_per(t.submissions.select("submission_id", "student_id", "assignment_id", "status", "score", "submitted_at"), ["student_id", "assignment_id"], F.desc("submitted_at"), F.desc("submission_id"))
    counts = t.answers.groupBy("submission_id").agg(F.count("*").alias("submitted"))
    rows = t.students.select("student_id", "class_id").join(chosen_assignments(t), "class_id", "left").join(latest, ["student_id", "assignment_id"], "left").join(counts, "submission_id", "left")
    return class_board(rows)


@query("J19_achievements", "WITH m AS (SELECT student_id, count(*) AS n, count(*) FILTER (WHERE score >= 90) AS top FROM submissions GROUP BY 1) SELECT student_id, unnest(list_filter([CASE WHEN n >= 5 THEN 'busy' END, CASE WHEN n >= 15 THEN 'tireless' END, CASE WHEN top >= 1 THEN 'excellent' END], lambda x: x IS NOT NULL)) AS achievement FROM m WHERE student_id NOT IN (SELECT student_id FROM students WHERE segment = 'BUILDING')")
def j19(t: Tables):
    m = t.submissions.groupBy("student_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 90).alias("top"))
    rules = F.array(F.when(F.col("n") >= 5, "busy"), F.when(F.col("n") >= 15, "tireless"), F.when(F.col("top") >= 1, "excellent"))
    earned = t.students.where("segment = 'BUILDING'")
    return m.select("student_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("achievement")).join(earned, "student_id", "left_anti")


@query("J20_due_reviews", f"SELECT w.student_id, w.problem_id, p.subject FROM (SELECT student_id, problem_id, max(answered_at) AS last FROM ({WRONG}) GROUP BY 1, 2) w LEFT JOIN problems p USING (problem_id) WHERE w.last + INTERVAL 6 DAY <= TIMESTAMP '1998-01-01' ORDER BY w.last, w.student_id, w.problem_id LIMIT 100")
def j20(t: Tables):
    wrong = t.answers.where("is_correct = false").join(t.submissions.select("submission_id", "student_id"), "submission_id")
    last = wrong.groupBy("student_id", "problem_id").agg(F.max("answered_at").alias("last"))
    due = last.where(F.col("last") + F.expr("interval 6 days") <= F.lit("1998-01-01").cast("timestamp"))
    first = due.orderBy("last", "student_id", "problem_id").limit(100)
    return first.join(t.problems.select("problem_id", "subject"), "problem_id", "left").select("student_id", "problem_id", "subject")


@query("J21_wrong_answer_page", f"SELECT student_id, problem_id, subject, difficulty FROM (SELECT student_id, problem_id, max(answered_at) AS last FROM ({WRONG}) GROUP BY 1, 2) JOIN problems USING (problem_id) ORDER BY last DESC, student_id, problem_id LIMIT 20 OFFSET 20")
def j21(t: Tables):
    wrong = t.answers.where("is_correct = false").join(t.submissions.select("submission_id", "student_id"), "submission_id")
    last = wrong.groupBy("student_id", "problem_id").agg(F.max("answered_at").alias("last")).join(t.problems.select("problem_id", "subject", "difficulty"), "problem_id")
    return O.page(last, [F.desc("last"), F.col("student_id"), F.col("problem_id")], 2, 20).select("student_id", "problem_id", "subject", "difficulty")


@query("J22_assignment_resolution", CHOSEN)
def j22(t: Tables):
    return chosen_assignments(t)
