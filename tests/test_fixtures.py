"""Hand-computed cases of the operators, nulls and empty inputs included."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeleaf.functions import numerics as N
from gaugeleaf.operators import aggregates as A
from gaugeleaf.operators import compose as C
from gaugeleaf.operators import documents as D
from gaugeleaf.operators import folds as K
from gaugeleaf.operators import graph as G
from gaugeleaf.operators import retrieval as J
from gaugeleaf.operators import review as R
from gaugeleaf.operators import tables as O
from gaugeleaf.plans import catalog
from gaugeleaf.plans.retrieval import exam_plan
from gaugeleaf.sources.domain import Tables
from gaugeleaf.streaming import events as E


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rounding(spark):
    row = spark.createDataFrame([(2.5,), (-2.5,), (0.5,)], "x double")
    assert [r[0] for r in row.select(N.js_round(F.col("x"))).collect()] == [3, -2, 1]
    assert [r[0] for r in row.select(N.py_round(F.col("x"))).collect()] == [2, -2, 0]
    assert spark.range(1).select(N.clamp(F.lit(None).cast("double"), 0, 1).alias("c")).first().c is None


def test_sm2(spark):
    reviews = spark.createDataFrame([("a", i, q) for i, q in enumerate((5, 4, 3, 2, 5))], "k string, i int, q int")
    for n, (interval, ease, reps) in enumerate([(1, 2.6, 1), (6, 2.6, 2), (16, 2.46, 3), (1, 2.14, 0), (1, 2.24, 1)], start=1):
        got = K.sm2(reviews.where(F.col("i") < n), "k", ["i"], "q").first()
        assert (got.interval, round(got.ease_factor, 6), got.repetitions) == (interval, ease, reps)


def test_irt(spark):
    answers = [("a", i, d, c) for i, (d, c) in enumerate(((3, True), (4, False), (4, True), (6, False)))]
    df = spark.createDataFrame(answers, "k string, i int, difficulty int, is_correct boolean")
    for n, (theta, se) in enumerate([(1, 2.062826), (0, 1.458638), (1, 1.190973), (0, 1.294683)], start=1):
        got = K.irt(df.where(F.col("i") < n), "k", ["i"]).first()
        assert round(got.theta, 6) == theta
        assert got.se == pytest.approx(se, abs=1e-5)


def test_mastery(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate((True, True, True, False, True))], "k string, i int, is_correct boolean")
    states = K.mastery(df, ["k"], ["i"])
    assert [s for _, s in values(states, "attempt", "state")] == ["learning", "learning", "mastered", "practicing", "practicing"]
    assert K.mastered_at(states, ["k"], "i").first().mastered_at == 2


def test_streaks(spark):
    days = [("a", dt.date(2024, 1, d)) for d in (1, 1, 2, 4, 5, 6)]
    got = K.daily_streaks(spark.createDataFrame(days, "k string, day date"), "k", "day").first()
    assert (got.current, got.longest) == (3, 3)


@pytest.mark.parametrize(("weights", "seats", "want"), [((50, 30, 20), 7, [4, 2, 1]), ((1, 1, 1), 10, [4, 3, 3]), ((0, 0, 0), 5, [2, 2, 1])])
def test_largest_remainder(spark, weights, seats, want):
    df = spark.createDataFrame([("k", i, w) for i, w in enumerate(weights)], "k string, item int, w int")
    assert [s for _, s in values(A.largest_remainder(df, ["k"], "item", "w", seats), "item", "seats")] == want


def test_weakness_roots(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "from_node int, to_node int")

    def roots(*known):
        return values(G.weakness_roots(spark.createDataFrame([("s", n, float(a)) for n, a in known], "s string, node int, accuracy double"), edges, "s"), "root")

    assert roots((3, 20), (2, 40)) == [(1,)]
    assert roots((3, 20), (2, 40), (1, 80)) == [(2,)]
    assert roots((3, 20), (2, 60)) == [(3,)]


def test_weak_units_skip_ungraded(spark):
    rows = [(1, "A", c) for c in (True, False, False, False)] + [(1, "B", c) for c in (True, True, True, False)] + [(1, None, c) for c in (True, False, None)]
    answers = spark.createDataFrame([(s, i, c) for i, (s, _, c) in enumerate(rows)], "submission_id int, problem_id int, is_correct boolean")
    problems = spark.createDataFrame([(i, u) for i, (_, u, _) in enumerate(rows)], "problem_id int, unit string")
    submissions = spark.createDataFrame([(1, 9, "graded")], "submission_id int, student_id int, status string")
    accuracy = A.accuracy_by_unit(answers, submissions, problems)
    assert values(accuracy, "accuracy", "unit") == [(25, "A"), (50, "unclassified"), (75, "B")]
    assert values(A.weak_units(accuracy), "unit") == [("A",), ("B",)]


def test_roll_up_of_typed_json(spark):
    at = dt.datetime(2024, 1, 1)
    events = [("session_started", "{}", "x")] + [("answer_submitted", p, "x") for p in ('{"isCorrect":true}', '{"isCorrect":"true"}', '{"isCorrect":null}', "{}")]
    events += [("session_ended", p, "y") for p in ('{"durationMs":10.5}', '{"durationMs":-1}', '{"durationMs":"9"}')]
    df = spark.createDataFrame([("s1", e, p, s, at) for e, p, s in events], "student_id string, event_type string, payload string, session_id string, client_ts timestamp")
    got = A.daily_roll_up(df).first()
    assert (got.viewed, got.solved, got.correct, got.duration_ms, got.n_sessions) == (1, 2, 1, 11, 2)


def test_event_window(spark):
    now = dt.datetime(2024, 1, 10)
    offsets = [dt.timedelta(seconds=31), dt.timedelta(seconds=30), dt.timedelta(days=-7), dt.timedelta(days=-7, milliseconds=-1)]
    df = spark.createDataFrame([(i, now + o) for i, o in enumerate(offsets)], "i int, ts timestamp")
    assert [r[1] for r in sorted(df.select("i", E.acceptable(F.col("ts"), F.lit(now)).alias("ok")).collect())] == [False, True, True, False]


def test_streaming_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    rows = [(i, i % 5, ("session_started", "answer_submitted", "session_ended")[i % 3], ('{"isCorrect":true}', '{"durationMs":20}', "{}")[i % 2], f"s{i % 4}", dt.datetime(2024, 1, 1 + i % 3, i % 24)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, student_id int, event_type string, payload string, session_id string, client_ts timestamp")
    df.repartition(2).write.parquet(str(src))
    stream = E.daily_windows(spark.readStream.schema(df.schema).parquet(str(src)))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(E.upsert_batches(str(out), "day", E.keyed_replacement(["student_id", "day"]))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    columns = ("student_id", "day", "viewed", "solved", "correct", "duration_ms", "n_sessions")
    assert values(E.current(spark, str(out)), *columns) == values(A.daily_roll_up(df), *columns)


def test_segments(spark):
    lines = ["intro", "1. a", "2.5 x", "60. y", "2. b"]
    df = spark.createDataFrame([("d", 1, i, t, 100.0) for i, t in enumerate(lines)], "doc_id string, page_number int, line_number int, text string, bbox_x double")
    got = D.assembled(D.segments(df, "doc_id"), "doc_id")
    assert sorted(((r.number or 0), r.text) for r in got.collect()) == [(0, "intro"), (1, "1. a\n2.5 x\n60. y"), (2, "2. b")]
    other = spark.createDataFrame([("d", 1, 0, "1. a", 100.0), ("d", 1, 1, "z", 1500.0), ("d", 1, 2, "b", 200.0)], df.schema)
    assert D.assembled(D.segments(other, "doc_id"), "doc_id").first().text == "1. a\nb"


def test_choices():
    stem, choices = D.split_choices("12. 함수 f(x)=x^2일 때 옳은 것은?\n① f(1)=0  ② f(2)=1 ③ f(3)=2\n④ f(4)=3 ⑤ f(2)=4")
    assert stem.startswith("12.")
    assert (len(choices), choices[0], choices[-1]) == (5, "f(1)=0", "f(2)=4")
    assert D.split_choices(None) == ("", [])
    assert D.split_choices("① a ② b")[1] == []


def test_answer_table(spark):
    text = ["01 지수와 로그", "유제", "1 ① 2 ③ 3 125", "9 ③ 10 ①", "Level 1 기초 연습", "1 ⑤ 5 100"]
    df = spark.createDataFrame([("d", 102, i, t) for i, t in enumerate(text)], "doc_id string, page_number int, line_number int, text string")
    got = {(r.chapter, r.section, r.number): r.answer for r in D.answer_table(df, "doc_id").collect()}
    assert got[("01", "practice", 1)] == "①"
    assert got[("01", "practice", 3)] == "125"
    assert got[("01", "practice", 10)] == "①"
    assert got[("01", "level1", 1)] == "⑤"
    assert got[("01", "level1", 5)] == "100"


@pytest.mark.parametrize(("parts", "want"), [((0.9, 0.7), 0.8), ((0.82, None), 0.82), ((None, 0.64), 0.64), ((1.2, -0.2), 0.5), ((None, None), 0.0)])
def test_ai_confidence(spark, parts, want):
    got = spark.range(1).select(J.ai_confidence(*(F.lit(p).cast("double") for p in parts)).alias("c")).first().c
    assert got == pytest.approx(want)


def test_rank_fusion(spark):
    keyword = spark.createDataFrame([("a", 1), ("c", 2)], "id string, rank int")
    semantic = spark.createDataFrame([("b", 1), ("a", 2)], "id string, rank int")
    got = {r.id: round(r.score, 6) for r in J.reciprocal_rank_fusion([keyword, semantic], "id").collect()}
    assert got == {"a": 0.032522, "b": 0.016393, "c": 0.016129}


def test_upsert_and_delete(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert values(O.keyed_upsert(old, new, ["k"]), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    left = O.cascade_delete(old, {"children": (new.withColumnRenamed("k", "fk"), "fk")}, old.where("k = 2"), "k")
    assert values(left["parents"], "k") == [(1,)]
    assert values(left["children"], "fk") == [(3,)]


def test_priority_union(spark):
    df = spark.createDataFrame([("s", "p1", 3), ("s", "p1", 1), ("s", "p2", 2)], "s string, p string, priority int")
    assert values(O.priority_union([df], ["s", "p"], "priority", 10, "s", "p"), "p", "priority") == [("p1", 1), ("p2", 2)]


def slot(n, unit="u", subject="s", kind="mc", low=2, high=3, available=0):
    return {"exam": "e", "slot": n, "subject": subject, "unit": unit, "kind": kind, "low": low, "high": high, "available": available}


def problem(n, unit="u", subject="s", kind="mc", difficulty=2, source=None):
    return {"problem_id": n, "subject": subject, "unit": unit, "kind": kind, "difficulty": difficulty, "source": source}


@pytest.mark.parametrize(
    ("pool", "pick", "relaxed", "score"),
    [
        ([problem(1), problem(2, difficulty=3)], 1, None, 0.95),
        ([problem(1, difficulty=4)], 1, "expand_difficulty", 0.85),
        ([problem(1, unit="v", difficulty=1)], 1, "expand_unit", 0.65),
        ([problem(1, unit="v", subject="t")], 1, "drop_subject", 0.55),
        ([problem(1, unit="v", subject="t", kind="essay")], 1, "relax_kind", 0.35),
        ([problem(1, difficulty=6)], None, None, 0.0),
        ([problem(3, difficulty=None), problem(9, difficulty=None)], 3, None, 0.95),
    ],
)
def test_slot_relaxes_step_by_step(pool, pick, relaxed, score):
    (((_, got, name),), total) = C.fill_slots([slot(0)], pool)
    assert ((got or {}).get("problem_id"), name, total) == (pick, relaxed, score)


def test_scarce_slots_come_first_and_swaps_mend():
    slots = [slot(0, available=2), slot(1, unit="v", available=1)]
    filled, score = C.fill_slots(slots, [problem(1), problem(2, unit="v")])
    assert [(s["slot"], c["problem_id"]) for s, c, _ in filled] == [(1, 2), (0, 1)]
    assert score == 0.95
    sources = [problem(n, source="x") for n in range(3)] + [problem(9, source="y")]
    filled, _ = C.fill_slots([slot(0), slot(1)], sources)
    assert sorted(c["problem_id"] for _, c, _ in filled) == [0, 9]  # one of each source
    filled, score = C.fill_slots([slot(0), slot(1)], [problem(1)])
    assert [c and c["problem_id"] for _, c, _ in filled] == [1, None]
    assert score == 0.48


def test_composition_reaches_all_it_needs(spark):
    """Every exam as if it had been filled from all problems at once."""
    slots, usable = exam_plan(Tables(spark, "/root/testdata/sf0.001"))
    pool = [r.asDict() for r in usable.collect()]
    for seats in (10, 4):
        mine = slots.where(F.col("slot") < seats)
        composed = catalog.queries()["J15_exam_composition"](spark, "/root/testdata/sf0.001") if seats == 10 else C.compose_exam(mine, usable, seats)
        got = {(r.exam, r.slot): (r.problem_id, r.relaxed, r.match_score) for r in composed.collect()}
        assert len(got) == mine.count()
        for exam, own in itertools.groupby(sorted((r.asDict() for r in mine.collect()), key=lambda s: s["exam"]), key=lambda s: s["exam"]):
            own = list(own)
            for s in own:
                s["available"] = sum(C.suits(c, s) for c in pool)
            filled, score = C.fill_slots(own, pool)
            assert [got[exam, s["slot"]] for s, _, _ in filled] == [(c["problem_id"] if c else None, name, score) for _, c, name in filled]


def test_slots_find_their_counts_without_a_nested_loop(spark):
    pool = [(i, *r) for i, r in enumerate(itertools.product(("s", "t", None), ("u", "v", None), ("k", None), (1, 3, None)))]
    problems = spark.createDataFrame([(*r, 0) for r in pool], "problem_id long, subject string, unit string, kind string, difficulty int, source int")
    asked = [("e", n, *a) for n, a in enumerate(itertools.product(("s", None), ("u", "w", None), ("k", "z", None), ((1, 2), (3, 3), (5, 4))))]
    slots = spark.createDataFrame([(e, n, s, u, k, lo, hi) for e, n, s, u, k, (lo, hi) in asked], "exam string, slot int, subject string, unit string, kind string, low int, high int")
    got = C.with_available(slots, problems)
    for r in got.collect():
        assert r.available == sum(C.suits(c.asDict(), r.asDict()) for c in problems.collect()), r
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_group_ranks_of_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), F.xxhash64("id").alias("v"))
    ranked = O.group_ranks(rows, ["g"], [F.desc("v")])
    by = {}
    for r in sorted(ranked.collect(), key=lambda r: -r.v):
        by.setdefault(r.g, []).append((r["rank"], r.total))
    assert {g: len(x) for g, x in by.items()} == {r.g: r["count"] for r in rows.groupBy("g").count().collect()} and None in by
    assert all(x == [(i, len(x)) for i in range(1, len(x) + 1)] for x in by.values())


def test_knn_index_recall(spark):
    """Cells of 64 vectors, a third of them in one cluster: ids divisible by 100 against brute force."""
    draw = np.random.default_rng(4)
    centers = draw.normal(size=(40, 16))
    x = centers[np.where(draw.random(3000) < 0.33, 0, draw.integers(0, 40, 3000))] + 0.4 * draw.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows = J.knn_all_pairs(df, "id", "v", k=10, least=-1.0, cell_rows=64, probes=12).collect()
    assert len(rows) == 30_000  # every item is indexed and has its neighbours
    found = {i: {r.neighbour for r in rows if r.id == i} for i in range(0, 3000, 100)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for i, got in found.items():
        scores = unit @ unit[i]
        scores[i] = -2
        hits.append(len(got & set(np.argsort(-scores)[:10].tolist())))
    assert np.mean(hits) >= 9
    assert J.knn_all_pairs(df.limit(0), "id", "v").collect() == []


def test_fused_page_counts_ranks(spark):
    """The page of two lists against ranking both whole."""
    draw = np.random.default_rng(9)
    lists = [[(int(i), float(round(draw.random(), 2))) for i in draw.permutation(400)[:n]] for n in (350, 60)]
    frames = [spark.createDataFrame(rows, "id long, score double") for rows in lists]
    fused = {}
    for rows in lists:
        for rank, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
            fused[i] = fused.get(i, 0) + 1 / (60 + rank)
    want = sorted(fused.items(), key=lambda r: (-r[1], r[0]))[:15]
    got = [(r.id, r.score, r.total) for r in J.fused_page(frames, "id", 15).orderBy(F.desc("score"), "id").collect()]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert {g[2] for g in got} == {len(fused)}


def test_knn_top_then_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = J.knn_all_pairs(df, "id", "v", k=2, least=0.5)
    assert values(got, "id", "neighbour") == [(1, 2), (2, 1)]


@pytest.mark.parametrize(("d", "seconds", "want"), [(3, 450, 0.5), (1, 20, 0.8333), (3, 200, 1.0), (None, None, 0.5)])
def test_time_score(spark, d, seconds, want):
    got = spark.range(1).select(J.time_score(F.lit(d).cast("int"), F.lit(seconds).cast("int")).alias("s")).first().s
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(("kind", "factors", "score", "ok"), [("exam", (0.8, 1.0, 1.0, 1.0), 0.94, True), ("exam", (0.8, 0.8, 1.0, 0.5), 0.765, False), ("textbook_with_key", (1.0, 1.0, 1.0, 1.0, 1.0, 0.2), 0.8, True), ("textbook", (1.0, 1.0, 1.0, 1.0, 0.3, None), 0.79, False)])
def test_review(spark, kind, factors, score, ok):
    factors = (*factors, *[None] * (6 - len(factors)))
    made = R.review(F.lit(kind), tuple(F.lit(f).cast("double") for f in factors), {"known": F.lit(True), "strategy": F.lit(None).cast("boolean") if kind == "exam" and not ok else F.lit(True)})
    row = spark.range(1).select(*(c.alias(n) for n, c in made.items())).first()
    assert row.score == pytest.approx(score)
    assert row.decision == ("auto_approved" if ok else "pending_review")
    assert row.failed == ([] if ok else (["strategy"] if kind == "exam" else []) + ["confidence_above_threshold"])


@pytest.mark.parametrize(("subject", "unit", "chapter", "want"), [("math", "limits", None, 0.5), ("math", "limits", "Math 1", 1.0), ("x", "limits", "on limits", 0.9), ("x", "limits", "limit or", 0.8), (None, "limits", "a b", 0.3), ("x", None, "other", 0.3)])
def test_chapter_match(spark, subject, unit, chapter, want):
    columns = [F.lit(v).cast("string") for v in (subject, unit, chapter)]
    assert spark.range(1).select(R.chapter_match(*columns).alias("s")).first().s == want


@pytest.mark.parametrize(("found", "key", "status", "want"), [("③", "3", "matched", 1.0), (" 3 ", "③", "matched", 1.0), ("2", "3", "matched", 0.0), (None, "3", "matched", 0.0), ("3", "3", "open", 0.5), ("3", "", "matched", 0.5), ("3", "3", None, 0.5)])
def test_answer_cross_check(spark, found, key, status, want):
    columns = [F.lit(v).cast("string") for v in (found, key, status)]
    assert spark.range(1).select(R.answer_cross_check(*columns).alias("s")).first().s == want


def test_grade_and_smart_score(spark):
    submissions = spark.createDataFrame([(1, 9, "graded", dt.datetime(2024, 1, 1))], "submission_id int, student_id int, status string, submitted_at timestamp")
    answers = spark.createDataFrame([(1, 1, True, 1), (1, 2, False, 2), (1, 3, True, 3)], "submission_id int, problem_id int, is_correct boolean, answer_no int")
    problems = spark.createDataFrame([(1, 3, "A"), (2, 2, "A"), (3, 5, "B")], "problem_id int, difficulty int, unit string")
    got = A.grade_prediction(submissions, answers, problems).first()
    assert (got.predicted_score, got.grade, round(got.confidence, 2)) == (80, 3, 0.06)
    answers = spark.createDataFrame([(1, i, c, i) for i, c in ((1, True), (2, True), (3, False), (4, True))], answers.schema)
    problems = spark.createDataFrame([(1, 3, "A"), (2, 4, "A"), (3, 5, "B"), (4, None, "B")], problems.schema)
    assert A.smart_scores(answers, problems).first().smart_score == 98.5


def test_workbook_items(spark):
    from gaugeleaf.operators import workbook as B

    page5 = ["01 지수와 로그", "예제 1 거듭제곤근", "³√(27/³√27) × ⁵√9의 값은?", "① ³√3  ② √3  ③ 1  ④ 3  ⑤ 9", "잠깐이", "a>0, b>0이고", "풀이", "³√27=3이므로", "답 ④", "유제", "[26008-0001]", "1", "⁵√(-3.2)×10⁶의 값은?", "① -20  ② -16", "[26008-0002]", "8 이하의 자연수 a, b에 대하여"]
    page14 = ["Level 1 기초 연습", "[26008-0011]", "1", "⁴√81 × ⁶√8의 값은?", "한눈에 보는 정답", "[26008-0099]", "1", "끝"]
    rows = [("d", p, i, t) for p, lines in ((5, page5), (14, page14)) for i, t in enumerate(lines)]
    items = B.coded_items(spark.createDataFrame(rows, "doc_id string, page_number int, line_number int, text string"), "doc_id").collect()
    by = {(r.section, r.number): r for r in items}
    assert set(by) == {("example", 1), ("practice", 1), ("practice", 2), ("level1", 1)}
    example = by["example", 1]
    assert (example.answer, example.stem.split("\n")[0], example.hint, example.solution) == ("④", "거듭제곤근", "a>0, b>0이고", "³√27=3이므로")
    assert by["practice", 2].code == "26008-0002"


def test_boxed_layout(spark):
    text = ["for f", "(가) one", "(나) two", "and", "<보기>", "ㄱ. a", "ㄴ. b", "which", "① ㄱ", "ㄷ. no"]
    df = spark.createDataFrame([("s", i, t, 40.0 * i if i < 6 else 205.0, 30.0) for i, t in enumerate(text)], "seg string, line_number int, text string, bbox_y double, bbox_h double")
    got = [(r.kind, r.n_lines, r.n_columns) for r in D.boxed_layout(df, "seg").orderBy("block").collect()]
    assert got == [("text", 1, 1), ("condition", 2, 1), ("text", 1, 1), ("view", 3, 2), ("text", 1, 1)]


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = O.global_rank(df, [F.desc("x")])
    assert all(r.x + r["rank"] == 1000 for r in got.collect())
    assert O.global_rank(df.limit(0), [F.col("x")]).collect() == []


def test_trees_of_any_depth(spark):
    chain = [(str(i), str(i - 1) if i else None, f"l{i}", i) for i in range(8)] + [("x", "gone", "lx", 0), ("y", "x", "ly", 0), ("z", None, "lz", 0)]
    nodes = lambda rows: spark.createDataFrame(rows, "node_id string, parent_id string, label string, level int")
    assert sorted(r.node_id for r in G.subtree(nodes(chain), "2").collect()) == ["2", "3", "4", "5", "6", "7"]
    assert len(G.subtree(nodes(chain), "0").collect()) == 8 and G.subtree(nodes(chain), "none").count() == 0
    found = {r.node_id: r.path for r in G.paths(nodes(chain)).collect()}
    assert found["7"] == "/".join(f"l{i}" for i in range(8)) and sorted(found) == [*"01234567", "z"]
    loop = [("a", "c", "a", 0), ("b", "a", "b", 0), ("c", "b", "c", 0), ("d", "c", "d", 0)]
    for walk in (lambda: G.paths(nodes(loop)), lambda: G.subtree(nodes(loop), "b"), lambda: G.subtree(nodes([*loop, *chain]), "2")):
        with pytest.raises(ValueError, match="cycle"):
            walk()
    assert G.paths(nodes([])).count() == 0


def test_exam_rules_read_the_number_a_few_times(spark):
    rows = spark.range(32).selectExpr("id AS problem_id", "false AS is_textbook", "concat('Q', id) AS problem_number", "2.0D AS difficulty", "CAST(NULL AS STRING) AS question_format", "'a' AS ai_answer", "'b' AS answer_text")
    out = D.apply_exam_rules(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 3
    got = {r.problem_id: (r.position_type, r.point_value, r.question_format) for r in out.collect()}
    for k in range(32):
        want = next((rule for first, last, *rule in D.EXAM_RULES if first <= k <= last), ["normal", 2, None])
        assert got[k] == tuple(want)


def test_nearest_in_block_is_exact_with_ties():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(700, 16))
    x[100:140] = x[7]  # copies
    x[200:230] = x[8] + 1e-7 * draw.normal(size=(30, 16))  # nearer to each other than single precision tells
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, others = np.arange(700)[::-1] * 3, np.arange(700) * 3
    row, near, score = J.nearest_in_block(ids, x[::-1], others, x, 5)
    exact = np.einsum("id,jd->ij", x, x)
    for k in (0, 7, 8, 110, 215, 699):
        want = sorted((-round(exact[k, j], 12), 3 * j) for j in range(700) if j != k)[:5]
        mine = row == 699 - k
        assert list(near[mine]) == [j for _, j in want] and np.allclose(score[mine], [-s for s, _ in want], atol=1e-12)
    few = J.nearest_in_block(ids[:1], x[-1:], others[-2:], x[-2:], 5)
    assert list(few[1]) == [3 * 698]
    x[699] = np.nan
    row, near, _ = J.nearest_in_block(others, x, others, x, 5)
    assert np.bincount(row, minlength=700).tolist() == [5] * 699 + [0] and 3 * 699 not in near


def test_index_is_searched_for_the_asked_alone(spark):
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in draw.normal(size=8)]) for i in range(400)], "id long, v array<double>")
    index = J.vector_index(df, "id", "v", cell_rows=20, probes=15)
    assert index.count() == 400 and {len(r.cells) for r in index.collect()} == {15}
    asked = index.where("id % 100 = 0")
    got = J.search_index(index, asked, "id", "v", 5, 50).collect()
    assert sorted(r.rank for r in got) == sorted([1, 2, 3, 4, 5] * 4)
    exact = {(r.id, r.neighbour) for r in J.nearest_of_each(df.where("id % 100 = 0"), df.selectExpr("id AS neighbour", "v AS other"), "id", "v", 5, block=60).collect()}
    x = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in df.collect()}
    assert exact == {(i, j) for i in (0, 100, 200, 300) for j in sorted((j for j in x if j != i), key=lambda j: -(x[i] @ x[j]))[:5]}
    assert len(exact & {(r.id, r.neighbour) for r in got}) >= 16


def test_knn_misses_no_neighbour_beyond_its_probes(spark):
    """Vectors without clusters in 40 cells, a cluster, 60 copies of a vector, one without direction and one of none: all equal to brute force."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(800, 12))
    x[300:420] = x[3] + 0.02 * draw.normal(size=(120, 12))
    x[500:560] = x[5]
    x[77] = 0
    ids = draw.permutation(800) * 3 + 2**60
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame([*rows, (5, None)], "id long, v array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    scores = np.round(np.einsum("id,jd->ij", unit, unit), 12)
    for least in (-1.0, 0.6):
        got = {(r.id, r["rank"]): (r.neighbour, r.score) for r in J.knn_all_pairs(df, "id", "v", k=10, least=least, cell_rows=20, probes=3).collect()}
        want = {}
        for a in range(800):
            order = [b for b in np.lexsort((ids, -scores[a])) if b != a][:10]
            want |= {(int(ids[a]), n): (int(ids[b]), pytest.approx(scores[a, b], abs=1e-4)) for n, b in enumerate(order, 1) if scores[a, b] >= least}
        assert got == want


def test_search_of_blocks_leaves_out_those_too_far(tmp_path):
    """A cluster's items do not read the blocks of the others, whose files are not there."""
    draw = np.random.default_rng(12)
    x = np.eye(8)[np.repeat(np.arange(4), 50)] + 0.01 * draw.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    balls = [J.ball(x[a : a + 50]) for a in range(0, 200, 50)]
    file = str(tmp_path / "block.parquet")
    pd.DataFrame({"ids": [np.arange(50, 100).tobytes()], "rows": [x[50:100].tobytes()]}).to_parquet(file)
    near, score = J.nearest_in_files(np.arange(50, 100), x[50:100], 5, 0.0, ["gone", file, "gone", "gone"], np.array([c for c, _ in balls]), np.array([r for _, r in balls]))
    exact = x[50:100] @ x[50:100].T - 2 * np.eye(50)
    assert near.tolist() == (50 + np.argsort(-exact, axis=1)[:, :5]).tolist()
    assert np.allclose(score, -np.sort(-exact, axis=1)[:, :5])
