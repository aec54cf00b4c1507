"""Books: overview answers, solutions, matching, exam heads and textbook problems, from the rules of the grammar."""

import pytest
from pyspark.sql import functions as F

from gaugeleaf.operators import answers as A
from gaugeleaf.operators import documents as D
from gaugeleaf.operators import textbook as X
from gaugeleaf.operators.ordered import ordered_fold


def lines(spark, *texts, page=1, book="b"):
    rows = [(book, page, i, *(t if isinstance(t, tuple) else ("text", t))) for i, t in enumerate(texts, start=1)]
    return spark.createDataFrame(rows, "book string, page_number int, line_number int, line_type string, text string").repartition(3)


def overview(spark, *texts):
    return {(r.chapter, r.section, r.number): r.answer for r in A.overview_answers(lines(spark, *texts), "book").collect()}


def test_overview_of_one_and_two_chapters(spark):
    found = overview(spark, "01 지수와 로그", "유제", "1 ① 2 ③ 3 125 4 ④ 5 ① 6 ② 7 ⑤ 8 ③", "9 ③ 10 ①", "Level 1 기초 연습", "1 ⑤ 2 ⑤ 3 ② 4 ⑤ 5 100 6 5 7 ⑤ 8 ⑤")
    assert [found["01", "practice", n] for n in ("1", "3", "10")] == ["①", "125", "①"]
    assert [found["01", "level1", n] for n in ("1", "5")] == ["⑤", "100"] and len(found) == 18
    found = overview(spark, "01 지수와 로그", "유제", "1 ① 2 ③", "02 지수함수와 로그함수", "1 ④", "유제", "1 ② 2 ③")
    assert found == {("01", "practice", "1"): "①", ("01", "practice", "2"): "③", ("02", "practice", "1"): "②", ("02", "practice", "2"): "③"}


def test_overview_cells_levels_and_tables(spark):
    table = "\\begin{tabular}{|l|l|}\\hline Level $\\mathbf{3}$ 실력 완성 & 1 (4) \\\\ \\hline 2 (5) & \\end{tabular}"
    found = overview(spark, "03 수열", "Level", "2 기본 연습", "3125", "4 (2) 5(1)", "www.example.org 9 ①", "본문 8 9", ("table", table), "6 ①", "Level", "Level", "기초", "7 ②", "유제 8 ③")
    assert found == {
        ("03", "level2", "3"): "125", ("03", "level2", "4"): "(2)", ("03", "level2", "5"): "(1)",
        ("03", "level3", "1"): "(4)", ("03", "level3", "2"): "(5)", ("03", "level3", "6"): "①", ("03", "level3", "7"): "②", ("03", "practice", "8"): "③",
    }
    assert overview(spark, None, " ", "1 ①", "유제", "2 ②") == {}  # no chapter
    assert A.overview_answers(lines(spark, "x").limit(0), "book").count() == 0


def solved(spark, *texts):
    return {(r.chapter, r.section, r.number): (r.solution, r.answer) for r in A.book_solutions(lines(spark, *texts), "book").collect()}


def test_solutions_behind_a_summary(spark):
    found = solved(spark, "01 지수와 로그", "유제", "1 (4) 2 (3)", "3125", "본문 4~7쪽", "1", "$\\begin{aligned} x \\end{aligned}$", "답 (4)", "2 조건에서 x=1", "더 본다", ("page_footer", "정답 9"), "뎝 1 2", "3(\\sqrt{2})x", "끝")
    assert found == {
        ("01", "practice", "1"): ("$\\begin{aligned} x \\end{aligned}$\n답 (4)", "(4)"),
        ("01", "practice", "2"): ("2 조건에서 x=1\n더 본다\n뎝 1 2", "12"),
        ("01", "practice", "3"): ("3(\\sqrt{2})x\n끝", None),
    }


def test_numbers_that_open_nothing_and_heads_that_close(spark):
    found = solved(
        spark, "02 함수", "Level", "3 실력 완성", "1 첫 번째 풀이", "1 같은 번호의 줄", "45 서른보다 큰 줄", "5 ab", "여섯 글자 넘는 줄", ("page_info", "가려진 줄"), ("table", "\\begin{tabular}{|c|} ㄱovel & 2 기본 연습 \\end{tabular}"), "답 7", "4", "답 (1)", "둘", "대표 기출", "4 content of it",
    )
    assert found == {
        ("02", "level3", "1"): ("1 첫 번째 풀이\n1 같은 번호의 줄\n45 서른보다 큰 줄", None), ("02", "level3", "5"): ("여섯 글자 넘는 줄", None), ("02", "past_exam", "4"): ("4 content of it", None),
    }


def test_later_solutions_of_a_number_count(spark):
    found = solved(spark, "04 적분", "유제", "1 first one", "답 1", "2 another", "1 second one", "답 2", "2 (1)", "1 (2) 3")
    assert found["04", "practice", "1"] == ("1 second one\n답 2", "2")


def test_solution_moves_to_the_section_of_its_answer(spark):
    keys = "book string, chapter string, section string, number string, "
    shown = spark.createDataFrame([("b", "01", s, n, a) for s, n, a in (("practice", "1", "(1)"), ("level1", "1", "(3)"), ("level2", "1", "(3)"), ("practice", "2", "7"), ("level1", "2", "8"), ("past_exam", "2", "9"))], keys + "answer string")
    had = [("practice", "1", "x\n달 (3)", 1), ("practice", "2", "x\n답 9 ", 2), ("level1", "2", "y\n답 9", 3), ("level2", "9", "z", 4)]
    given = spark.createDataFrame([("b", "01", *h) for h in had], keys + "solution string, place int")
    got = {(r.section, r.number): r.solution for r in A.in_section_of_answer(given, shown, "book").collect()}
    assert got == {("level1", "1"): "x\n달 (3)", ("past_exam", "2"): "y\n답 9", ("level2", "9"): "z"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("005 ★☆☆ 2014년 6월학평 A형 7번(고2) 자연수 n에 대하여", (2014, "학평", "6월학평 A형", 7, "고2", "A형", "자연수 n에 대하여", "★☆☆ 2014년 6월학평 A형 7번 (고2)")),
        ("154★★★ 2018학년도 경찰대 19번", (2018, "경찰대", "경찰대", 19, None, None, "", "★★★ 2018학년도 경찰대 19번")),
        ("3 2019학년도 경찰대 수능 대비 12번(고3)", (2019, "경찰대", "경찰대 수능 대비", 12, "고3", None, "", "2019학년도 경찰대 수능 대비 12번 (고3)")),
        ("7 2020학년도 6월 모의평가 21번 가", (2020, "모평", "6월 모의평가", 21, None, "가", "", "2020학년도 6월 모의평가 21번")),
        ("7 2020학년도 15나 x", (2020, None, None, 15, None, "나", "x", "2020학년도 15 나")),
        ("12. 함수 f(x)", None), ("7 1998학년도 수능 3번", None), ("7 2018학년도 수능", None),
    ],
)
def test_exam_heads(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(X.exam_source(F.col("t")).alias("h")).first().h
    assert (got and (got.year, got.type, got.label, got.item, got.audience, got.form, got.rest, got.raw)) == want


def problems(spark, *rows):
    made = [("b", page, i, kind, text, x and float(x), y and float(y)) for i, (page, kind, text, x, y) in enumerate(rows, start=1)]
    frame = spark.createDataFrame(made, "book string, page int, line_number int, line_type string, text string, bbox_x double, bbox_y double")
    return X.textbook_problems(frame.repartition(2), "book").orderBy("place").collect()


def test_starts_of_problems(spark):
    texts = ["예제 3 a", "0012 b", "12. 함수", "[7] 다음", "⑬ c", "문제 4", "Q9 d", "2.5 not one", "3000 e", "154★★★ 2018학년도 경찰대 19번", "  유제 2"]
    got = [(r.number, r.display, r.category, r.stem.split("\n")[0]) for r in problems(spark, *[(1, "text", t, None, None) for t in texts])]
    assert got == [
        (3, "예제 3", "example", "a"), (12, "0012", None, "b"), (12, "12.", None, "함수"), (7, "[7]", None, "다음"), (13, "⑬", None, "c"), (4, "문제 4", "problem", "문제 4"),
        (9, "Q 9", "problem", "d"), (154, "154", None, "154★★★ 2018학년도 경찰대 19번"), (2, "유제 2", "practice", "유제 2"),
    ]


def test_heads_keep_their_source_out_of_the_stem(spark):
    got = problems(spark, (1, "page_info", "154★★★ 2018학년도 경찰대 19번", None, None), (1, "text", "정수 d는 등차수열의 공차이다.", None, None), (1, "text", "(가) a=-2016", None, None), (1, "page_info", "page 12", None, None), (2, "page_info", "155★★★ 2023학년도 경찰대 5번", None, None), (2, "text", "값을 구하여라.", None, None))
    assert [(r.number, r.stem, r.source.item, r.start_page, r.end_page) for r in got] == [(154, "정수 d는 등차수열의 공차이다.\n(가) a=-2016", 19, 1, 2), (155, "값을 구하여라.", 5, 2, 2)]


def test_a_question_in_another_place_behind_full_choices_opens_the_next(spark):
    stem, asked = "$4^{1}$ 의 값은？（2점）", "$3^{2}$ 의 값은? (2점)"
    first = [(13, "page_info", "057 ★仼舟 2003년 견혐명 1번", 1140, 2109), (13, "text", stem, 1137, 2196), *[(13, "text", f"（{k}） {k}", 1135, 2279 + 10 * k) for k in range(1, 6)]]
    higher = [(13, "text", asked, 1135, 286), *[(13, "text", f"({k}) {k}", 1135, 397 + 10 * k) for k in range(1, 6)]]
    got = problems(spark, *first, *higher)
    assert [(r.number, r.display, r.inferred, r.stem, len(r.choices), r.problem_type) for r in got] == [(57, "057", False, stem, 5, "multiple_choice"), (58, "058", True, asked, 5, "multiple_choice")]
    for x, y, n in ((1135, 2400, 1), (1135, 2600, 2), (100, 2400, 2), (None, None, 2), (None, 2400, 1)):
        assert len(problems(spark, *first, (13, "text", asked, x, y))) == n, (x, y)
    assert len(problems(spark, *first, (13, "text", "no question", 1135, 286))) == 1
    assert len(problems(spark, *first[:5], (13, "text", asked, 1135, 286))) == 1  # three choices
    chain = problems(spark, (1, "text", "[9] a 값은?", None, None), *2 * [*[(1, "text", f"({k}) {k}", None, None) for k in (1, 2, 3, 4)], (1, "text", "b 값은?", None, None)])
    assert [(r.number, r.display) for r in chain] == [(9, "[9]"), (10, "[10]"), (11, "[11]")]


def test_concepts_chapters_and_sub_problems(spark):
    texts = ["before any", "제 3 장 수열", "Section 2", "1. first", "(1) one", "more", "2) two", "[정의] a concept", "not of a problem", "[유형 07] kind", "still not", "4단원 미분", "of first again", "NOTE x", "gone", "2. second"]
    got = problems(spark, *[(1, "text", t, None, None) for t in texts])
    assert [(r.number, r.chapter, r.section) for r in got] == [(1, "4단원 미분", "[유형 07] kind"), (2, "4단원 미분", "[유형 07] kind")]
    assert [(s.number, s.text) for s in got[0].subs] == [("1", "(1) one\nmore"), ("2", "2) two\nof first again")]
    assert got[0].lines == ["1. first", "(1) one", "more", "2) two", "of first again"]
    assert problems(spark, (1, "text", " ", None, None), (1, "text", None, None, None), (1, "text", "12", None, None)) == []


def test_choices_in_every_form():
    assert D.split_choices("x？（2점）\n（1） a（b） （2） c\n( 3 ) d 4) e 5. f") == ("x？（2점）", ["a（b）", "c", "d", "e", "f"])
    assert D.split_choices("1. stem\n\\circled{1} a \\textcircled{ 2 } b ③(3) c ④ d") == ("1. stem", ["a", "b", "c", "d"])
    for none in ("① a ② b ③ c ④ d", "x ① a ③ b ② c ④ d", "x ① a ② b ③ ④ d", "x f(1) f(2) f(3) f(4)"):
        assert D.split_choices(none) == (none, [])


def test_fold_over_batches_keys_and_nulls(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (100 - F.col("id")).alias("o"), F.col("id").alias("v"))
        step = lambda s, v: (s.append(v) or len(s), sum(s))
        got = ordered_fold(rows, ["k"], ["o"], ["v"], list, step, "n int, total long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = {}
    for r in sorted(got, key=lambda r: r.o):
        seen.setdefault(r.k, []).append(r.v)
        assert (r.n, r.total) == (len(seen[r.k]), sum(seen[r.k]))
    assert {k: len(v) for k, v in seen.items()} == {None: 34, 1: 33, 2: 33}
