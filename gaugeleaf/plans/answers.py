"""Answer pages of books: overview tables, solutions, and the answers and solutions of problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..sources.domain import Tables
from .registry import query

TEXT = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def plain(text: str) -> str:
    for old, new in ((r"\\begin\{tabular\}\{[^}]*\}|\\end\{tabular\}|\\hline", ""), (r"\\multicolumn\{\d+\}\{[^}]*\}\{([^}]*)\}", r"\1"), (r"\\mathbf\{(\d+)\}", r"\1"), (r"[$\\{}]", ""), ("&", " "), (r"\s+", " ")):
        text = f"regexp_replace({text}, '{old}', '{new}', 'g')"
    return f"trim({text})"


def cases(column: str, test: str, names: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(column, word)} THEN '{name}'" for word, name in names.items()) + " END"


LEVEL = cases(r"regexp_replace(t, '^\d+\s*', '')", "contains({}, '{}')", A.LEVEL_WORDS)
CIRCLED = A.CIRCLED

# Every line of a book in turn, the state carried from line to line; answers are read off afterwards.
OVERVIEW = rf"""WITH RECURSIVE l AS (SELECT book, page_number, line_number, {TEXT} AS t, line_type = 'table' AND contains({TEXT}, '\begin{{tabular}}') AS tab FROM overview_lines WHERE {TEXT} <> ''),
  m AS (SELECT *, CASE WHEN tab THEN {plain('t')} ELSE t END AS c, row_number() OVER (PARTITION BY book ORDER BY page_number, line_number) AS rn FROM l WHERE tab OR NOT regexp_matches(t, '^(?:www\.|본문|\\)')),
  f AS (SELECT book, CAST(0 AS BIGINT) AS rn, NULL::VARCHAR AS ch, NULL::VARCHAR AS se, false AS waits, false AS says FROM m GROUP BY book
    UNION ALL SELECT book, rn, ch2, se2, waits2, says2 FROM (
      SELECT m.book, m.rn, NOT tab AND regexp_matches(t, '{A.CHAPTER_HEAD}') AS head, NOT tab AND NOT head AND s.waits AS word, NOT tab AND NOT head AND NOT word AND t = 'Level' AS alone,
        CASE WHEN head THEN regexp_extract(t, '{A.CHAPTER_HEAD}', 1) ELSE s.ch END AS ch2,
        CASE WHEN head THEN NULL WHEN tab THEN coalesce({cases(rf"regexp_extract(c, 'Level\s*\d\s*({'|'.join(A.LEVEL_WORDS)})', 1)", "{} = '{}'", A.LEVEL_WORDS)}, {cases("c", "contains({}, '{}')", dict(reversed(A.SECTION_HEADS.items())))}, s.se)
          WHEN word THEN coalesce({LEVEL}, s.se) WHEN alone THEN s.se ELSE coalesce({cases("t", "starts_with({}, '{}')", A.SECTION_HEADS)}, s.se) END AS se2,
        CASE WHEN tab THEN s.waits ELSE alone END AS waits2, NOT (head OR word OR alone OR (NOT tab AND t IN ('유제', 'Level 1', 'Level 2', 'Level 3', 'Level 1 기초 연습', 'Level 2 기본 연습', 'Level 3 실력 완성'))) AND ch2 IS NOT NULL AND se2 IS NOT NULL AS says2
      FROM f s JOIN m ON m.book = s.book AND m.rn = s.rn + 1) q),
  p AS (SELECT book, rn, ch, se, c, regexp_extract_all(c, '\d{{1,2}}\s*\(\d\)') AS paren, regexp_extract_all(c, '\d{{1,2}}\s+(?:[{CIRCLED}]|\d+)') AS spaced FROM f JOIN m USING (book, rn) WHERE says),
  w AS (SELECT book, rn, ch, se, list_zip(cells, range(len(cells))) AS z FROM (SELECT book, rn, ch, se, CASE WHEN len(paren) > 0 THEN paren WHEN len(spaced) > 0 THEN spaced WHEN regexp_matches(c, '^\d\d+$') THEN [concat(c[1], ' ', c[2:])] ELSE [] END AS cells FROM p)),
  x AS (SELECT book, rn, ch, se, unnest(z) AS y FROM w)
  SELECT book, ch AS chapter, se AS section, regexp_extract(y[1], '^(\d+)', 1) AS number, arg_max(regexp_extract(y[1], '(\(\d\)|[^\s()]+)$', 1), (rn, y[2])) AS answer FROM x GROUP BY 1, 2, 3, 4"""


@query("I12_overview_answers", OVERVIEW)
def overview(t: Tables):
    return A.overview_answers(t.overview_lines, "book")


SOLVED = rf"""l AS (SELECT book, page_number, line_number, line_type, {TEXT} AS t, regexp_matches({TEXT}, '{A.ANSWER_SIGN}') AS ans, CASE WHEN line_type = 'table' THEN {plain(TEXT)} ELSE {TEXT} END AS c FROM solution_pages
    WHERE {TEXT} <> '' AND line_type NOT IN ('page_header', 'page_footer') AND (line_type <> 'page_info' OR regexp_matches({TEXT}, '{A.ANSWER_SIGN}'))),
  m AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_number, line_number) AS rn, coalesce({cases("c", "contains({}, '{}')", A.SOLUTION_HEADS)},
      CASE WHEN line_type = 'table' THEN CASE WHEN contains(c, '기초') AND contains(c, '연습') THEN 'level1' WHEN contains(c, '기본') AND contains(c, '연습') THEN 'level2' WHEN contains(c, '실력') AND contains(c, '완성') THEN 'level3' END END) AS label,
    {LEVEL} AS word, regexp_matches(t, '{A.SUMMARY_LINE}') AS short, TRY_CAST(regexp_extract(t, '^(\d{{1,2}})', 1) AS INTEGER) AS n1, TRY_CAST(regexp_extract(t, '^\$?(\d{{1,2}})\s+', 1) AS INTEGER) AS n, length(regexp_extract(t, '^\$?\d{{1,2}}\s+(.*)$', 1)) AS behind,
    TRY_CAST(regexp_extract(t, '^\$?(\d{{1,2}})$', 1) AS INTEGER) AS bare, TRY_CAST(regexp_extract(t, '^\$?(\d).{{4,}}$', 1) AS INTEGER) AS loose FROM l),
  f AS (SELECT book, CAST(0 AS BIGINT) AS rn, NULL::VARCHAR AS ch, NULL::VARCHAR AS se, false AS summing, 0 AS top, false AS level, NULL::INTEGER AS wait, NULL::INTEGER AS cur, 0 AS opened, NULL::INTEGER AS own, NULL::INTEGER AS place FROM m GROUP BY book
    UNION ALL SELECT book, rn, ch2, se2, summing2, top2, alone, wait2, cur2, opened2, own2, CASE WHEN own2 IS NOT NULL THEN CASE WHEN closes THEN was ELSE opened2 END END FROM (
      SELECT m.book, m.rn, s.opened AS was, regexp_matches(t, '{A.CHAPTER_HEAD}') AS head, NOT head AND s.level AND word IS NOT NULL AS by_word, NOT head AND NOT by_word AND t = 'Level' AS alone, NOT head AND NOT by_word AND NOT alone AND label IS NOT NULL AS by_label,
        CASE WHEN head THEN regexp_extract(t, '{A.CHAPTER_HEAD}', 1) ELSE s.ch END AS ch2, CASE WHEN head THEN NULL WHEN by_word THEN word WHEN by_label THEN label ELSE s.se END AS se2,
        head OR by_word OR by_label AS any_head, NOT any_head AND (alone OR ch2 IS NULL OR se2 IS NULL) AS idle,
        NOT any_head AND NOT idle AND s.summing AND ((short AND NOT coalesce(s.top >= 3 AND n1 < s.top, false)) OR starts_with(t, '본문')) AS summary,
        CASE WHEN by_word OR by_label THEN true WHEN head THEN false WHEN idle OR summary THEN s.summing ELSE false END AS summing2, CASE WHEN by_word OR by_label THEN 0 WHEN summary AND short THEN greatest(s.top, coalesce(n1, 0)) ELSE s.top END AS top2,
        NOT any_head AND NOT idle AND NOT summary AS body, body AND s.wait IS NOT NULL AND s.wait IS DISTINCT FROM s.cur AND length(t) > 3 AND NOT ans AS waited, body AND ans AS closes,
        CASE WHEN n BETWEEN 1 AND 30 AND behind > 3 THEN n END AS opens, CASE WHEN n BETWEEN 1 AND 30 AND behind <= 3 THEN n WHEN bare BETWEEN 1 AND 30 THEN bare END AS defers,
        CASE WHEN NOT body OR closes THEN NULL WHEN waited THEN s.wait WHEN opens IS NOT NULL AND opens IS DISTINCT FROM s.cur THEN opens WHEN defers IS NOT NULL THEN NULL WHEN s.cur IS NULL AND loose > 0 THEN loose END AS begins,
        body AND NOT waited AND NOT closes AND begins IS NULL AND defers IS NOT NULL AS deferred,
        CASE WHEN head THEN NULL WHEN NOT body THEN s.wait WHEN deferred THEN defers END AS wait2, CASE WHEN any_head OR closes THEN NULL WHEN NOT body THEN s.cur ELSE coalesce(begins, s.cur) END AS cur2,
        s.opened + CAST(begins IS NOT NULL AS INTEGER) AS opened2, CASE WHEN NOT body OR deferred THEN NULL WHEN closes THEN s.cur ELSE coalesce(begins, s.cur) END AS own2
      FROM f s JOIN m ON m.book = s.book AND m.rn = s.rn + 1) q),
  g AS (SELECT book, place, any_value(ch) AS chapter, any_value(se) AS section, CAST(any_value(own) AS VARCHAR) AS number, count(*) AS n_lines, bool_or(NOT ans) AS worked, string_agg(t, chr(10) ORDER BY rn) AS solution, arg_max(t, rn) FILTER (WHERE ans) AS stated FROM f JOIN m USING (book, rn) WHERE own IS NOT NULL GROUP BY 1, 2),
  solved AS (SELECT book, chapter, section, number, n_lines, solution, nullif(replace(regexp_extract(stated, '{A.ANSWER_SIGN}', 1), ' ', ''), '') AS answer FROM g WHERE worked QUALIFY row_number() OVER (PARTITION BY book, chapter, section, number ORDER BY place DESC) = 1)"""


@query("I12_solutions", f"WITH RECURSIVE {SOLVED} SELECT book, chapter, section, number, CAST(n_lines AS INTEGER) AS n_lines, answer, sha256(solution) AS solution FROM solved")
def solutions(t: Tables):
    found = A.book_solutions(t.solution_pages, "book")
    return found.select("book", "chapter", "section", "number", "n_lines", "answer", F.sha2("solution", 256).alias("solution"))


# Problems of three kinds of books: with an overview and solutions, with plain answer pages, and without any.
BOOK_PROBLEMS = """SELECT p_partkey AS problem_id, CAST(floor(p_partkey / 200) AS BIGINT) + CASE p_size % 4 WHEN 3 THEN 1000 WHEN 2 THEN CASE WHEN p_size % 8 = 2 THEN 5000 ELSE 0 END ELSE 0 END AS book, CASE WHEN p_size % 13 <> 0 THEN concat('0', 1 + p_size % 9, ' ', p_name) END AS chapter,
  CASE p_size % 6 WHEN 0 THEN 'practice' WHEN 1 THEN 'level1' WHEN 2 THEN 'level2' WHEN 3 THEN 'level3' WHEN 4 THEN 'past_exam' ELSE 'example' END AS section, CAST(1 + p_partkey % 12 AS STRING) AS local_number, CASE WHEN p_size % 5 <> 0 THEN CAST(1 + p_partkey % 40 AS STRING) END AS problem_number,
  CASE p_size % 3 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'short_answer' ELSE 'essay' END AS problem_type, CASE p_size % 11 WHEN 0 THEN '3' WHEN 1 THEN '' END AS inline_answer, CASE WHEN p_size % 22 = 0 THEN p_name END AS inline_solution FROM {part}"""
QUICK = "SELECT DISTINCT book, problem_number AS number, CASE WHEN CAST(problem_number AS INT) % 4 = 0 THEN '②' WHEN CAST(problem_number AS INT) % 4 = 2 THEN '' ELSE concat('-', problem_number, '.5') END AS answer FROM {p} WHERE book BETWEEN 1000 AND 4999 AND CAST(problem_number AS INT) % 3 <> 0"
ENTRIES = "SELECT DISTINCT book, problem_number AS number, CASE WHEN CAST(problem_number AS INT) % 6 <> 0 THEN concat('e', problem_number) END AS answer, concat('why ', problem_number) AS solution FROM {p} WHERE book BETWEEN 1000 AND 4999 AND CAST(problem_number AS INT) % 2 = 0"

FIX = rf"""ov AS ({OVERVIEW}),
  so AS (WITH RECURSIVE {SOLVED}, z AS (SELECT book, place, chapter, section, number, min(place) OVER (PARTITION BY book, chapter, section, number) AS first FROM g WHERE worked)
    SELECT s.*, (SELECT min(first) FROM z WHERE z.book = s.book AND z.chapter = s.chapter AND z.section = s.section AND z.number = s.number) AS first, replace(trim(list_extract(regexp_extract_all(solution, '(?m)[답뎝달뎔][^\S\n]+(.+)$', 1), -1)), ' ', '') AS stated FROM solved s),
  w AS (SELECT so.*, x.answer AS expected FROM so JOIN ov x USING (book, chapter, section, number) WHERE replace(x.answer, ' ', '') <> stated),
  t AS (SELECT w.book, w.chapter, w.section, w.number, arg_min(o.section, CASE o.section WHEN 'practice' THEN 1 WHEN 'level1' THEN 2 WHEN 'level2' THEN 3 WHEN 'level3' THEN 4 ELSE 5 END) AS target FROM w JOIN ov o ON o.book = w.book AND o.chapter = w.chapter AND o.number = w.number AND o.section <> w.section AND replace(o.answer, ' ', '') = w.stated
    WHERE NOT EXISTS (SELECT 1 FROM so k WHERE k.book = o.book AND k.chapter = o.chapter AND k.section = o.section AND k.number = o.number) GROUP BY ALL),
  fixed AS (SELECT so.book, so.chapter, coalesce(t.target, so.section) AS section, so.number, arg_max(so.solution, so.first) AS solution FROM so LEFT JOIN t USING (book, chapter, section, number) GROUP BY ALL)"""


@query("I13_misattribution_fix", f"WITH {FIX} SELECT book, chapter, section, number, sha256(solution) AS solution FROM fixed")
def misattribution(t: Tables):
    moved = A.in_section_of_answer(A.book_solutions(t.solution_pages, "book"), A.overview_answers(t.overview_lines, "book"), "book")
    return moved.select("book", "chapter", "section", "number", F.sha2("solution", 256).alias("solution"))


MATCHED = rf"""WITH p AS ({BOOK_PROBLEMS.format(part="part")}), q AS ({QUICK.format(p="p")}), e AS ({ENTRIES.format(p="p")}), {FIX},
  j AS (SELECT p.*, ov.answer AS shown, fixed.solution AS worked, q.answer AS quick, e.answer AS entry, e.solution AS why, e.number IS NOT NULL AS has_entry, p.book IN (SELECT book FROM ov) AS has_overview, p.book IN (SELECT book FROM ov) OR p.book BETWEEN 1000 AND 4999 AS has_answers
    FROM p LEFT JOIN ov ON ov.book = p.book AND ov.chapter = p.chapter[:2] AND ov.section = p.section AND ov.number = p.local_number LEFT JOIN fixed ON fixed.book = p.book AND fixed.chapter = p.chapter[:2] AND fixed.section = p.section AND fixed.number = p.local_number
    LEFT JOIN q ON q.book = p.book AND q.number = p.problem_number LEFT JOIN e ON e.book = p.book AND e.number = p.problem_number),
  r AS (SELECT *, coalesce(nullif(quick, ''), entry) AS a FROM j)
  SELECT problem_id, CASE WHEN inline_answer <> '' THEN inline_answer WHEN has_overview THEN shown WHEN coalesce(a, '') <> '' OR has_entry THEN a END AS answer, CASE WHEN inline_answer <> '' THEN inline_solution WHEN has_overview THEN worked ELSE why END AS solution,
    CASE WHEN inline_answer <> '' THEN 'inline' WHEN has_overview THEN CASE WHEN shown IS NOT NULL OR worked IS NOT NULL THEN 'matched' ELSE 'unmatched' END WHEN NOT has_answers THEN 'no_answer_key' WHEN coalesce(a, '') <> '' OR has_entry THEN 'matched' ELSE 'unmatched' END AS status,
    CAST(CASE WHEN inline_answer <> '' THEN 1 WHEN has_overview THEN CASE WHEN shown IS NOT NULL THEN CASE WHEN worked IS NOT NULL THEN 0.95 ELSE 0.9 END WHEN worked IS NOT NULL THEN 0.7 ELSE 0 END WHEN NOT has_answers THEN 0 WHEN coalesce(a, '') = '' THEN CASE WHEN has_entry THEN 0.3 ELSE 0 END
      WHEN problem_type = 'multiple_choice' AND a = '②' THEN 0.8 WHEN problem_type = 'short_answer' AND regexp_matches(a, '^-?\d+\.?\d*$') THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM r"""


@query("I14_book_match", MATCHED)
def book_match(t: Tables):
    problems = t.spark.sql(BOOK_PROBLEMS, part=t.part)
    quick, entries = t.spark.sql(QUICK, p=problems), t.spark.sql(ENTRIES, p=problems)
    overview = A.overview_answers(t.overview_lines, "book")
    solved = A.in_section_of_answer(A.book_solutions(t.solution_pages, "book"), overview, "book")
    answered = overview.select("book").union(problems.where("book between 1000 and 4999").select("book"))
    return A.match_book_answers(problems, "book", overview, solved, quick, entries, answered)
