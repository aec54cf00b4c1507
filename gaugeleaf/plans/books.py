"""Scanned books: sections, heads of exam questions, textbook problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import books as B
from ..operators import textbook as X
from ..operators.answers import stripped
from ..sources.domain import Tables
from .registry import query


def count_of(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


def has(pattern: str) -> str:
    return f"regexp_matches(text, '{pattern}')"


def extract(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(text, '{pattern}', {group})"


# The checking database knows no look-around: every character that is none of a word's stands twice, so that a match can take one on either side.
TWICE = r"concat('  ', regexp_replace(text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '  ')"
OUT, IN = r"[^\p{L}\p{N}_]", r"[\p{L}\p{N}_]"
PAIRS = rf"len(regexp_extract_all({TWICE}, '{OUT}\d{{1,3}}\s*(?:\(\([1-5]\)\){IN}|[①②③④⑤]{OUT}|\d{{1,4}}{OUT})'))"
REFERENCES = rf"len(regexp_extract_all({TWICE}, '(?i){OUT}p\.\.\s*\d{{1,4}}{OUT}'))"
STARTS = "(" + " OR ".join(has(p) for _, p in B.STARTS) + ")"
LINES = "SELECT book, page, line_number, trim(text) AS text FROM book_lines WHERE trim(text) <> ''"

SECTIONS = f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY line_number) AS row FROM ({LINES})),
  c AS (SELECT book, page, count(*) AS n, sum({REFERENCES}) AS refs, sum({PAIRS}) AS pairs, count(*) FILTER (WHERE {has(B.TABLE_HINT)}) AS hints, count(*) FILTER (WHERE length(text) <= 24) AS short,
    count(*) FILTER (WHERE length(text) >= 40) AS long, count(*) FILTER (WHERE {has(B.QUESTION_HINT)}) AS questions, count(*) FILTER (WHERE {has(B.CHOICE_LINE)}) AS choices, count(*) FILTER (WHERE {has(B.HEADER_LINE)}) AS headers,
    sum({count_of('□')}) AS boxes, bool_or(row <= 5 AND {has(B.ANSWER_HEAD)}) AS answer_head, bool_or(row <= 5 AND {has(B.OVERVIEW_HEAD)}) AS overview, bool_or(row <= 10 AND {has(B.QUICK_HEAD)}) AS quick,
    count(*) FILTER (WHERE {has(B.IMAGE_LINE)}) AS images, bool_or({STARTS}) AS starts FROM l GROUP BY book, page),
  p AS (SELECT *, (pairs >= 25 AND long <= 2) OR (hints >= 1 AND pairs >= 6) OR (refs >= 4 AND short >= 6 AND long <= 3) AS is_table, refs >= 6 OR (refs >= 3 AND short >= 8) OR boxes >= 4 OR (images >= 2 AND refs >= 2) AS is_contents,
    questions >= 1 OR (choices >= 4 AND headers >= 1) OR headers >= 2 OR (headers >= 1 AND n >= 2) AS is_problems, row_number() OVER (PARTITION BY book ORDER BY page) > floor(0.7 * count(*) OVER (PARTITION BY book)) AS late,
    max(page) OVER (PARTITION BY book) AS last FROM c),
  s AS (SELECT book, coalesce(min(page) FILTER (WHERE starts AND is_problems AND NOT is_table AND NOT is_contents), min(page)) AS content_start, min(page) FILTER (WHERE late AND last - page + 1 >= 5 AND (is_table OR answer_head)) AS answer_start,
    max(last) AS last_page, coalesce(min(page) FILTER (WHERE overview), min(page) FILTER (WHERE late AND is_table)) AS quick_page FROM p GROUP BY book)
  SELECT *, answer_start IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE p.book = s.book AND ((p.page = s.answer_start AND p.is_table) OR (p.quick AND p.page BETWEEN s.answer_start AND s.answer_start + 3))) AS has_quick FROM s"""


@query("I8_section_detection", SECTIONS)
def i8(t: Tables):
    return B.sections(t.book_lines, "book")


# A line of a textbook, and the fold over them step by step: the open problem's number, display, choices and place on the page.
S = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


def exam_sql(text: str, name: str) -> str:
    """name_ok, name_raw, name_year, ... of the exam head in a column, as select items that follow one another."""
    (first, a), (second, b) = X.EXAM_ITEMS
    of = lambda f: f"CASE WHEN regexp_matches({name}_tail, '{first}') THEN " + (f"regexp_extract({name}_tail, '{first}', {a[f]})" if f in a else "''") + f" WHEN regexp_matches({name}_tail, '{second}') THEN " + (f"regexp_extract({name}_tail, '{second}', {b[f]})" if f in b else "''") + " ELSE '' END"
    part = lambda n: f"regexp_extract({text}, '{X.EXAM_HEAD}', {n})"
    tidy = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    n = name
    sources = " ".join(f"WHEN regexp_matches({n}_raw, '{p}') THEN '{v}'" for p, v in X.EXAM_SOURCES)
    return f"""{part(4)} AS {n}_tail, regexp_matches({text}, '{X.EXAM_HEAD}') AND (regexp_matches({n}_tail, '{first}') OR regexp_matches({n}_tail, '{second}')) AS {n}_ok,
      {tidy(of('body'))} AS {n}_body, {of('item')} AS {n}_item, trim({of('audience')}) AS {n}_aud, trim({of('form')}) AS {n}_form, trim({of('rest')}) AS {n}_rest,
      array_to_string(list_filter([{tidy(part(2))}, concat({part(3)}, CASE WHEN contains({text}, '학년도') THEN '학년도' ELSE '년' END), {n}_body, concat({n}_item, CASE WHEN regexp_matches({n}_tail, '번|문항') THEN '번' ELSE '' END),
        CASE WHEN {n}_aud <> '' THEN concat('(', {n}_aud, ')') ELSE '' END, CASE WHEN contains({n}_body, {n}_form) THEN '' ELSE {n}_form END], lambda p: p <> ''), ' ') AS {n}_raw, CASE {sources} END AS {n}_type"""


HEADS = f"""WITH l AS (SELECT line_number, {S} AS t FROM exam_heads), h AS (SELECT *, {exam_sql('t', 'h')} FROM l)
  SELECT line_number, h_raw AS raw, TRY_CAST(regexp_extract(t, '{X.EXAM_HEAD}', 3) AS INTEGER) AS year, h_type AS type, nullif(h_body, '') AS label, TRY_CAST(h_item AS INTEGER) AS item, nullif(h_aud, '') AS audience,
    coalesce(nullif(h_form, ''), nullif(regexp_extract(h_body, '{X.FORM}', 1), '')) AS form, h_rest AS rest FROM h WHERE h_ok"""


@query("I7_exam_header_parse", HEADS)
def i7(t: Tables):
    return t.exam_heads.select("line_number", X.exam_source(stripped()).alias("h")).where("h is not null").select("line_number", "h.*")


def start_sql() -> str:
    number = lambda p, n=1: f"TRY_CAST(regexp_extract(t, '{p}', {n}) AS INTEGER)"
    fits = lambda p: f"{number(p)} BETWEEN 1 AND {X.MOST_NUMBER}"
    head = "regexp_extract(t, '^(\\d{1,4})', 1)"
    rows = [
        ("h_ok", f"TRY_CAST({head} AS INTEGER)", head),
        (f"regexp_matches(t, '{X.LABELLED}')", number(X.LABELLED, 2), f"concat(regexp_extract(t, '{X.LABELLED}', 1), ' ', regexp_extract(t, '{X.LABELLED}', 2))"),
        (fits(X.DIGITS), number(X.DIGITS), f"regexp_extract(t, '{X.DIGITS}', 1)"),
        (fits(X.POINTED), number(X.POINTED), f"concat({number(X.POINTED)}, '.')"),
        (f"regexp_matches(t, '{X.RINGED}')", f"instr('{X.MANY_CIRCLED}', t[1])", "t[1]"),
        (fits(X.BRACKETED), number(X.BRACKETED), f"concat('[', {number(X.BRACKETED)}, ']')"),
    ]
    category = " ".join(f"WHEN '{word}' THEN '{name}'" for word, name in X.LABELS.items())
    return (
        "CASE " + " ".join(f"WHEN {w} THEN CAST({n} AS INTEGER)" for w, n, _ in rows) + " END AS n0, CASE " + " ".join(f"WHEN {w} THEN {d}" for w, _, d in rows) + f" END AS d0, "
        f"CASE WHEN NOT h_ok THEN CASE regexp_extract(t, '{X.LABELLED}', 1) {category} END END AS c0"
    )


PROBLEMS = f"""WITH RECURSIVE raw AS (SELECT *, {S} AS t FROM textbook_lines WHERE {S} <> ''),
  a AS (SELECT *, {exam_sql('t', 'h')} FROM raw),
  b AS (SELECT *, {start_sql()}, regexp_matches(t, '{X.CONCEPT}') AS concept, regexp_matches(t, '{X.SECTION}') AS is_section, regexp_matches(t, '{X.CHAPTER}') AS is_chapter FROM a),
  c AS (SELECT *, CASE WHEN concept THEN 'concept' WHEN is_section THEN 'section' WHEN is_chapter THEN 'chapter' WHEN n0 IS NOT NULL THEN 'start' ELSE 'body' END AS event, regexp_matches(t, '{X.CHOICE}') AS choice,
      row_number() OVER (PARTITION BY book ORDER BY page, line_number) AS rn FROM b
    WHERE NOT (line_type IN ('page_info', 'page_header', 'page_footer') AND n0 IS NULL AND NOT is_section AND NOT is_chapter) AND NOT regexp_matches(t, '^\\d{{1,3}}$')),
  f AS (
    SELECT book, CAST(0 AS BIGINT) AS rn, NULL::INTEGER AS n, NULL::VARCHAR AS d, NULL::VARCHAR AS c, 0 AS full_, NULL::DOUBLE AS x, NULL::DOUBLE AS y, NULL::VARCHAR AS ch, NULL::VARCHAR AS se, false AS skip, 0 AS place, false AS mine, false AS inferred FROM c GROUP BY book
    UNION ALL
    SELECT book, rn, n2, d2, c2, full2, x2, y2, ch2, se2, skip2, place2, mine2, by_place FROM (
      SELECT l.book, l.rn, l.event = 'body' AND NOT s.skip AND s.n IS NOT NULL AND s.full_ >= 4 AND NOT l.choice AND (regexp_matches(l.t, '{X.QUESTION}') OR regexp_matches(l.t, '{X.POINTS}'))
          AND coalesce(l.bbox_y + 250 < s.y OR l.bbox_y - s.y > 220 OR ((s.x < 1000) <> (l.bbox_x < 1000)), s.y IS NULL OR l.bbox_y IS NULL OR l.bbox_y + 250 < s.y OR l.bbox_y - s.y > 220) AS by_place,
        l.event = 'start' OR by_place AS opens, CASE WHEN l.event = 'start' THEN l.n0 WHEN by_place THEN s.n + 1 ELSE s.n END AS n2,
        CASE WHEN l.event = 'start' THEN l.d0 WHEN by_place THEN CASE WHEN regexp_matches(s.d, '^[0-9]+$') THEN lpad(CAST(s.n + 1 AS VARCHAR), CAST(greatest(length(s.d), length(CAST(s.n + 1 AS VARCHAR))) AS INTEGER), '0') WHEN suffix(s.d, '.') THEN concat(s.n + 1, '.')
          WHEN prefix(s.d, '[') THEN concat('[', s.n + 1, ']') ELSE CAST(s.n + 1 AS VARCHAR) END ELSE s.d END AS d2, CASE WHEN l.event = 'start' THEN l.c0 ELSE s.c END AS c2,
        CASE l.event WHEN 'concept' THEN true WHEN 'chapter' THEN false WHEN 'start' THEN false ELSE s.skip END AS skip2, CASE WHEN l.event = 'chapter' THEN l.t ELSE s.ch END AS ch2, CASE WHEN l.event = 'section' THEN l.t ELSE s.se END AS se2,
        s.place + CAST(opens AS INTEGER) AS place2, (opens OR (l.event = 'body' AND NOT s.skip)) AND place2 > 0 AS mine2,
        CASE WHEN opens THEN 0 ELSE s.full_ END + CAST(mine2 AND l.choice AS INTEGER) AS full2, CASE WHEN opens THEN l.bbox_x WHEN mine2 THEN coalesce(s.x, l.bbox_x) ELSE s.x END AS x2, CASE WHEN opens THEN l.bbox_y WHEN mine2 THEN coalesce(l.bbox_y, s.y) ELSE s.y END AS y2
      FROM f s JOIN c l ON l.book = s.book AND l.rn = s.rn + 1) q),
  o AS (SELECT f.*, c.page, c.line_number, c.t, c.text, c.h_ok, c.h_raw, c.h_rest, row_number() OVER (PARTITION BY f.book, place ORDER BY f.rn) = 1 AS first FROM f JOIN c USING (book, rn) WHERE mine),
  u AS (SELECT *, CASE WHEN NOT first THEN nullif(concat(regexp_extract(t, '{X.SUB_PROBLEM}', 1), regexp_extract(t, '{X.SUB_PROBLEM}', 2)), '') END AS sub FROM o),
  v AS (SELECT *, count(sub) OVER (PARTITION BY book, place ORDER BY rn) AS nth FROM u),
  subs AS (SELECT book, place, nth, max(sub) AS sub, string_agg(text, chr(10) ORDER BY rn) AS text FROM v WHERE nth > 0 GROUP BY ALL),
  ends AS (SELECT book, max(page) AS last_page FROM textbook_lines GROUP BY book),
  tail AS (SELECT book, arg_max(ch, rn) AS ch, arg_max(se, rn) AS se FROM f GROUP BY book),
  g AS (SELECT book, place, max(n) AS number, max(d) AS display, max(c) AS category, bool_or(inferred) AS inferred, min(page) AS start_page, count(*) AS n_lines, arg_min(ch, rn) AS ch, arg_min(se, rn) AS se, arg_min(CASE WHEN h_ok THEN h_raw ELSE '' END, rn) AS source,
      sha256(coalesce(string_agg(text, chr(10) ORDER BY rn) FILTER (WHERE NOT first), '')) AS body FROM v GROUP BY book, place)
  SELECT book, CAST(place AS INTEGER) AS place, number, display, category, inferred, coalesce(lead(g.ch) OVER w, CASE WHEN lead(place) OVER w IS NULL THEN tail.ch END) AS chapter, coalesce(lead(g.se) OVER w, CASE WHEN lead(place) OVER w IS NULL THEN tail.se END) AS section,
    start_page, coalesce(lead(start_page) OVER w, last_page) AS end_page, n_lines, nullif(source, '') AS source, (SELECT string_agg(concat(sub, ':', sha256(s.text)), ',' ORDER BY nth) FROM subs s WHERE s.book = g.book AND s.place = g.place) AS subs, body
  FROM g JOIN ends USING (book) JOIN tail USING (book) WINDOW w AS (PARTITION BY book ORDER BY place)"""


@query("I5_textbook_segmentation", PROBLEMS)
def i5(t: Tables):
    body = F.array_join(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1))), "\n")
    subs = F.nullif(F.array_join(F.transform("subs", lambda s: F.concat(s["number"], F.lit(":"), F.sha2(s["text"], 256))), ","), F.lit(""))
    return X.textbook_problems(t.textbook_lines, "book").select(
        "book", "place", "number", "display", "category", "inferred", "chapter", "section", "start_page", "end_page", F.size("lines").cast("long").alias("n_lines"), F.col("source.raw").alias("source"), subs.alias("subs"), F.sha2(body, 256).alias("body")
    )


@query("I5_textbook_stems", f"""WITH p AS (SELECT *, 1 + problem_id % 6 AS kind FROM problems)
  SELECT problem_id, CASE WHEN kind = 6 THEN concat(stem, chr(10), 'ㄱ ① a') ELSE stem END AS stem, CASE kind WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 0 END AS n_choices, CASE kind WHEN 1 THEN 'five' WHEN 2 THEN 'four' WHEN 3 THEN CAST(time_sec AS VARCHAR) END AS last_choice,
    CASE WHEN kind <= 3 THEN 'multiple_choice' WHEN kind = 4 THEN 'written_solution' ELSE 'short_answer' END AS problem_type FROM (SELECT problem_id, kind, time_sec, CASE kind WHEN 4 THEN concat(stem, chr(10), '풀이 과정을 쓰시오') WHEN 5 THEN concat(stem, chr(10), '옳은 ① one ② two') ELSE stem END AS stem FROM p)""")
def i5_stems(t: Tables):
    kind = 1 + F.col("problem_id") % 6
    after = {
        1: F.lit("\n（1） one（2점） （2） two\n( 3 ) three 4) four 5. five"), 2: F.lit(" ① one ② two ③ three ④ four"), 3: F.concat(F.lit("\n\\circled{1} a \\circled{2} b \\textcircled{ 3 } c (4) d (5) "), F.col("time_sec").cast("string")),
        4: F.lit("\n풀이 과정을 쓰시오"), 5: F.lit("\n옳은 ① one ② two"),
    }
    tail = F.lit("\nㄱ ① a")
    for k, text in after.items():
        tail = F.when(kind == k, text).otherwise(tail)
    first = F.when(F.col("problem_id") % 2 == 0, "12. ").otherwise("[7] ")
    lines = t.problems.select("problem_id", F.posexplode(F.split(F.concat(first, "stem", tail), "\n")).alias("line_number", "text")).select("problem_id", F.lit(1).alias("page"), "line_number", F.lit("text").alias("line_type"), "text")
    return X.textbook_problems(lines, "problem_id").select("problem_id", "stem", F.size("choices").alias("n_choices"), F.try_element_at("choices", F.lit(-1)).alias("last_choice"), "problem_type")
