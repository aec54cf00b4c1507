"""Learning tables presented from the parquet star schema.

Each table is one SELECT that Spark and the checking database both run, so the
mapping is written once.  ``{name}`` stands for a base table or another entry.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Four lines of choices of a textbook problem, in brackets or as marks.
CHOICE_LINES = "\n        ".join(
    f"UNION ALL SELECT book, page, 20 * k + {6 + c}, 'text', concat(CASE WHEN z % 2 = 0 THEN '({c + 1}) ' ELSE '{mark}' END, a), x, CASE WHEN z % 8 = 3 THEN NULL ELSE y + {40 + 10 * c} END FROM n WHERE z % 3 = 0"
    for c, mark in enumerate("①②③④")
)

DOMAIN = {
    "students": "SELECT c_custkey AS student_id, c_name AS name, c_nationkey AS class_id, c_mktsegment AS segment, CAST(floor(c_acctbal / 10) AS BIGINT) AS xp FROM {customer}",
    "classes": "SELECT n_nationkey AS class_id, n_name AS title, n_regionkey AS organization_id FROM {nation}",
    "submissions": """SELECT o_orderkey AS submission_id, o_custkey AS student_id, c_nationkey AS class_id, concat(CAST(c_nationkey AS STRING), '-', o_orderpriority) AS assignment_id,
        CASE o_orderstatus WHEN 'F' THEN 'graded' WHEN 'P' THEN 'returned' ELSE 'submitted' END AS status,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) END AS score, CAST(100 AS DOUBLE) AS max_score, o_orderdate AS submitted_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "assignments": "SELECT assignment_id, class_id, CAST(count(*) AS BIGINT) AS n_submitted, min(submitted_at) AS created_at, max(submitted_at) AS due_at FROM {submissions} GROUP BY assignment_id, class_id",
    "answers": """SELECT l_orderkey AS submission_id, l_partkey AS problem_id, l_linenumber AS order_index, CAST(l_linenumber AS STRING) AS student_answer,
        CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct, l_shipdate AS answered_at, l_suppkey AS grader_id, l_quantity AS seconds FROM {lineitem}""",
    "numbered_answers": """SELECT l_orderkey AS submission_id, l_partkey AS problem_id, CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct, l_shipdate AS answered_at, l_quantity AS seconds,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS INT) AS answer_no FROM {lineitem}""",
    "problems": """SELECT p_partkey AS problem_id, p_brand AS subject, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS unit, 1 + p_size % 6 AS difficulty, p_size * 10 AS time_sec, p_name AS stem,
        CASE p_size % 3 WHEN 0 THEN 'multiple_choice' WHEN 1 THEN 'short_answer' ELSE 'essay' END AS problem_type,
        CASE p_size % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN 'auto_approved' ELSE 'approved' END AS review_status,
        CAST(p_partkey % 25 AS INT) AS node_id, p_retailprice AS weight, concat('{{"year": ', CAST(2015 + p_size % 10 AS STRING), ', "title": "', p_name, '"}}') AS source_json FROM {part}""",
    "learning_events": """SELECT event_id, user_id AS student_id, ts AS client_ts, value, props,
        CASE event_type WHEN 'view' THEN 'session_started' WHEN 'click' THEN 'answer_submitted' WHEN 'purchase' THEN 'answer_submitted' WHEN 'signup' THEN 'session_ended' ELSE event_type END AS event_type,
        CASE event_type WHEN 'click' THEN concat('{{"isCorrect": ', CASE WHEN value < 10 THEN 'true' WHEN value < 30 THEN 'false' ELSE '"true"' END, '}}') WHEN 'purchase' THEN '{{}}'
        WHEN 'signup' THEN concat('{{"durationMs": ', CAST(CAST(floor(value * 100) AS BIGINT) - 500 AS STRING), '}}') ELSE '{{}}' END AS payload,
        concat(CAST(user_id AS STRING), '-', CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING)) AS session_id FROM {events}""",
    "nodes": """SELECT concat('r', CAST(r_regionkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id, 1 AS level, r_name AS label FROM {region}
        UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), 2, n_name FROM {nation}
        UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), 3, c_name FROM {customer}""",
    "tutor_messages": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'student' ELSE role END AS role, text FROM {conversations}",
    # books of two hundred problems on some thirty pages: contents, chapters, concepts, problems of every kind of start, answers in some
    "book_lines": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 6) AS BIGINT) + 1 AS page, CAST(p_size AS INT) AS z, p_name AS stem FROM {part}),
        b AS (SELECT *, k >= 150 AND book % 3 <> 0 AS answers FROM k)
        SELECT book, page, 10 * k AS line_number, concat(stem, CASE WHEN book % 4 = 0 AND k > 1 THEN ' ..... 3' ELSE ' ..... P. ' END, CAST(z AS STRING)) AS text FROM b WHERE k < 6
        UNION ALL SELECT book, page, 10 * k + 9, concat('![](https://cdn.mathpix.com/cropped/', CAST(z AS STRING), ')') FROM b WHERE k < 3 AND book % 2 = 0
        UNION ALL SELECT book, page, 10 * k + 1, concat('0', CAST(1 + z % 9 AS STRING), ' ', stem) FROM b WHERE z % 17 = 0 AND NOT answers
        UNION ALL SELECT book, page, 10 * k + 2, concat(CASE WHEN z % 2 = 0 THEN 'Concept ' ELSE '개념 ' END, stem) FROM b WHERE z % 13 = 0 AND NOT answers
        UNION ALL SELECT book, page, 10 * k + 3, concat('about ', stem) FROM b WHERE z % 13 = 0 AND NOT answers
        UNION ALL SELECT book, page, 10 * k + 4, CASE z % 8 WHEN 0 THEN concat('예제 ', CAST(z AS STRING), ' ', stem) WHEN 1 THEN concat('0', lpad(CAST(z AS STRING), 3, '0'), ' ', stem) WHEN 2 THEN concat(CAST(z AS STRING), '. ', stem)
            WHEN 3 THEN concat('③ ', stem) WHEN 4 THEN concat('[', CAST(z AS STRING), '] ', stem)
            WHEN 5 THEN concat(CAST(z AS STRING), ' 20', CAST(10 + z % 13 AS STRING), '학년도 ', CAST(1 + z % 12 AS STRING), '월 ', CASE z % 5 WHEN 0 THEN '모평' WHEN 1 THEN '학평' WHEN 2 THEN '수능' WHEN 3 THEN '경찰' ELSE '사관' END, CASE z % 3 WHEN 0 THEN ' (고3)' ELSE '' END, CASE z % 4 WHEN 1 THEN ' 가형' ELSE '' END)
            WHEN 6 THEN concat(CAST(z AS STRING), '.5 ', stem) ELSE concat('  문제 ', CAST(z AS STRING)) END FROM b WHERE NOT answers AND k >= 3
        UNION ALL SELECT book, page, 10 * k + 5, concat(stem, CASE WHEN z % 3 = 0 THEN '의 값은? ' ELSE ' 구하시오 ' END) FROM b WHERE NOT answers AND z % 7 < 5
        UNION ALL SELECT book, page, 10 * k + 6, CASE WHEN z % 2 = 0 THEN '① 1 ② 2 ③ 3 ④ 4 ⑤ 5' ELSE '① a ② b' END FROM b WHERE NOT answers AND z % 3 = 0
        UNION ALL SELECT book, page, 10 * k + 7, concat('(1) ', stem) FROM b WHERE NOT answers AND z % 5 = 0
        UNION ALL SELECT book, page, 10 * k + 8, concat('(2) more of ', stem) FROM b WHERE NOT answers AND z % 5 = 0
        UNION ALL SELECT book, page, 10 * k, CASE WHEN book % 2 = 0 THEN '정답 및 해설' ELSE '빠른 정답' END FROM b WHERE answers AND k % 6 = 0 AND book % 3 = 1
        UNION ALL SELECT book, page, 10 * k + 1, concat('1 ① 2③ 3 ', CAST(z AS STRING), ' 4 ④ 5⑤ 3125 7 (5) 8(2)') FROM b WHERE answers AND book % 3 = 2
        UNION ALL SELECT book, page, 10 * k + 2, concat('풀이 ', stem, ' 답 ', CAST(z AS STRING)) FROM b WHERE answers AND book % 3 = 1
        UNION ALL SELECT book, page, 10 * k + 3, '한눈에 보는 정답' FROM b WHERE answers AND k = 174 AND book % 3 = 2""",
    # answer pages of books: chapter and section heads, answers in cells, alone and run together, and solutions
    "answer_lines": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 20) AS BIGINT) + 1 AS page_number, CAST(p_size AS INT) AS z, p_name AS stem FROM {part})
        SELECT book, page_number, 10 * k AS line_number, concat('0', CAST(1 + z % 9 AS STRING), ' ', stem) AS text FROM k WHERE k % 50 = 0
        UNION ALL SELECT book, page_number, 10 * k + 1, CASE z % 5 WHEN 0 THEN '유제' WHEN 1 THEN '예제' WHEN 2 THEN 'Level 1 기초 연습' WHEN 3 THEN 'Level 2' ELSE 'Level 3' END FROM k WHERE k % 25 = 3
        UNION ALL SELECT book, page_number, 10 * k + 2, CASE z % 4 WHEN 0 THEN concat(CAST(1 + k % 25 AS STRING), ' ③ ', CAST(2 + k % 25 AS STRING), ' ', CAST(z AS STRING)) WHEN 1 THEN concat(CAST(1 + k % 25 AS STRING), '①', CAST(2 + k % 25 AS STRING), '⑤')
            WHEN 2 THEN concat(CAST(1 + k % 25 AS STRING), ' -', CAST(z AS STRING), '.5') ELSE concat('풀이 ', stem) END FROM k""",
    # pages that show the answers of a book at a glance: chapters, sections by label, by a level's word and in tables, answers in every form
    "overview_lines": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 20) AS BIGINT) + 1 AS page_number, CAST(p_size AS INT) AS z, p_name AS stem FROM {part}),
        n AS (SELECT *, CAST(1 + k % 12 AS STRING) AS n, CAST(z AS STRING) AS a, k % 20 = 1 AS opens FROM k)
        SELECT book, page_number, 10 * k AS line_number, 'text' AS line_type, concat('0', CAST(1 + z % 9 AS STRING), ' ', stem) AS text FROM n WHERE k % 40 = 0
        UNION ALL SELECT book, page_number, 10 * k + 1, CASE z % 6 WHEN 4 THEN 'table' ELSE 'text' END, CASE z % 6 WHEN 0 THEN '유제' WHEN 1 THEN 'Level' WHEN 2 THEN 'Level 1 기초 연습 11 ④' WHEN 3 THEN ' Level 3 '
            WHEN 4 THEN concat(chr(92), 'begin{{tabular}}{{|l|l|}} ', chr(92), 'hline ', CASE WHEN z % 4 = 0 THEN 'Level 2 ' ELSE concat('Level ', chr(92), 'mathbf{{3}} 실력 완성') END, ' & 4 (2) & 12 (', a, ') ', chr(92), chr(92), ' ', chr(92), 'hline ', chr(92), 'end{{tabular}}') ELSE 'Level' END FROM n WHERE opens
        UNION ALL SELECT book, page_number, 10 * k + 2, 'text', CASE WHEN z % 6 = 5 THEN 'Level' WHEN z % 3 = 0 THEN '2 기본 연습' WHEN z % 3 = 1 THEN '기초' ELSE '7 ②' END FROM n WHERE opens AND z % 6 IN (1, 5)
        UNION ALL SELECT book, page_number, 10 * k + 3, 'text', '3 실력 완성' FROM n WHERE opens AND z % 12 = 5
        UNION ALL SELECT book, page_number, 10 * k + 4, CASE z % 10 WHEN 6 THEN 'table' ELSE 'simple_cell' END, CASE z % 10 WHEN 0 THEN concat(n, ' ① ', CAST(2 + k % 12 AS STRING), ' ', a) WHEN 1 THEN concat(n, ' (5) 12(3) 4 ①') WHEN 2 THEN concat(CAST(1 + k % 9 AS STRING), a)
            WHEN 3 THEN 'www.example.org 1 ①' WHEN 4 THEN '본문 3 4' WHEN 5 THEN concat(chr(92), 'hline 1 ②') WHEN 6 THEN concat(chr(92), 'begin{{tabular}}{{|c|}}$', n, '$ & ', chr(92), 'multicolumn{{2}}{{|c|}}{{③}}', chr(92), 'end{{tabular}}')
            WHEN 7 THEN concat('풀이 ', stem) WHEN 8 THEN concat('  ', n, '  ', a, '  ') ELSE '5' END FROM n WHERE NOT opens""",
    # solutions of books: heads as text, as a level's word and garbled in tables, summaries, numbers in every form, answers, page furniture
    "solution_pages": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 20) AS BIGINT) + 1 AS page_number, CAST(p_size AS INT) AS z, p_name AS stem FROM {part}),
        n AS (SELECT *, CAST(1 + k % 12 AS STRING) AS n, CAST(z AS STRING) AS a, k % 20 = 1 AS opens FROM k)
        SELECT book, page_number, 10 * k AS line_number, 'text' AS line_type, concat('0', CAST(1 + z % 9 AS STRING), ' ', stem) AS text FROM n WHERE k % 40 = 0
        UNION ALL SELECT book, page_number, 10 * k + 1, CASE WHEN z % 6 IN (3, 5) THEN 'table' ELSE 'text' END, CASE z % 6 WHEN 0 THEN '유제' WHEN 1 THEN 'Level' WHEN 2 THEN ' Level 2 기본 연습' WHEN 3 THEN concat(chr(92), 'begin{{tabular}}{{|c|}} ', chr(92), 'hline ㄱovel & 3 실력 완성 ', chr(92), 'end{{tabular}}')
            WHEN 4 THEN '대표 기출 문제' ELSE concat(chr(92), 'begin{{tabular}}{{|c|}} Level ', chr(92), 'mathbf{{1}} ', chr(92), 'end{{tabular}}') END FROM n WHERE opens
        UNION ALL SELECT book, page_number, 10 * k + 2, 'text', CASE z % 3 WHEN 0 THEN '1 기초 연습' WHEN 1 THEN '기본 연습' ELSE '7 content of it' END FROM n WHERE opens AND z % 6 = 1
        UNION ALL SELECT book, page_number, 10 * k + 3, 'text', '1 (4) 2 ③' FROM n WHERE opens AND z % 5 <> 0
        UNION ALL SELECT book, page_number, 10 * k + 4, 'text', CASE z % 4 WHEN 0 THEN '본문 4~7쪽' WHEN 1 THEN '(1) ①' WHEN 2 THEN '3125' ELSE '3 (2)' END FROM n WHERE opens AND z % 5 <> 0
        UNION ALL SELECT book, page_number, 10 * k + 5, 'text', CASE WHEN z % 2 = 0 THEN '1' ELSE '2 1' END FROM n WHERE opens AND z % 7 < 4
        UNION ALL SELECT book, page_number, 10 * k + 6, CASE z % 13 WHEN 5 THEN 'page_info' WHEN 6 THEN 'page_info' WHEN 9 THEN 'page_footer' ELSE 'text' END, CASE z % 13 WHEN 0 THEN concat('$', n, ' ', stem) WHEN 1 THEN n WHEN 2 THEN concat(n, ' ab') WHEN 3 THEN concat(n, '(', stem) WHEN 4 THEN '답 (3)' WHEN 5 THEN concat('뎝 ', a, ' ', a)
            WHEN 6 THEN stem WHEN 7 THEN concat(CAST(1 + (k + 11) % 12 AS STRING), ' ', stem) WHEN 8 THEN concat(stem, ' 답 1') WHEN 9 THEN '답 9' WHEN 10 THEN concat('45 ', stem) WHEN 11 THEN concat('$', n) ELSE concat(n, '  ', stem, ' ') END FROM n WHERE NOT opens
        UNION ALL SELECT book, page_number, 10 * k + 7, 'text', CASE WHEN z % 4 = 0 THEN 'so' ELSE concat('so ', stem) END FROM n WHERE NOT opens AND z % 2 = 0
        UNION ALL SELECT book, page_number, 10 * k + 8, 'text', concat('달 ', a) FROM n WHERE NOT opens AND z % 3 = 0""",
    # textbook pages with places: every start, head and layout, questions without a number behind full choices, sub-problems, furniture
    "textbook_lines": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 6) AS BIGINT) + 1 AS page, CAST(p_size AS INT) AS z, p_name AS stem FROM {part}),
        n AS (SELECT *, CAST(z AS STRING) AS a, CASE WHEN z % 9 = 0 THEN NULL ELSE CAST(100 + 1000 * (z % 2) AS DOUBLE) END AS x, CAST(300 * (k % 6) + 100 AS DOUBLE) AS y FROM k)
        SELECT book, page, 20 * k AS line_number, 'text' AS line_type, CASE z % 4 WHEN 0 THEN concat('제 ', a, ' 장 ', stem) WHEN 1 THEN concat('Section ', a) WHEN 2 THEN concat('[유형 ', a, '] ', stem) ELSE concat(a, '단원 ', stem) END AS text, x AS bbox_x, y AS bbox_y FROM n WHERE z % 11 = 0
        UNION ALL SELECT book, page, 20 * k + 1, 'text', concat(CASE z % 3 WHEN 0 THEN '[개념] ' WHEN 1 THEN 'note ' ELSE '공식 정리 ' END, stem), x, y FROM n WHERE z % 13 = 0
        UNION ALL SELECT book, page, 20 * k + 2, 'text', concat('about ', stem), x, y FROM n WHERE z % 13 = 0
        UNION ALL SELECT book, page, 20 * k + 3, 'page_header', concat('head ', stem), x, y FROM n WHERE k % 6 = 0
        UNION ALL SELECT book, page, 20 * k + 4, CASE WHEN z % 10 = 5 THEN 'page_info' ELSE 'text' END, CASE z % 10 WHEN 0 THEN concat('예제 ', a, ' ', stem) WHEN 1 THEN concat('0', lpad(a, 3, '0'), ' ', stem) WHEN 2 THEN concat(a, '. ', stem) WHEN 3 THEN concat('⑬ ', stem) WHEN 4 THEN concat('[', a, '] ', stem)
            WHEN 5 THEN concat(lpad(a, 3, '0'), '★★☆ 20', CAST(10 + z % 13 AS STRING), '학년도 경찰대 ', CAST(1 + z % 30 AS STRING), '번', CASE WHEN z % 3 = 0 THEN concat('(고3) ', stem) ELSE '' END) WHEN 6 THEN concat(a, '.5 ', stem) WHEN 7 THEN concat('  문제 ', a) WHEN 8 THEN concat('Q', a, ' ', stem) ELSE a END, x, y FROM n WHERE z % 7 <> 6
        UNION ALL SELECT book, page, 20 * k + 5, 'text', concat(stem, CASE z % 3 WHEN 0 THEN '의 값은? ' WHEN 1 THEN ' (3점)' ELSE ' 서술하' END), x, y + 20 FROM n WHERE z % 4 < 3
        """ + CHOICE_LINES + """
        UNION ALL SELECT book, page, 20 * k + 11, 'text', concat('then ', stem, CASE WHEN z % 5 < 3 THEN ' 구하시오' ELSE '' END), CASE WHEN z % 5 = 0 THEN 1900 - x ELSE x END, CASE z % 5 WHEN 1 THEN y - 400 WHEN 2 THEN y + 400 ELSE y + 60 END FROM n WHERE z % 3 = 0
        UNION ALL SELECT book, page, 20 * k + 12, 'text', concat('(1) ', stem), x, y FROM n WHERE z % 5 = 1
        UNION ALL SELECT book, page, 20 * k + 13, 'text', concat('more of ', a), x, y FROM n WHERE z % 5 = 1
        UNION ALL SELECT book, page, 20 * k + 14, 'text', concat('2) ', stem), x, y FROM n WHERE z % 10 = 1""",
    # workbook pages: chapters, sections, items by code and by example number, numbers given or not, hints, solutions and answers in them, and the answer pages at the end
    "workbook_lines": """WITH k AS (SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS book, CAST(p_partkey % 200 AS BIGINT) AS k, CAST(floor((p_partkey % 200) / 8) AS BIGINT) + 1 AS page_number, CAST(p_size AS INT) AS z, p_name AS stem FROM {part}),
        n AS (SELECT *, CAST(z AS STRING) AS a FROM k)
        SELECT book, page_number, 20 * k AS line_number, concat('0', CAST(1 + z % 9 AS STRING), ' ', stem) AS text FROM n WHERE k % 31 = 0
        UNION ALL SELECT book, page_number, 20 * k + 1, CASE z % 6 WHEN 0 THEN '유제' WHEN 1 THEN ' Level 1 기초 연습' WHEN 2 THEN 'Level 2' WHEN 3 THEN 'Level 3 실력 완성' WHEN 4 THEN '대표기출문제' ELSE concat('예제 ', a, ' ', stem) END FROM n WHERE k % 9 = 1
        UNION ALL SELECT book, page_number, 20 * k + 2, CASE z % 5 WHEN 0 THEN concat('예제 ', a, ' with ', stem) WHEN 1 THEN concat('[', lpad(CAST(k AS STRING), 5, '0'), '-0001] ') WHEN 2 THEN concat('[26008-', lpad(a, 4, '0'), '] of ', stem) WHEN 3 THEN concat('[', a, '-1] is no code') ELSE concat('예제', a) END FROM n WHERE z % 7 <> 3
        UNION ALL SELECT book, page_number, 20 * k + 3, a FROM n WHERE z % 3 = 0
        UNION ALL SELECT book, page_number, 20 * k + 4, concat(stem, ' ') FROM n WHERE z % 8 <> 5
        UNION ALL SELECT book, page_number, 20 * k + 5, concat('  more of ', a) FROM n WHERE z % 4 = 2
        UNION ALL SELECT book, page_number, 20 * k + 6, CASE WHEN z % 2 = 0 THEN '잠깐' ELSE '잠깐이 hint' END FROM n WHERE z % 6 = 4
        UNION ALL SELECT book, page_number, 20 * k + 7, concat('hint ', stem) FROM n WHERE z % 6 = 4
        UNION ALL SELECT book, page_number, 20 * k + 8, CASE WHEN z % 10 = 0 THEN '풀이 in line' ELSE '풀이' END FROM n WHERE z % 5 < 2
        UNION ALL SELECT book, page_number, 20 * k + 9, concat('so ', stem) FROM n WHERE z % 5 < 2
        UNION ALL SELECT book, page_number, 20 * k + 10, CASE WHEN z % 9 = 0 THEN '답' ELSE concat('답 ', a) END FROM n WHERE z % 4 < 2
        UNION ALL SELECT book, page_number, 20 * k + 11, CASE WHEN book % 2 = 0 THEN '한눈에 보는 정답' ELSE '정답과 풀이 2쪽' END FROM n WHERE k = 180 AND book % 3 <> 2""",
    # heads of past exam questions: two sources in one line, forms and audiences before and behind the item, lines that are none
    "exam_heads": """SELECT p_partkey AS line_number, concat(CAST(p_size AS STRING), CASE p_size % 4 WHEN 0 THEN ' ★☆☆ ' WHEN 1 THEN '★★★ ' WHEN 2 THEN ' ' ELSE ' 하 · ' END, CASE WHEN p_size % 9 = 0 THEN '19' ELSE '20' END, CAST(10 + p_size % 13 AS STRING), CASE WHEN p_size % 2 = 0 THEN '학년도 ' ELSE '년  ' END,
        CASE CAST(floor(p_partkey / 7) AS BIGINT) % 9 WHEN 0 THEN '경찰대 수능 대비' WHEN 1 THEN '사관 학교' WHEN 2 THEN '수능' WHEN 3 THEN '6월학평 A형' WHEN 4 THEN '9월  모의평가' WHEN 5 THEN '교육청 학평' WHEN 6 THEN '모평 경찰' WHEN 7 THEN '' ELSE '견본' END,
        CASE p_partkey % 7 WHEN 0 THEN ' 12번(고3)' WHEN 1 THEN ' 7번' WHEN 2 THEN ' 21 문항 가' WHEN 3 THEN ' 30번 B형 ' WHEN 4 THEN ' 15나' WHEN 5 THEN '' ELSE ' A형 3번(고2)' END, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('  ', p_name) END) AS text FROM {part}""",
    # the lines of a problem with their places: stems without box, with a view in one or two columns, with conditions, with both, and choices after them
    "stem_lines": """WITH p AS (SELECT p_partkey AS problem_id, p_name AS stem, CAST(p_size % 6 AS INT) AS z, CAST(20 + p_size % 3 AS DOUBLE) AS h FROM {part})
        SELECT problem_id, 0 AS line_number, concat('next ', stem) AS text, CAST(0 AS DOUBLE) AS bbox_y, h AS bbox_h FROM p
        UNION ALL SELECT problem_id, 1, '(가) first', CAST(40 AS DOUBLE), h FROM p WHERE z IN (1, 3, 5)
        UNION ALL SELECT problem_id, 2, concat('(나) ', stem), CAST(80 AS DOUBLE), h FROM p WHERE z IN (1, 5)
        UNION ALL SELECT problem_id, 3, CASE WHEN z = 2 THEN '< 보기 >' ELSE '보기' END, CAST(120 AS DOUBLE), h FROM p WHERE z IN (2, 5)
        UNION ALL SELECT problem_id, 4, 'ㄱ. a', CAST(160 AS DOUBLE), h FROM p WHERE z IN (2, 4, 5)
        UNION ALL SELECT problem_id, 5, concat('ㄴ. ', stem), CASE WHEN z = 5 THEN CAST(163 AS DOUBLE) ELSE CAST(200 AS DOUBLE) END, h FROM p WHERE z IN (2, 4, 5)
        UNION ALL SELECT problem_id, 6, 'ㄷ. c', CAST(240 AS DOUBLE), h FROM p WHERE z IN (2, 5)
        UNION ALL SELECT problem_id, 7, 'which of them', CAST(280 AS DOUBLE), h FROM p
        UNION ALL SELECT problem_id, 8, '① ㄱ ② ㄴ', CAST(320 AS DOUBLE), h FROM p WHERE z <> 0
        UNION ALL SELECT problem_id, 9, 'ㄹ. after the choices', CAST(360 AS DOUBLE), h FROM p""",
    # edges of a prerequisite graph over units of a subject: always from a smaller to a larger number
    "prerequisites": "SELECT CAST(a.n_nationkey AS INT) AS from_node, CAST(b.n_nationkey AS INT) AS to_node FROM {nation} a JOIN {nation} b ON b.n_nationkey = 2 * a.n_nationkey + 1 OR b.n_nationkey = 2 * a.n_nationkey + 2",
}


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


class Tables:
    """The base tables of a folder and the learning tables over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DOMAIN:
            raise AttributeError(name)
        text = DOMAIN[name]
        return self.spark.sql(text, **{n: getattr(self, n) for n in names_in(text)})


def as_ctes(text: str) -> str:
    """SQL for the checking database: the learning tables that text names, as common table expressions before it."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in DOMAIN and name not in needed:
            for inner in names_in(DOMAIN[name]):
                visit(inner)
            needed.append(name)

    for name in DOMAIN:
        if re.search(rf"\b{name}\b", text):
            visit(name)
    ctes = ",\n".join(f"{n} AS ({DOMAIN[n].format(**{x: x for x in names_in(DOMAIN[n])})})" for n in needed)
    if not ctes:
        return text
    body = text.strip()
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE') :]}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {ctes},\n{body[len('WITH') :]}"
    return f"WITH {ctes}\n{body}"
