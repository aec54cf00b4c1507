"""WARC archives, periodic runs and the divergence of sources against brute force and exact round trips."""

import glob
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeleaf.llm import divergence, periodic_runs, queries, warc

# ---------------------------------------------------------------- archives

PAGE = "<p>" + "text " * 40 + "</p>"
PAGES = [
    (7, "http://a/7", PAGE), (3, "http://a/3 x\r\nEvil: 1", PAGE), (3, "http://a/3b", PAGE), (9, None, PAGE),
    (None, "http://a/n", PAGE), (5, "http://b/5", "short"), (6, "http://b/6", "short"), (1, "http://b/1", None), (2, "http://b/2", ""),
    (10, "http://c/10", "é" * 50), (11, "http://c/11", "é" * 50), (12, "http://c/12", "é" * 49 + "e"), (13, "http://c/13", "WARC/1.1\r\n\r\n\r\n\r\n" * 9),
    (14, "http://d/14", "<b>" + "x" * (17 << 20)), (15, "http://d/15", PAGE), (15, "http://d/15", PAGE), (None, "http://a/m", "é" * 50),
]


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    pages = spark.createDataFrame([(*p, "kept out") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3).cache()
    path = warc.write_archives(pages, path=f"{tmp_path_factory.mktemp('warc')}/archives", records_per_file=4)
    return path, warc.index_archives(spark, path)


def test_archives_are_gzip_files_of_one_member_a_record(archived):
    path, index = archived
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) >= 4
    whole = {f: open(f, "rb").read() for f in files}
    assert sum(gzip.decompress(b).count(b"\r\nWARC-Type: ") for b in whole.values()) == len(PAGES)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({r.record_id for r in rows}) == len(PAGES)
    for r in rows:
        part = whole[re.sub("^file:/+", "/", r.archive)][r.offset : r.offset + r.length]
        head, payload = warc.parsed(gzip.decompress(part))
        assert (head.record_id, head.record_type) == (r.record_id, r.record_type)
        assert r.record_type == "revisit" and not payload or hashlib.sha256(payload).hexdigest() == r.payload_digest
    for f, data in whole.items():  # the records lie end to end
        mine = sorted((r.offset, r.length) for r in rows if r.archive.endswith(f.rsplit("/", 1)[1]))
        assert [a for a, _ in mine] == [0, *np.cumsum([n for _, n in mine])[:-1]] and sum(mine[-1]) == len(data)


def test_pages_come_back(archived):
    _, index = archived
    got = Counter((r.page_id, r.html) for r in warc.restored_pages(index).collect())
    assert got == Counter((None if i is None else str(i), html or "") for i, _, html in PAGES)
    url = index.where("page_id = '3'").agg(F.max("url")).first()[0]
    assert url in ("http://a/3b", "http://a/3%20x%0D%0AEvil:%201")


def test_revisits_refer_to_the_smallest_page(archived):
    _, index = archived
    found = warc.resolved(warc.read_records(index, with_payload=False)).collect()
    kinds = defaultdict(Counter)
    for r in found:
        kinds[r.payload_digest][r.record_type, r.refers_to] += 1
    by = {h: hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in PAGES}
    assert kinds[by[PAGE]] == {("response", None): 1, ("revisit", "3"): 6}
    assert kinds[by["é" * 50]] == {("response", None): 1, ("revisit", "10"): 2}
    assert kinds[by["short"]] == {("response", None): 2} and kinds[by[""]] == {("response", None): 2}
    assert {r.payload_bytes for r in found if r.payload_digest == by[PAGE]} == {len(PAGE)}


def test_selected_records_alone_are_read(archived):
    _, index = archived
    some = index.where("page_id IN ('13', '14', '5')")
    assert {(r.page_id, len(r.payload)) for r in warc.read_records(some).collect()} == {("13", 144), ("14", (17 << 20) + 3), ("5", 5)}
    with pytest.raises(Exception, match="no response for"):
        warc.resolved(warc.read_records(index.where("record_type = 'revisit'"))).collect()


def test_ranges_are_read_together():
    places = [("a", 0, 10), ("a", 10, 5), ("a", 20, 5), ("a", 99, 1), ("b", 100, 50), ("b", 150, 1)]
    assert [len(r) for r in warc.coalesced(places, gap=5, most=30)] == [3, 1, 1, 1]
    assert [len(r) for r in warc.coalesced(places, gap=100, most=1000)] == [4, 2]


def test_cut_or_foreign_bytes_are_refused():
    member = warc.gzip_member(warc.record(warc.Header("urn:x", "response", None, None, "00"), b"abc", 3, "now"), 1) + b"\0"
    assert next(warc.members([member[:7], member[7:]]))[:2] == (0, len(member))
    with pytest.raises(ValueError, match="cut short"):
        list(warc.members([member + member[:-5]]))
    with pytest.raises(ValueError, match="not a WARC record"):
        warc.parsed(b"HTTP/1.1 200\r\n\r\n")


def test_no_pages(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path=f"{tmp_path}/none")
    assert warc.restored_pages(warc.index_archives(spark, path)).count() == 0


# ---------------------------------------------------------------- runs


def slow_runs(words, least=12):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if j > i and len(stretch) >= max(least, 2 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words):
    seen = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    return ids, len(seen)


@pytest.mark.parametrize("least", [2, 3, 12, 20])
def test_runs_against_every_lag(least):
    draw = random.Random(least)
    for _ in range(250):
        n = draw.choice([0, 1, 2, 11, 12, 13, 40, 130])
        words = [draw.randrange(draw.choice([1, 2, 3, 40])) for _ in range(n)]
        for _ in range(draw.randrange(4)):
            if n > 5:
                a, p = draw.randrange(n), draw.randrange(1, max(2, n // 3))
                for i in range(a + p, min(n, a + draw.randrange(n))):
                    words[i] = words[i - p]
        assert periodic_runs.runs_of(*numbered(words), least) == slow_runs(words, least), words


def test_long_texts_of_one_word_or_one_period():
    for n, period in ((150_000, 1), (150_000, 7), (60_000, 20_000)):
        assert periodic_runs.runs_of(*numbered([i % period for i in range(n)])) == [(0, n, period)]


def contract_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *top, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_against_brute_force(spark, tmp_path):
    draw = random.Random(5)
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "a\x1cb\x85c d " * 9, "Same same same " * 30, "la la " * 8 + "x y z w " * 9, "日本 語 é " * 11]
    texts += [" ".join(draw.choice(["a", "b", "cc"]) for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    texts += [" ".join(f"w{draw.randrange(500)}" for _ in range(draw.randrange(1, 150))) for _ in range(80)]
    texts += [" ".join(f"v{(i % p) * 7 % 13 if i % 31 else draw.randrange(9)}" for i in range(draw.randrange(30, 140))) for p in range(1, 30)]
    rows = [(None, "x y " * 10), *enumerate(texts), (3, "one")]
    spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    want = [contract_row(i, t) for i, t in rows]
    assert sum(w[1] for w in want) > 20 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_runs_keep_other_columns(spark):
    docs = spark.createDataFrame([("r", "b a " * 9, 5, "x")], "runs string, text string, start int, collapsed string")
    (row,) = periodic_runs.find_runs(docs).collect()
    assert (row.start, row.n_words, row.collapsed, [tuple(r) for r in row.runs]) == (5, 18, "b a", [(0, 18, 2)])
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- divergence


def slow_audit(docs, least_docs, k, scale=10**9):
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))
        groups.add((lang, source))
        counts[lang, source].update(found)
        counts[lang].update(found)
        holders[lang].update(found.keys())
    kept = {lang: sorted(t for t, n in holders[lang].items() if n >= least_docs) for lang, _ in groups}
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def shares(key, lang):
        total = sum(counts[key][t] for t in kept[lang])
        return {t: 1 + scale * (counts[key][t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    rows = []
    for lang, source in groups:
        p, q = shares((lang, source), lang), shares(lang, lang)
        pairs = [(o, sum(f(p[t], r[t]) for t in p)) for l2, o in groups if l2 == lang and o != source for r in [shares((lang, o), lang)]]
        terms = [(t, f(p[t], q[t])) for t in p if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            rows += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return rows


def mixed_docs():
    draw = random.Random(8)
    words = [f"{'abc'[i % 3]}{'xyzuv'[i % 5]}é{chr(97 + i % 26)}" for i in range(80)] + ["日本", "𝒳", "The", "tHE", "Ünder", "prefix" * 9 + "a", "prefix" * 9 + "b", "prefix" * 9]
    docs = [(" ".join(draw.choice(words[j % 7 :: 3]) + draw.choice([" ", ".", "9", "-"]) for _ in range(draw.randrange(40))), "en" if draw.random() < 0.7 else draw.choice(["de", None]), f"s{j % 7}") for j in range(260)]
    docs += [(None, "en", None), ("", "fr", "s1"), ("12 34", "fr", "s2"), ("only here", "es", "s0"), ("ties " + " ".join(words), "en", "s9"), ("ties " + " ".join(words), "en", "s9")]
    return docs


@pytest.mark.parametrize("held", [3, 200_000])
def test_audit_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(divergence.term_counts, "__defaults__", (held,))
    docs = mixed_docs()
    frame = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, rank int").repartition(3)
    want = slow_audit(docs, 4, 5)
    assert len({r[0] for r in want}) >= 4 and any(r[2] == "term" for r in want)
    assert sorted(map(tuple, divergence.audit(frame, least_docs=4, k=5).collect())) == sorted(want)


def test_ties_beyond_the_kth_value_go_by_bytes(spark):
    items = ["p" * 30 + x for x in ("", "a", "ab", "b", "é", "z", "日")] + ["𝒳", "a", "Z"]
    rows = [("g", i, 5) for i in items] + [("g", "top", 9), ("h", "x", 0), ("h", "y", 0), ("i", "w", 10**9)]
    frame = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 4, 6, 20):
        got = {(r.g, r.item): r["rank"] for r in divergence.top_by_radix(frame, ["g"], k, 10**9).collect()}
        want = {}
        for g in "ghi":
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want |= {(g, r[1]): i + 1 for i, r in enumerate(mine)}
        assert got == want


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    few = spark.createDataFrame([("a b", "en", "x"), ("a", "en", "y"), (None, None, None)], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
