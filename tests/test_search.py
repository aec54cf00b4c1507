"""The inverted index against scans of the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeleaf.operators import retrieval as J
from gaugeleaf.operators.search import SearchIndex

DRAW = random.Random(2)
COMMON = ["the", "of", "a", "sum", "é"]


def text(i):
    words = [DRAW.choice(COMMON) for _ in range(DRAW.randrange(1, 60))]
    if i % 7 == 0:
        words += ["prime"] * DRAW.randrange(1, 9) + ["number"] * DRAW.randrange(3)
    if i % 11 == 0:
        words = ["Prime", "number", "the", "prime"]
    DRAW.shuffle(words)
    return DRAW.choice([" ", ", ", "-"]).join(words)


ROWS = [(i, text(i)) for i in range(900)] + [(900, None), (901, ""), (902, "--"), (903, "the prime the prime number"), (903, "a second row of one key")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = spark.createDataFrame([*ROWS, (None, "the key is missing")], "id long, t string").repartition(4).cache()
    return docs.where("id is not null and id < 903"), SearchIndex.build(docs, "id", "t", f"{tmp_path_factory.mktemp('search')}/index", buckets=8)


def words(t):
    return [w for w in re.split(r"[^\w]+", (t or "").lower()) if w]


def test_documents_with_all_words(built):
    _, index = built
    want = {i for i, t in ROWS if {"prime", "number", "the"} <= set(words(t))}
    assert {r.id for r in index.holding(["the", "prime", "number", "the"]).collect()} == want
    assert index.holding(["prime", "nowhere"]).count() == 0


def test_phrases(built):
    _, index = built
    for phrase in (["prime", "number"], ["the", "prime", "the"], ["prime", "prime"], ["nowhere"]):
        want = {i for i, t in ROWS if i != 903 and f" {' '.join(phrase)} " in f" {' '.join(words(t))} "}
        assert {r.id for r in index.phrase(phrase).where("id < 903").collect()} == want
    assert 903 in {r.id for r in index.phrase(["the", "prime", "number"]).collect()}


def test_scores_equal_those_of_a_scan(spark, built):
    docs, _ = built
    index = SearchIndex.build(docs, "id", "t")
    for query in (["prime"], ["prime", "number", "é"], ["the", "nowhere"]):
        want = {r.id: r.score for r in J.bm25(docs, "id", "t", query).collect()}
        got = {r.id: r.score for r in index.scored(query).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_the_best_are_found_from_the_upper_tiers(spark, built):
    docs, _ = built
    index = SearchIndex.build(docs, "id", "t")
    tiers = set()
    for query in (["prime"], ["prime", "number"], ["prime", "the"], ["é", "sum", "of"], ["number", "nowhere"], ["nowhere"]):
        full = sorted(((-r.score, r.id) for r in index.scored(query).collect()))
        for k in (1, 5, 40, 2000):
            got = index.best(query, k).collect()
            assert [(pytest.approx(s, rel=1e-9), i) for s, i in full[:k]] == [(-r.score, r.id) for r in got]
            tiers |= {r.tiers for r in got}
    assert 4 in tiers and min(tiers) < 4


def test_a_search_reads_the_postings_of_its_words(built):
    _, index = built
    scan = index.postings(["prime"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("[isnotnull(bucket#", "[bucket#") or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert "In(term" in plan or "EqualTo(term" in plan
    files = {r[0].split("bucket=")[1].split("/")[0] for r in scan.select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1
    assert sorted(r["count"] for r in scan.groupBy("id").count().collect())[-1] == 1


def test_index_of_nothing(spark):
    index = SearchIndex.build(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert index.holding(["a"]).count() == index.best(["a"], 3).count() == index.phrase(["a", "b"]).count() == 0
