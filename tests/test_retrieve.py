"""Threshold / fallback semantics and golden texts of the three formats."""

import pytest

from shotbank.operators.retrieve import retrieve, retrieve_and_format

KB = [("e1", [1.0, 0.0], "Q one", "R one", "A one", "t", "src"),
      ("e2", [0.8, 0.6], "Q two", "R two", "A two", "t", "src"),
      ("e3", [0.0, 1.0], "Q three", "R three", "A three", "t", "src")]


@pytest.fixture()
def kb(spark):
    return spark.createDataFrame(KB, "id string, embedding array<double>, question string, rationale string, "
                                     "answer string, task string, source string")


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, "first?", [1.0, 0.0]), (2, "second?", [0.0, -1.0])],
                                 "query_id long, query string, embedding array<double>")


def test_threshold_and_fallback(spark, kb, queries):
    hits = retrieve(queries, kb, k=3, threshold=0.5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in hits] == [(1, "e1"), (1, "e2"), (2, "e1")]  # q2: best only
    assert retrieve(queries, kb, k=3, threshold=0).count() == 6
    assert retrieve(queries, kb).count() == 2  # k=None -> 1
    assert "score" not in retrieve(queries, kb, return_scores=False).columns


def test_golden_formats(spark, kb, queries):
    simple = {r.query_id: r.text for r in retrieve_and_format(queries, kb, k=2, format_type="simple").collect()}
    assert simple[1] == ("Example 1 (similarity: 1.0000):\n  Question: Q one\n  Rationale: R one\n  Answer: A one\n\n"
                         "Example 2 (similarity: 0.8000):\n  Question: Q two\n  Rationale: R two\n  Answer: A two\n")
    det = {r.query_id: r.text for r in retrieve_and_format(queries, kb, k=1, format_type="detailed").collect()}
    assert det[1] == ("=== Retrieved Example 1 ===\nSimilarity Score: 1.0000\nSource: src\nID: e1\n"
                      "Question: Q one\nRationale: R one\nAnswer: A one\n")
    prompt = {r.query_id: r.text for r in retrieve_and_format(queries, kb, format_type="prompt").collect()}
    assert prompt[1] == ("Here are examples demonstrating how to think step-by-step:\n\n"
                         "Example 1:\nQuestion: Q one\nRationale: R one\n\n"
                         "Example 2:\nQuestion: Q two\nRationale: R two\n---\n\n"
                         "Now, solve the following problem using the same step-by-step thinking:")
    with pytest.raises(ValueError):
        retrieve_and_format(queries, kb, format_type="fancy")


def test_no_hits_gives_empty_text(spark, kb):
    q = spark.createDataFrame([(7, "x", None)], "query_id long, query string, embedding array<double>")
    rows = retrieve_and_format(q, kb, format_type="prompt").collect()
    assert [(r.query_id, r.text) for r in rows] == [(7, "")]


def test_l2_threshold_is_on_similarity(spark, kb, queries):
    # unit vectors: squared distance d and cosine c satisfy c = 1 - d / 2
    hits = retrieve(queries, kb, k=3, threshold=0.5, metric="l2").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in hits] == [(1, "e1"), (1, "e2"), (2, "e1")]
    assert hits[0].score == 0.0 and abs(hits[1].score - 0.4) < 1e-12  # distances ascend
