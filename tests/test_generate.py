"""Prompt texts, failure isolation and evaluation edge cases."""

import pytest
from pyspark.sql import functions as F

from shotbank.operators import generate as gen

HITS = [(1, 1, 0.9, "e1", "Q1", "R1", "A1"), (1, 2, 0.7, "e2", "Q2", "R2", "A2")]


def test_prompts_golden(spark):
    q = spark.createDataFrame([(1, "What?"), (2, "Why?")], "query_id long, query string")
    hits = spark.createDataFrame(HITS, "query_id long, rank int, score double, id string, question string, "
                                       "rationale string, answer string")
    base = {r.query_id: r.prompt for r in gen.baseline_prompts(q).collect()}
    assert base[1] == "Question: What?\n\nGive me the final answer only."
    cot = {r.query_id: r for r in gen.cot_prompts(q, hits).collect()}
    assert cot[1].prompt == ("Question: What?\n\nExample 1:\nQuestion: Q1\nRationale: R1\nAnswer: A1\n\n"
                             "Example 2:\nQuestion: Q2\nRationale: R2\nAnswer: A2\n\n"
                             "Now think step by step to solve the question above.")
    assert cot[2].prompt == "Question: Why?\n\nThink step by step to solve this question."
    assert cot[1].system.startswith("You are a helpful assistant that thinks")


def test_failing_call_is_isolated(spark):
    def model(system, prompt):
        if "boom" in prompt:
            raise RuntimeError("service down")
        return "  ok  "

    q = spark.createDataFrame([(1, "fine"), (2, "boom")], "query_id long, query string")
    out = {r.query_id: r for r in gen.generate(gen.baseline_prompts(q), model).collect()}
    assert out[1].response == "ok" and not out[1].failed
    assert out[2].response == "Error: service down" and out[2].failed
    assert out[1].generation_time >= 0


def test_evaluate_edge_cases(spark):
    schema = "query_id long, error string, baseline_time double, cot_time double, best_similarity_score double"
    empty = gen.evaluate(spark.createDataFrame([], schema)).first()
    assert empty.total_queries == 0 and empty.error is None  # nothing asked: no metrics, and no error
    all_err = gen.evaluate(spark.createDataFrame([(1, "x", None, None, None)], schema)).first()
    assert all_err.error == gen.NO_VALID
    rows = [(1, None, 1.0, 3.0, 0.8), (2, None, 1.0, 2.0, None), (3, "boom", None, None, None)]
    m = gen.evaluate(spark.createDataFrame(rows, schema)).first()
    assert m.total_queries == 2 and m.average_time_overhead == 1.5
    assert m.average_similarity_score == 0.8 and m.retrieval_success_rate == 0.5
    assert m.above_threshold_rate == 0.5 and m.error is None


def test_report_text(spark):
    schema = ("query_id long, query string, baseline_prompt string, baseline_response string, baseline_time double, "
              "cot_prompt string, cot_response string, cot_time double, error string")
    df = spark.createDataFrame([(1, "Q?", "P1", "R1", 0.5, "P2", "R2", 1.25, None),
                                (2, "Bad?", None, None, None, None, None, None, "boom")], schema)
    rep = {r.query_id: r.report for r in gen.report(df).collect()}
    assert rep[1] == ("=" * 80 + "\nQUERY: Q?\n" + "=" * 80 + "\n\n📍 BASELINE APPROACH:\nPrompt: P1\nResponse: R1\n"
                      "Time: 0.500s\n\n🧠 RETRIEVAL-AUGMENTED CoT APPROACH:\nFull Prompt: P2\nResponse: R2\nTime: 1.250s")
    assert rep[2] == "Error processing query 'Bad?': boom"


def test_generation_runs_once_and_is_reused(spark):
    import tempfile

    calls = spark.sparkContext.accumulator(0)

    def model(system, prompt):
        calls.add(1)
        return "answer"

    q = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "query_id long, query string")
    g = gen.generate_to(gen.baseline_prompts(q), model, tempfile.mkdtemp(dir="/tmp") + "/gen")
    assert calls.value == 6
    g.count(), g.collect(), gen.compare_methods(g).count()  # downstream reads use the written table
    assert calls.value == 6


def _noting(folder, stop=None, fail=()):
    """A model that leaves a file per call; it ends its process at ``stop`` and fails at ``fail``."""

    def model(system, prompt):
        import os
        import tempfile as t

        os.close(t.mkstemp(prefix=prompt.split()[-1] + "-", dir=folder)[0])
        if stop and prompt.endswith(stop):
            os._exit(1)
        if any(prompt.endswith(x) for x in fail):
            raise ValueError("busy")
        return "answer to " + prompt[-4:]

    return model


def _calls(folder):
    import os
    from collections import Counter

    return Counter(n.split("-")[0] for n in os.listdir(folder))


def test_a_killed_run_goes_on_without_calling_finished_prompts(spark, tmp_path):
    q = spark.createDataFrame([(i, f"q{i:03d}") for i in range(40)], "query_id long, query string")
    prompts = q.select("query_id", F.lit("baseline").alias("method"), "query", F.lit("s").alias("system"), F.concat(F.lit("ask "), "query").alias("prompt"))
    prompts = prompts.union(prompts.where("query_id < 3"))  # repeated prompts are asked once
    one, two, out = (str(tmp_path / n) for n in ("one", "two", "out"))
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir()
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a lost worker
        gen.generate_resumable(prompts, _noting(one, stop="q021"), out, calls_per_commit=4)
    kept = gen.answers(spark, out)
    finished = {r.query for r in kept.collect()} if kept is not None else set()
    done = gen.generate_resumable(prompts, _noting(two), out, calls_per_commit=4)
    assert finished and not finished & set(_calls(two)) and finished | set(_calls(two)) == {f"q{i:03d}" for i in range(40)}
    assert max(_calls(two).values()) == 1 and max(_calls(one).values()) == 1
    assert sorted(r.response for r in done.collect()) == sorted(f"answer to q{i:03d}" for i in range(40))
    again = gen.generate_resumable(prompts, _noting(two, stop="q"), out)  # calls nothing
    assert again.count() == 40


def test_failed_calls_are_repeated_then_asked_again(spark, tmp_path):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "query_id long, query string")
    prompts = q.select("query_id", F.lit("m").alias("method"), "query", F.lit(None).cast("string").alias("system"), F.concat(F.lit("ask "), "query").alias("prompt"))
    out = str(tmp_path / "out")
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir()
    first = gen.generate_resumable(prompts, _noting(str(tmp_path / "one"), fail=["q2"]), out, retries=2, backoff=0.01)
    assert {r.query: r.failed for r in first.collect()} == {"q0": False, "q1": False, "q2": True, "q3": False}
    assert _calls(str(tmp_path / "one")) == {"q0": 1, "q1": 1, "q2": 3, "q3": 1}
    second = gen.generate_resumable(prompts, _noting(str(tmp_path / "two")), out)
    assert _calls(str(tmp_path / "two")) == {"q2": 1} and not any(r.failed for r in second.collect()) and second.count() == 4
    assert gen.generate_resumable(prompts.limit(0), _noting(out), str(tmp_path / "none")).count() == 0


def test_null_fields_keep_their_example(spark):
    from shotbank.operators import retrieve as ret

    hits = spark.createDataFrame([(1, 1, 0.9, "e1", None, "R1", "A1", None, None), (1, 2, 0.7, "e2", "Q2", None, None, "t", "s")],
                                 "query_id long, rank int, score double, id string, question string, rationale string, "
                                 "answer string, task string, source string")
    for kind, head in (("simple", "Example %d (similarity"), ("detailed", "=== Retrieved Example %d ==="), ("prompt", "Example %d:")):
        text = ret.format_hits(hits, kind).first().text
        assert head % 1 in text and head % 2 in text
    q = spark.createDataFrame([(1, "What?")], "query_id long, query string")
    prompt = gen.cot_prompts(q, hits).first().prompt
    assert "Example 1:\nQuestion: \nRationale: R1" in prompt and "Example 2:\nQuestion: Q2\nRationale: \nAnswer: \n" in prompt


def test_error_rows_keep_the_query_and_no_key_vanishes(spark):
    q = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "query_id long, query string")
    g = gen.generate(gen.baseline_prompts(q.where("query_id < 3")).unionByName(gen.cot_prompts(q.where("query_id < 2"), spark.createDataFrame(
        [], "query_id long, rank int, score double, id string, question string, rationale string, answer string")),
        allowMissingColumns=True), gen.echo_model)
    failed = q.where("query_id = 1")
    got = {r.query_id: r for r in gen.compare_methods(g, expected=q, failed=failed).collect()}
    assert {i: r.error for i, r in got.items()} == {0: None, 1: "comparison failed", 2: "missing retrieval_augmented_cot result",
                                                    3: "missing baseline result"}
    assert {i: r.query for i, r in got.items()} == {i: f"q{i}" for i in range(4)}
    reports = {r.query_id: r.report for r in gen.report(gen.compare_methods(g, expected=q, failed=failed)).collect()}
    assert reports[1] == "Error processing query 'q1': comparison failed" and reports[3].startswith("Error processing query 'q3'")
    assert {r.query_id for r in gen.compare_methods(g).collect()} == {0, 1, 2}  # without ``expected`` too


def test_batch_comparison_plan(spark):
    """One aggregate over the key, and none over texts."""
    from shotbank.plans.registry import _fixture_comparisons
    from tests.conftest import SF_SMALL

    plan = _fixture_comparisons(spark, SF_SMALL, True)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan
