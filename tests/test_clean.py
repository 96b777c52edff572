"""Triplet extraction rules on hand-made records."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from shotbank.operators.clean import classify, extract_triplets, extraction_rate
from shotbank.sources.corpus import first_n, read_keyed_json

R10 = "r" * 10


def _keyed(spark, text: str):
    d = tempfile.mkdtemp(prefix="kj-", dir="/tmp")
    with open(os.path.join(d, "part.json"), "w", encoding="utf-8") as f:
        f.write(text)
    return read_keyed_json(spark, d)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_falsy_values_are_missing(spark):
    recs = {}
    for i, v in enumerate([None, "", 0, 0.0, False, [], {}]):
        for field in ("source", "target", "rationale"):
            rec = {"source": "qqq", "target": "a", "rationale": R10, "task": "t"}
            rec[field] = v
            recs[f"{field}-{i}"] = rec
    recs["ok"] = {"source": "qqq", "target": "a", "rationale": R10, "task": "t"}
    recs["truthy-nonstring"] = {"source": "qqq", "target": 5, "rationale": R10, "task": "t"}
    raw = _keyed(spark, json.dumps(recs))
    assert _ids(extract_triplets(raw)) == ["ok", "truthy-nonstring"]
    row = extract_triplets(raw).where(F.col("id") == "truthy-nonstring").first()
    assert row.answer == "5"


def test_task_null_missing_and_none(spark):
    raw = _keyed(spark, json.dumps({
        "null": {"source": "qqq", "target": "a", "rationale": R10, "task": None},
        "missing": {"source": "qqq", "target": "a", "rationale": R10},
        "text": {"source": "qqq", "target": "a", "rationale": R10, "task": "  math\n qa "}}))
    got = {r.id: r.task for r in extract_triplets(raw).collect()}
    assert got == {"null": "None", "missing": None, "text": "math qa"}


def test_length_boundaries_before_collapse(spark):
    recs = {
        "q2": {"source": " ab ", "target": "a", "rationale": R10},
        "q3": {"source": "abc", "target": "a", "rationale": R10},
        "r9": {"source": "abc", "target": "a", "rationale": "r" * 9},
        "r10": {"source": "abc", "target": "a", "rationale": "r" * 10},
        # 11 characters before collapse, 3 after: kept, as the length test comes first
        "spaced": {"source": "abc", "target": "a", "rationale": "a" + " " * 9 + "b"},
        "ws-only": {"source": "abc", "target": " 　 ", "rationale": R10},
        "astral": {"source": "a😀", "target": "a", "rationale": R10},
        "astral3": {"source": "a😀é", "target": "a", "rationale": R10},
    }
    raw = _keyed(spark, json.dumps(recs))
    kept = {r.id: r for r in extract_triplets(raw).collect()}
    assert sorted(kept) == ["astral3", "q3", "r10", "spaced"]
    assert kept["spaced"].rationale == "a b"
    reasons = {r.id: r.status for r in classify(raw).collect()}
    assert reasons["ws-only"] == "missing" and reasons["q2"] == "too_short" and reasons["r9"] == "too_short"


def test_duplicate_keys_and_non_objects(spark):
    text = ('{"a": {"source": "first", "target": "x", "rationale": "' + R10 + '"},'
            ' "b": "not an object", "c": [1, 2],'
            ' "a": {"source": "second", "target": "y", "rationale": "' + R10 + '"},'
            ' "d": {"source": "ddd", "target": "z", "rationale": "' + R10 + '"}}')
    raw = _keyed(spark, text)
    rows = raw.orderBy("pos").collect()
    assert [r.id for r in rows] == ["a", "b", "c", "d"]  # a keeps its first position
    trip = {r.id: r.question for r in extract_triplets(raw).collect()}
    assert trip == {"a": "second", "d": "ddd"}  # ... and its last value
    assert [r.id for r in first_n(raw, 2).collect()] == ["a", "b"]
    assert first_n(raw, 0).count() == 4


def test_clean_is_idempotent_and_rate(spark):
    from tests.conftest import SF_SMALL
    from shotbank.sources import fixtures as fx

    t = fx.triplets(spark, SF_SMALL)
    again = t.select("pos", "id", F.col("question").alias("source"), F.col("answer").alias("target"),
                     "rationale", "task")
    assert extract_triplets(again, "fixture").exceptAll(t).count() == 0
    r = extraction_rate(fx.corpus_raw(spark, SF_SMALL)).first()
    assert r.total == 200 and r.kept == 174 and r.kept + r.dropped_missing + r.dropped_short == r.total


def test_keyed_json_order_across_files(spark):
    d = tempfile.mkdtemp(prefix="kj-multi-", dir="/tmp")
    rec = lambda q: {"source": q, "target": "a", "rationale": R10}
    with open(os.path.join(d, "part-b.json"), "w") as f:
        f.write(json.dumps({"z": rec("zzz"), "a": rec("aaa")}))
    with open(os.path.join(d, "part-a.json"), "w") as f:
        f.write('{"m": %s, "m": %s}' % (json.dumps(rec("first")), json.dumps(rec("last"))))
    raw = read_keyed_json(spark, d)
    assert [r.id for r in raw.orderBy("pos").collect()] == ["m", "z", "a"]  # file path order, then key order
    assert {r.id: r.question for r in extract_triplets(raw).collect()} == {"m": "last", "z": "zzz", "a": "aaa"}
