import hashlib
import random
from collections import Counter

import pytest

from shotbank.llm import radix_repeats

from .conftest import DOC_SCHEMA, awkward_rows, doc, words


def brute(rows, depth):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(raw[i:i + depth] for raw in raws for i in range(len(raw) - depth + 1))
    out = []
    for r, raw in zip(rows, raws):
        gone = [False] * len(raw)
        for i in range(len(raw) - depth + 1):
            if seen[raw[i:i + depth]] > 1:
                gone[i:i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((r[0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), any(gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    passage = " ".join(words(rng, 150))
    rows = awkward_rows()
    for i in range(30):
        t = " ".join(words(rng, rng.choice([10, 100, 400])))
        for _ in range(rng.choice([0, 1, 2])):
            a = rng.randrange(len(passage) // 2)
            t += passage[a:a + rng.choice([200, 399, 400, 401, 600])] + rng.choice("xyz")
        rows.append(doc(50 + i, t))
    rows += [doc(90, "a" * 1000), doc(91, "ab" * 300 + "c"), doc(92, "é" * 450), doc(93, "line of text\n" * 60), doc(4, "other text " + passage)]
    return rows


@pytest.mark.parametrize("chunk", [radix_repeats.CHUNK, 512])
def test_matches_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(radix_repeats, "CHUNK", chunk)
    rows = corpus()
    got = radix_repeats.dedup_digest(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    want = brute(rows, 400)
    assert sum(r[2] > 0 for r in want) > 10
    assert sorted((tuple(r) for r in got), key=str) == want


def test_many_equal_rows(spark):
    """Equal in id and text, null ids among them; what they share with others counts too."""
    rng = random.Random(3)
    text = " ".join(words(rng, 200))
    rows = [doc(1, text)] * 50 + [doc(None, text)] * 20 + [doc(2, "short")] * 30 + [doc(3, None)] * 5 + [
        doc(4, "x" + text[100:700] + "y"), doc(5, " ".join(words(rng, 200)))]
    frame = spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)
    assert sorted((tuple(r) for r in radix_repeats.dedup_digest(frame).collect()), key=str) == brute(rows, 400)
    equal = radix_repeats._keyed(spark.createDataFrame([doc(1, text)] * 50, DOC_SCHEMA), "doc_id", "text")
    assert radix_repeats.repeated_runs(equal.dropDuplicates(["doc_id", "th"])).count() == 0


def test_empty_table(no_docs):
    assert radix_repeats.dedup_digest(no_docs).count() == 0
