import contextlib
import glob
import math
import os
import re
import threading
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shotbank.llm import backoff_lm

from .conftest import awkward_rows


def tokens(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]


def check(rows, docs, **options):
    got = backoff_lm.score_corpus(docs, **options).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(t for r in rows if not fold(r[0]) for t in tokens(r[1]))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), fold(r[0]), len(tokens(r[1])), sum(counts[t] > 0 for t in tokens(r[1])), total,
                   round(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens(r[1])), 6)) for r in rows)
    assert sorted((str(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6))
                  for g in got) == want
    assert all(g["score"] <= 1e-9 for g in got)
    return got


def plain(rows):
    """The model by its definition, with dictionaries of tuples: log10 probability of a text, token by token."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter()
    words = Counter()
    for r in rows:
        if not fold(r[0]):
            t = [None, *tokens(r[1])]
            words.update(t[1:])
            for n in (1, 2, 3):
                seen.update(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    z = sum(words.values()) + len(words) + 1

    def p(context, w):
        if not context:
            return (words[w] + 1) / z
        low = p(context[1:], w)
        k = backoff_lm.PRIOR[len(context) - 1]
        return (seen[(*context, w)] + k * low) / (seen[context] + k) if seen[context] else low

    def score(text):
        t = [None, *tokens(text)]
        return sum(math.log10(p(tuple(t[max(0, i - 2):i]), t[i])) for i in range(1, len(t)))

    return p, score, words


@pytest.mark.parametrize("chunk", [backoff_lm.CHUNK, 700])
def test_exact_by_plain_dictionaries(spark, awkward, documents, monkeypatch, chunk):
    """All counts in all orders, whatever the chunks; n-grams seen once count too."""
    monkeypatch.setattr(backoff_lm, "CHUNK", chunk)
    frame = awkward.select("doc_id", "text").union(documents.select(F.col("doc_id") + 1000, "text")).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = check(rows, frame)
    _, score, _ = plain(rows)
    assert sorted((str(g["doc_id"]), round(g["score"], 6)) for g in got) == sorted((str(i), round(score(t), 6)) for i, t in rows)


def test_held_out_texts_gain_much_over_unigrams(documents):
    got = check([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()], documents)
    held = [g for g in got if g["held_out"]]
    assert sum(g["score"] - g["base_score"] for g in held) > 0.4 * sum(g["n_tokens"] for g in held)


def test_probabilities_of_every_state_sum_to_one(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(40).collect()]
    p, _, words = plain(rows)
    unseen = b"\xff"  # one for all words that the texts don't have
    texts = [[None, *tokens(t)] for _, t in rows]
    for t in texts[:6]:
        for context in [(), (None,), tuple(t[:2]), tuple(t[3:5]), tuple(t[5:6]), (b"never", b"seen")]:
            if b"" not in context:
                assert sum(p(context, w) for w in [*words, unseen]) == pytest.approx(1, abs=1e-9)


def test_empty_table(no_docs):
    assert backoff_lm.score_corpus(no_docs).count() == 0


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = backoff_lm.score_corpus(spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]


def test_less_is_shuffled_than_a_row_for_every_ngram(spark, monkeypatch):
    """Chunks aren't shuffled and their n-grams go out packed."""
    monkeypatch.setattr(backoff_lm, "CHUNK", 1 << 18)
    docs = spark.range(0, 6000, 1, 4).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *(F.hex(F.xxhash64("id", F.lit(i)) % (1 << 14)) for i in range(60))).alias("text"))
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    sizes, done = {}, threading.Event()

    def watch():  # shuffles may be deleted when a query ends
        while not done.wait(0.02):
            for path in (p for f in folders for p in glob.glob(f"{f}/*/shuffle_*.data")):
                with contextlib.suppress(OSError):
                    sizes[path] = os.path.getsize(path)

    watch_ = threading.Thread(target=watch)
    old = {p for f in folders for p in glob.glob(f"{f}/*/shuffle_*.data")}
    watch_.start()
    try:
        got = backoff_lm.score_corpus(docs).collect()
    finally:
        done.set()
        watch_.join()
    n = sum(g["n_tokens"] for g in got)
    assert n == 6000 * 61
    shuffled = sum(x for p, x in sizes.items() if p not in old)
    print(f"{shuffled / n:.1f} bytes a token")
    assert 0 < shuffled < 24 * n
