import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shotbank.llm import noisy_toxicity as nt
from shotbank.llm.common import table

from .conftest import DOC_SCHEMA, awkward_rows, doc

RUDE = ["idiot", "moron", "worthless", "disgusting", "pathetic", "trash"]


def disguised(word, rng):
    """Leetspeak, characters between letters, or a letter many times."""
    how = rng.randrange(3)
    if how == 0:
        out = "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "$"}.get(c, c) for c in word)
        return out if out != word else word[0] + "." + ".".join(word[1:])
    if how == 1:
        return rng.choice([".", "-", " "]).join(word)
    i = rng.randrange(1, len(word) - 1)
    return word[:i] + word[i] * rng.randint(3, 6) + word[i + 1:] if word[i] not in (word[i - 1], word[i + 1]) else word[0] + "*" + "*".join(word[1:])


@pytest.fixture(scope="module")
def base(sf):
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def chars(spark, base):
    return nt.char_model(table(spark, base, "documents"))


@pytest.fixture(scope="module")
def trained(spark, base, chars):
    return nt.train(table(spark, base, "documents"), table(spark, base, "labels"), chars)


def test_character_counts_and_probabilities(spark, documents):
    texts = [r["text"] for r in documents.limit(40).collect()]
    got = nt.char_model(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    words = Counter(w for t in texts for w in nt._WORD.findall(t.lower()))
    want = Counter()
    for w, n in words.items():
        s = [nt.END] * 3 + [nt.FOLD[c] for c in w] + [nt.END]
        for i in range(3, len(s)):
            want[tuple(s[i - 3:i + 1])] += n
    p = np.exp(got.logp.astype(float)).reshape((nt.SYMBOLS,) * 4)
    assert np.allclose(p.sum(-1), 1, atol=1e-4) and (p > 0).all()

    def probability(h, c):  # Witten-Bell by its definition
        lower = probability(h[1:], c) if h else 1 / nt.SYMBOLS
        here = Counter()
        for k, n in want.items():
            if k[3 - len(h):3] == h:
                here[k[3]] += n
        return (here[c] + len(here) * lower) / (sum(here.values()) + len(here)) if here else lower

    for k in random.Random(1).sample(sorted(want), 12):
        assert abs(p[k] - probability(k[:3], k[3])) < 1e-5
    assert abs(p[5, 5, 5, 5] - probability((5, 5, 5), 5)) < 1e-5


def test_decoding_is_the_best_of_all_paths(chars):
    def cost(text):
        total = 0.0
        for w in text.split():
            s = [nt.END] * 3 + [nt.FOLD[c] for c in w] + [nt.END]
            for i in range(3, len(s)):
                total -= float(chars.logp[((s[i - 3] * nt.SYMBOLS + s[i - 2]) * nt.SYMBOLS + s[i - 1]) * nt.SYMBOLS + s[i]])
        return total

    rng = random.Random(2)
    for _ in range(60):
        s = "".join(rng.choice(["a", "e", "t", "th", "iii", "0", "1", "5", "@", "!", ".", "-", "é", "9"]) for _ in range(rng.randint(2, 6)))
        edges, found = chars.lattice(s), {}
        todo = [(0, "", 0.0)]
        while todo:
            i, text, c = todo.pop()
            if i == len(s):
                text = " ".join(text.split())
                found[text] = min(found.get(text, math.inf), c + cost(text))
            else:
                todo += [(j, text + x, c - channel) for j, x, channel in edges[i]]
        got = " ".join(chars.decode(s).split())
        assert found[got] <= min(found.values()) + 1e-4, s


def test_disguised_words_are_restored_and_others_left(spark, chars, documents):
    reader, rng = nt.Reader(chars), random.Random(4)
    right = [reader.restored("the " + disguised(w, rng) + " of") == f"the {w} of" for w in RUDE * 10]
    assert np.mean(right) >= 0.9
    for w in ["the", "été", "", "2023", "ß", "que&&&", '"scum!!"', "12:30", "日本", "ill", "!!!", "@", "_"]:
        assert reader.restored(w) == w
    texts = [doc(i, f"You, I d 1 0 t! {w}") for i, w in enumerate(["", "x" * 80 + "1y", "\x00 é", "a b", "a-b c1"])]
    got = nt.restore(spark.createDataFrame([*texts, doc(9, None)], DOC_SCHEMA), chars).collect()
    assert {r["doc_id"]: r["restored"] for r in got}[9] == "" and all("idiot" in r["restored"] for r in got if r["doc_id"] < 9)


def test_long_texts_are_read_in_slices(chars, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["the", "1d10t", "m o r o n", "été", "a", "thing!!"]) for _ in range(4000))
    whole = nt.Reader(chars).features(text)
    monkeypatch.setattr(nt, "SLICE", 300)
    parts = list(nt.Reader(chars).tokens(text))
    assert len(parts) > 10 and nt.Reader(chars).features(text) == whole


def test_held_out_documents(spark, base, chars, trained):
    docs, labels = table(spark, base, "documents"), {r["doc_id"]: r["toxic"] for r in table(spark, base, "labels").collect()}
    got = {r["doc_id"]: r for r in nt.score(docs, chars, trained).collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) >= 0.9
    assert np.mean([p == 0 for p, y in held if not y]) >= 0.97
    reader, places = nt.Reader(chars), {int(f): i for i, f in enumerate(trained.features)}
    for r in docs.limit(30).collect():  # the score by its definition, from the whole restored text
        x = dict.fromkeys(range(len(places)), 0)
        for w in nt._LETTERS.findall(reader.restored(r["text"])):
            for f in ['=' + w, *(w[:k] for k in nt.BEGINNINGS if len(w) >= k)]:
                if nt.hashed(f) in places:
                    x[places[nt.hashed(f)]] += 1
        z = trained.b + sum(trained.w[f] * math.log(1 + n) for f, n in x.items())
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_disguise_does_not_hide_toxic_documents(spark, base, chars, trained):
    rng = random.Random(8)
    clean = [r["text"] for r in table(spark, base, "documents").join(
        table(spark, base, "labels").where("toxic = 0 and quality = 1"), "doc_id").where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    rows = []
    for i, t in enumerate(clean):
        words = t.split()
        for w in itertools.chain(RUDE, RUDE):
            words.insert(rng.randrange(len(words) + 1), disguised(w, rng))
        rows += [doc(i, t), doc(1000 + i, " ".join(words))]
    got = {r["doc_id"]: r["predicted"] for r in nt.score(spark.createDataFrame(rows, DOC_SCHEMA), chars, trained).collect()}
    assert np.mean([got[i] == 0 for i in range(len(clean))]) >= 0.97
    assert np.mean([got[1000 + i] for i in range(len(clean))]) >= 0.9


def test_awkward_rows_and_empty_tables(spark, awkward, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in nt.score_corpus(awkward, none).collect()} == {0.0}
    assert nt.score_corpus(no_docs, none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, 0, 1), (None, 1, 0), (7, 1, None), (1, 0, 1), (0, 1, 1), (3, 1, 0), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = nt.score_corpus(awkward, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in awkward_rows())
