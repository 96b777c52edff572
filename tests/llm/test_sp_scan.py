import random

import numpy as np
import pytest
import sentencepiece

from shotbank.llm import sp_scan

from .conftest import DOC_SCHEMA, awkward_rows, doc

ALPHABET = "abcdefghij  \n\t_-.,éüß门ข😀▁ⅷﬁ ́ABC0123 thetion"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp_scan.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return sp_scan.Vocabulary.load()


def texts():
    rng = random.Random(1)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return out + ["    a    b", " ", "\n\n", "<s>x</s>", "<0x0A>", "the" * 50, "x" * 300, " " * 40 + "y", "\x00", "a\u2581b"]


def test_units_match_the_library(library, vocabulary):
    for t in texts():
        ids = vocabulary.encode(sp_scan.normal(t)).tolist()
        assert ids == library.encode(t)
        assert vocabulary.decode(ids) == library.decode(ids)


def test_chunks_match_the_library(library, vocabulary):
    rng = random.Random(2)
    for t in texts() + ["abc" * 300, "the tion" * 99]:
        n, size, around = sp_scan.normal(t), rng.choice([17, 23, 60]), vocabulary.longest + 1
        if not n:
            continue
        parts, mats = [], []
        for a in range(0, len(n), size):
            b, at = min(len(n), a + size), max(0, a - around)
            p = n[at:b + around]
            parts.append((at, p))
            m = vocabulary.matrix(p, a - at, b - at, b == len(n))
            mats.append({((s[0] + at, s[1] + at), (u[0] + at, u[1] + at)): w for (s, u), w in m.items()})
        if len(mats) > 2:  # the product is associative
            a, b, c = mats[:3]
            assert sp_scan.product(sp_scan.product(a, b), c) == sp_scan.product(a, sp_scan.product(b, c))
        ids = [i for (at, p), (s, u) in zip(parts, sp_scan.scan(mats))
               for i in vocabulary.backtrace(p, (s[0] - at, s[1] - at), (u[0] - at, u[1] - at))]
        assert ids == library.encode(t)


@pytest.mark.parametrize("giant", [sp_scan.GIANT, 50])
def test_tables(spark, library, giant):
    rows = awkward_rows() + [doc(100 + i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 as ids", "2 as n_chunks")
    got = sp_scan.decode(sp_scan.encode(docs, giant=giant, chunk=40)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)
    for r in got:
        assert list(r["ids"]) == library.encode(r["text"] or "")
        assert r["decoded"] == library.decode(library.encode(r["text"] or ""))
        assert (r["n_chunks"] > 1) == (len(r["text"] or "") > max(giant, 39))
    digest = sp_scan.digest(sp_scan.encode(docs, giant=giant, chunk=40))
    assert digest.where("not round_trip").count() == sum("▁" in (r[1] or "") for r in rows)


def test_empty_table(no_docs):
    assert sp_scan.decode(sp_scan.encode(no_docs)).count() == 0 and sp_scan.digest(sp_scan.encode(no_docs)).count() == 0


def test_units_of_pieces_are_joined_from_packed_ids(vocabulary, monkeypatch):
    """Ids of a unit's pieces are not looked up and packed one by one."""
    units = ["▁the", "▁of", "▁and", "tion"]
    want = [[i for p in vocabulary.merged(u) for i in vocabulary.ids_of(p)] for u in units]
    monkeypatch.setattr(vocabulary, "ids_of", None)
    assert [np.frombuffer(vocabulary.encode_unit(u), np.int32).tolist() for u in units] == want


def test_new_units_are_encoded_together(vocabulary, monkeypatch):
    """As the definition has them, also ties, long units, unknown characters and units whose place was given up; plain ones
    are not encoded one by one."""
    rng = random.Random(3)
    units = list({"".join(rng.choice("▁thetionsabcéü00") for _ in range(rng.randint(1, 20))) for _ in range(3000)})
    odd = ["aaaaaaaa", "▁▁▁▁▁", "x" * 70, "th" * 40, "ข門😀the", "\x00", "ⅷab"]
    want = {u: b"".join(np.int32(i).tobytes() for p in vocabulary.merged(u) for i in vocabulary.ids_of(p)) for u in units + odd}
    assert vocabulary.encode_units(units + odd) == [want[u] for u in units + odd]
    monkeypatch.setattr(sp_scan, "REMEMBER", 500)
    monkeypatch.setattr(sp_scan, "BATCH", 200)
    v = sp_scan.Vocabulary.load()
    monkeypatch.setattr(v, "merged", None)
    words = ["".join(rng.choice("thetionsabc") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts_ = ["▁" + "▁".join(words[i:i + 300]) for i in range(0, 3000, 300)] * 2
    monkeypatch.setattr(sp_scan, "FEW", 0)
    got = v.encode_all(texts_)
    assert [x.tolist() for x in got] == [vocabulary.encode(t).tolist() for t in texts_]


def test_joins_of_a_small_vocabulary():
    """A piece may hold characters that are no pieces; scores may be equal."""
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ax", "ca", "aa"]
    v = sp_scan.Vocabulary(["<unk>", *pieces], [0.0, 0, 0, 0, -1, -1, -2, -3, -2, -1], ["unknown", *["piece"] * len(pieces)])
    rng = random.Random(4)
    units = list({"".join(rng.choice("abcax") for _ in range(rng.randint(1, 12))) for _ in range(2000)})
    want = [[i for p in v.merged(u) for i in v.ids_of(p)] for u in units]
    assert [np.frombuffer(x, np.int32).tolist() for x in v.encode_units(units)] == want
    assert sp_scan.Vocabulary(["<unk>"], [0.0], ["unknown"]).encode_units(["ab", "c"] * 50) == [np.int32(0).tobytes() * 2, np.int32(0).tobytes()] * 50
