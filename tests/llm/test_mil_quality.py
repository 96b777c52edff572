import zlib

import numpy as np

from shotbank.llm import mil_quality
from shotbank.llm.common import table

from .conftest import awkward_rows


def test_held_out_accuracy(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in mil_quality.score_corpus(table(spark, base, "documents"), table(spark, base, "labels")).collect()}
    pairs = [(got[r["doc_id"]], r["quality"]) for r in table(spark, base, "labels").collect()]
    for g, _ in pairs:
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
        assert 0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.7)
    held = [(g["predicted"] == y) for g, y in pairs if g["held_out"]]
    assert len(held) > 50 and np.mean(held) >= 0.95


def test_scores_do_not_depend_on_neighbours_or_order():
    texts = [(r[1] or "").encode() for r in awkward_rows()]
    x, sizes = mil_quality.encode(texts)
    assert sizes.sum() == len(x) and (sizes > 0).all()
    for i, t in enumerate(texts):
        alone, n = mil_quality.encode([t])
        a = sizes[:i].sum()
        assert n[0] == sizes[i] and np.allclose(alone, x[a:a + sizes[i]])


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 3, 2])
    x, y, w = rng.normal(size=(6, 5)), np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0, 0.5])
    m = mil_quality.Model(x)

    def loss():
        s, _ = m.forward(x, sizes)
        penalty = sum((v ** 2).sum() for v in m.p.values()) * mil_quality.DECAY / 2
        return -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / w.sum() + penalty

    g = m.gradients(x, sizes, y, w)
    for k, v in m.p.items():
        at = tuple(0 for _ in v.shape)
        old = v[at]
        v[at] = old + 1e-6
        up = loss()
        v[at] = old - 1e-6
        down = loss()
        v[at] = old
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5, k


def test_awkward_rows_and_empty_tables(spark, awkward, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in mil_quality.score_corpus(awkward, none).collect()} == {0.5}
    assert mil_quality.score_corpus(no_docs, none).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (8, 0, 0), (None, 1, 0), (7, None, 0), (1, 0, 1), (0, 1, 1), (3, 1, 0), (5, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = mil_quality.score_corpus(awkward, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in awkward_rows())
    model = mil_quality.train(awkward, labels)
    kept = mil_quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["predicted"])
