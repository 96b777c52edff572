"""Exact search over cells with bounds, and the partitioned k-NN join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotbank.operators import ivf, pivot
from shotbank.operators.knn import knn, self_knn
from shotbank.sources import fixtures as fx
from tests.conftest import SF_MID


def _clouds(spark, n, d, clouds, seed, prefix, scale=1.0):
    """Vectors around a few centres; copies, zero vectors and ties among them."""
    centres = np.random.default_rng(7).normal(size=(clouds, d))
    rng = np.random.default_rng(seed)
    m = centres[rng.integers(clouds, size=n)] + rng.normal(scale=0.15, size=(n, d))
    m[:3] = 0
    m[3:6] = m[6]
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(x) for x in r * scale]) for i, r in enumerate(m)], "id string, embedding array<double>")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_join_is_exact(spark, metric):
    corpus = _clouds(spark, 900, 8, 30, 1, "v", 3.0)
    corpus = corpus.union(corpus.where("id < 'v0010'")).union(spark.createDataFrame([("none", None)], corpus.schema))
    queries = _clouds(spark, 60, 8, 30, 2, "q").withColumnRenamed("id", "query_id")
    queries = queries.union(queries.where("query_id < 'q0004'").withColumn("embedding", F.reverse("embedding"))).union(
        spark.createDataFrame([("null", None)], queries.schema))
    want = sorted(knn(queries, corpus, 4, metric).collect())
    for options in ({"n_pivots": 25, "part_bytes": 8 * 8 * 40}, {"n_pivots": 3, "nprobe": 2, "part_bytes": 8 * 8 * 7}, {}):
        info: dict = {}
        assert sorted(pivot.knn_join(queries, corpus, 4, metric, info=info, **options).collect()) == want, options
    assert pivot.knn_join(queries, corpus.limit(0), 4, metric).count() == pivot.knn_join(queries.limit(0), corpus, 4, metric).count() == 0


def test_bounds_leave_out_most_pairs(spark):
    corpus, queries = _clouds(spark, 1500, 8, 40, 1, "v"), _clouds(spark, 50, 8, 40, 2, "q").withColumnRenamed("id", "query_id").where("query_id > 'q0002'")
    info: dict = {}
    got = sorted(pivot.knn_join(queries, corpus, 5, n_pivots=60, part_bytes=8 * 8 * 100, info=info).collect())
    assert got == sorted(knn(queries, corpus, 5).collect())
    assert info["parts"] == 15 and info["visits"].value < 0.8 * 47 * 15 and info["scored"].value < 0.5 * 47 * 1500


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_no_vector_beats_its_cells_bound(metric):
    rng = np.random.default_rng(3)
    for _ in range(20):
        c, v, q = rng.normal(size=6), rng.normal(size=(30, 6)) * rng.uniform(0.1, 3, (30, 1)), rng.normal(size=(10, 6))
        n = np.sqrt((v * v).sum(1))
        cosine = (v @ c) / n / np.sqrt(c @ c)
        key = pivot.low_keys(q, c[None], *(np.array([x]) for x in (cosine.min(), n.min(), n.max(), np.sqrt(((v - c) ** 2).sum(1)).max())), metric)[:, 0]
        if metric == "l2":
            real = ((q[:, None] - v[None]) ** 2).sum(-1)
        else:
            real = -(q @ v.T) / (1 if metric == "ip" else np.outer(np.sqrt((q * q).sum(1)), n))
        assert (key <= real.min(1) + 1e-12).all()


def test_plan_ships_no_side(spark):
    corpus, queries = _clouds(spark, 200, 8, 5, 1, "v"), _clouds(spark, 20, 8, 5, 2, "q").withColumnRenamed("id", "query_id")
    plan = pivot.knn_join(queries, corpus, 3)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_index_search_has_full_recall(spark):
    """Two probes alone lose neighbours; with the bounds every hit of the exact search is found."""
    kb, q = fx.knowledge_base(spark, SF_MID), fx.query_batch(spark, SF_MID)
    cents = ivf.train_centroids(kb, seed=42)
    index = ivf.assign_cells(kb, cents)
    want = {tuple(r) for r in knn(q, kb, 5).collect()}
    probed = {tuple(r) for r in ivf.ivf_search(q, index, cents, 5, nprobe=2).collect()}
    bounded = {tuple(r) for r in ivf.bounded_search(q, index, cents, 5, nprobe=2).collect()}
    assert bounded == want
    hits = lambda rows: {(r[0], r[2]) for r in rows}
    assert len(hits(probed) & hits(want)) / len(want) < 1  # what the bounds are for


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_self_join_scores_each_pair_once(spark, metric):
    rows = _clouds(spark, 400, 8, 10, 1, "v").union(spark.createDataFrame([("none", None)], "id string, embedding array<double>"))
    rows = rows.union(rows.where("id < 'v0003' or id = 'v0100'")).repartition(3)
    want = sorted(knn(rows.withColumnRenamed("id", "query_id"), rows, 4, metric).collect())
    n = rows.where("embedding is not null").count()
    for tile_bytes in (8 * 8 * 60, 1 << 20):
        info: dict = {}
        assert sorted(self_knn(rows, 4, metric, tile_bytes=tile_bytes, info=info).collect()) == want
        assert info["pairs"].value == n * (n + 1) // 2
    assert self_knn(rows.limit(0), 4, metric).count() == 0


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_cells_by_descent_are_those_of_all_comparisons(spark, metric):
    vectors = _clouds(spark, 1200, 8, 60, 1, "v")
    cents = pivot.pivots(vectors.where("id > 'v0006'"), 250)
    cents = cents.union(cents.where("cell < 3").withColumn("cell", F.col("cell") + 250))  # ties go to the lower cell
    info: dict = {}
    got = {r.id: r.cell for r in ivf.assign_cells(vectors, cents, metric, info=info).collect()}
    want = {r.query_id: r.id for r in knn(vectors.withColumnRenamed("id", "query_id"), cents, 1, metric, corpus_id="cell", corpus_vec="centroid").collect()}
    assert len(want) >= 1197 and all(got[i] == c for i, c in want.items()) and all(got[i] == 0 for i in got if i not in want)
    if metric != "ip":  # an inner product grows with the centroid's norm, not only with the angle
        assert info["compared"].value < {"cosine": 0.4, "l2": 0.5}[metric] * 1200 * 253
    tiled = {r.id: r.cell for r in ivf.assign_cells(vectors, cents, metric, block_bytes=8 * 8 * 100).collect()}
    assert tiled == got


def test_bounds_are_held_a_bounded_number_at_a_time(monkeypatch):
    from shotbank.operators import knn as knn_op, pivot

    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(3000, 4)), rng.normal(size=(2500, 4))
    ids, cell = np.arange(3000), rng.integers(0, 700, 3000)
    sizes, keys = [], pivot.low_keys
    monkeypatch.setattr(pivot, "low_keys", lambda q, c, *rest: (sizes.append(len(q) * len(c)), keys(q, c, *rest))[1])
    for metric in ("ip", "cosine", "l2"):
        top, plain = knn_op.TopK(q, 3, metric), knn_op.TopK(q, 3, metric)
        pivot.visit_cells(top, q, c, ids, cell, metric)
        plain.add(c, ids)
        for x, y in zip(top.result(), plain.result()):
            assert (x == y).all()
    assert max(sizes) <= 1 << 20
