"""k-NN properties, strategy agreement, edge cases and plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotbank.operators import ivf
from shotbank.operators.knn import knn
from shotbank.session import scratch_path
from shotbank.sources import fixtures as fx
from tests.conftest import SF_MID, SF_SMALL

STRATS = ["broadcast_queries", "broadcast_corpus"]


def _vecs(spark, n, d, seed, prefix="v"):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(x) for x in row]) for i, row in enumerate(m)],
                                 "id string, embedding array<double>"), m


def _brute(q, c, k, metric="ip"):
    s = q @ c.T if metric == "ip" else ((q[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    out = {}
    for i in range(len(q)):
        order = sorted(range(len(c)), key=lambda j: (-s[i, j] if metric == "ip" else s[i, j], j))
        out[i] = [(f"v{j:04d}", round(float(s[i, j]), 6)) for j in order[:k]]
    return out


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("strategy", STRATS)
def test_strategies_match_brute_force(spark, strategy, metric):
    corpus, c = _vecs(spark, 300, 16, 1)
    queries, q = _vecs(spark, 25, 16, 2, prefix="q")
    queries = queries.withColumn("query_id", F.monotonically_increasing_id()).select(
        F.substring("id", 2, 4).cast("long").alias("query_id"), "embedding")
    hits = knn(queries.repartition(3), corpus.repartition(9), 7, metric, strategy=strategy, block_rows=9)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    assert got == _brute(q, c, 7, metric)


def test_properties_and_ties(spark):
    # four identical vectors: equal scores are ordered by id
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("d", [1.0, 0.0]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "query_id long, embedding array<double>")
    for strategy in STRATS:
        hits = knn(queries, corpus, 10, strategy=strategy).orderBy("query_id", "rank").collect()
        q1 = [r.id for r in hits if r.query_id == 1]
        assert q1 == ["a", "b", "d", "c", "z"]  # k > n: fewer rows, never padding
        for qid in (1, 2):
            mine = [r for r in hits if r.query_id == qid]
            assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
            assert all(a.score >= b.score for a, b in zip(mine, mine[1:]))


def test_empty_sides_and_mixed_dimensions(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0])], "id string, embedding array<double>")
    empty_q = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert knn(empty_q, corpus, 3).count() == 0
    bad = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception):
        knn(bad, corpus, 3).collect()


def test_partition_count_does_not_change_result(spark):
    kb = fx.knowledge_base(spark, SF_SMALL)
    q = fx.query_batch(spark, SF_SMALL)
    a = knn(q, kb, 5).collect()
    b = knn(q.repartition(7), kb.repartition(5), 5).collect()
    assert sorted(a) == sorted(b)


def test_self_query_ranks_itself_first(spark):
    kb = fx.knowledge_base(spark, SF_SMALL)
    hits = knn(kb.select(F.col("id").alias("query_id"), "embedding"), kb, 1)
    assert hits.where(F.col("query_id") != F.col("id")).count() == 0


def test_ivf_full_probe_equals_exact(spark):
    kb = fx.knowledge_base(spark, SF_MID)
    q = fx.query_batch(spark, SF_MID)
    cents = ivf.label_centroids(fx.table(spark, SF_MID, "embeddings"))
    index = ivf.assign_cells(kb, cents)
    nlist = cents.count()
    exact = sorted(knn(q, kb, 5).collect())
    approx = sorted(ivf.ivf_search(q, index, cents, 5, nprobe=nlist, block_rows=7).collect())
    assert exact == approx


def test_plan_shapes(spark):
    kb = fx.knowledge_base(spark, SF_SMALL)
    q = fx.query_batch(spark, SF_SMALL)
    plan = knn(q, kb, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "Window" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cents = ivf.label_centroids(fx.table(spark, SF_SMALL, "embeddings"))
    iplan = ivf.ivf_search(q, ivf.assign_cells(kb, cents), cents, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in iplan and "BroadcastNestedLoopJoin" not in iplan
    assert "MapInArrow" in iplan and "CoGroups" not in iplan


def test_ivf_strategies_agree(spark):
    kb = fx.knowledge_base(spark, SF_MID)
    q = fx.query_batch(spark, SF_MID)
    cents = ivf.label_centroids(fx.table(spark, SF_MID, "embeddings"))
    index = ivf.assign_cells(kb, cents)
    for nprobe in (1, 3):
        shipped = ivf.ivf_search(q, index, cents, 5, nprobe=nprobe)
        blocked = ivf.ivf_search(q, index, cents, 5, nprobe=nprobe, block_rows=4)
        assert sorted(shipped.collect()) == sorted(blocked.collect())


def test_zero_vectors_and_empty_corpus(spark):
    from shotbank.functions.vectors import l2_normalize

    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "query_id long, embedding array<double>")
    got = {r.query_id: r.u for r in df.select("query_id", l2_normalize("embedding").alias("u")).collect()}
    assert got[1] is None and got[2] == [0.6, 0.8]
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "id string, embedding array<double>")
    hits = knn(df, corpus, 5, "cosine").collect()
    assert {(r.query_id, r.id) for r in hits} == {(2, "a")}  # zero vectors have no cosine
    empty = spark.createDataFrame([], "id string, embedding array<double>")
    for strategy in ("auto", "broadcast_corpus"):
        assert knn(df, empty, 3, strategy=strategy).count() == 0


def test_kernel_scores_equal_jvm_expressions(spark):
    """The numpy kernel's scores against the Column-expression dot / squared L2."""
    from shotbank.functions.vectors import dot, sq_l2

    kb = fx.knowledge_base(spark, SF_SMALL)
    q = fx.query_batch(spark, SF_SMALL)
    for metric, expr in (("ip", dot), ("l2", sq_l2)):
        hits = knn(q, kb, 3, metric)
        joined = (hits.join(q.select("query_id", F.col("embedding").alias("qv")), "query_id")
                  .join(kb.select("id", F.col("embedding").alias("cv")), "id")
                  .select("score", expr("qv", "cv").alias("jvm")))
        assert joined.where(F.abs(F.col("score") - F.col("jvm")) > 1e-9).count() == 0
        assert joined.count() == hits.count()


@pytest.mark.parametrize("metric", ["ip", "l2", "cosine"])
def test_all_plans_agree_on_awkward_data(spark, metric):
    """Repeated query ids, ties, exact copies, zero vectors and values around 1,000: the same rows from
    every plan and block size, and from the index with all cells probed."""
    rng = np.random.default_rng(7)
    base = np.round(rng.normal(size=(60, 6)) * 1000, 3)
    base[10:20] = base[:10]
    base[20] = 0
    corpus = spark.createDataFrame([(f"v{i:03d}", [float(x) for x in r]) for i, r in enumerate(base)], "id string, embedding array<double>").repartition(5)
    q = np.concatenate([base[:12] * 1.5, base[30:36], rng.normal(size=(6, 6)), base[:2] * 1.5])
    ids = [0, 0, 1, 2, 3, 3, 3, *range(10, 10 + len(q) - 7)]
    queries = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in zip(ids, q)], "query_id long, embedding array<double>").repartition(3)
    want = None
    for strategy in ("auto", *STRATS):
        for rows in (None, 1, 7, 25):
            got = sorted(knn(queries, corpus, 3, metric, strategy=strategy, block_rows=rows).collect())
            want = want or got
            assert got == want, (strategy, rows)
    # brute force: the hits of all rows with the same id, ranked together
    pairs = {}
    for i, x in zip(ids, q):
        for j, y in enumerate(base):
            if metric == "cosine" and not (x.any() and y.any()):
                continue
            s = {"ip": (x * y).sum(), "l2": ((x - y) ** 2).sum(),
                 "cosine": 0 if metric != "cosine" else ((x / np.sqrt((x * x).sum())) * (y / np.sqrt((y * y).sum()))).sum()}[metric]
            pairs.setdefault(i, []).append((round(float(s) * (1 if metric == "l2" else -1), 9), f"v{j:03d}"))
    brute = sorted((i, r + 1, v) for i, p in pairs.items() for r, (_, v) in enumerate(sorted(p)[:3]))
    assert [(r.query_id, r.rank, r.id) for r in want] == brute
    cents = spark.createDataFrame([(c, [float(x) for x in base[40 + c]]) for c in range(7)], "cell int, centroid array<double>")
    index = ivf.assign_cells(corpus, cents, metric)
    for rows in (None, 4):
        assert sorted(ivf.ivf_search(queries, index, cents, 3, nprobe=7, metric=metric, block_rows=rows).collect()) == want


def test_centroids_beyond_the_budget_give_the_same_cells(spark):
    corpus, _ = _vecs(spark, 120, 8, 5)
    cents, _ = _vecs(spark, 17, 8, 6)
    cents = cents.select(F.substring("id", 2, 4).cast("int").alias("cell"), F.col("embedding").alias("centroid"))
    whole = sorted(ivf.assign_cells(corpus, cents).collect())
    assert sorted(ivf.assign_cells(corpus, cents, block_bytes=3 * 8 * 8).collect()) == whole
    index = ivf.assign_cells(corpus, cents)
    q = corpus.limit(9).select(F.col("id").alias("query_id"), "embedding")
    assert sorted(ivf.ivf_search(q, index, cents, 4, nprobe=3, block_bytes=3 * 8 * 8).collect()) == sorted(
        ivf.ivf_search(q, index, cents, 4, nprobe=3).collect())


def test_index_lifecycle(spark, tmp_path):
    kb = fx.knowledge_base(spark, SF_MID).select("id", "embedding")
    with pytest.raises(FileNotFoundError):
        ivf.read_index(spark, str(tmp_path / "none"))
    kb.write.parquet(str(tmp_path / "stored"))
    cents, index = ivf.rebuild_index(spark, str(tmp_path / "stored"), str(tmp_path / "ix"), nlist=6)
    m = ivf.read_manifest(spark, str(tmp_path / "ix")).first()
    assert (m.index_type, m.metric, m.nlist, m.dimension, m.rows) == ("IndexIVFFlat", "ip", 6, 64, kb.count())
    assert index.count() == kb.count()
    import glob

    files = glob.glob(str(tmp_path / "ix" / "index" / "cell=*" / "*.parquet"))
    assert len(files) == index.select("cell").distinct().count()  # one file per cell, not tasks x cells
    split = ivf.write_index(index, str(tmp_path / "split"), file_rows=40)
    assert sorted(split.select("id", "cell").collect()) == sorted(index.select("id", "cell").collect())
    assert ivf.default_nlist(1_000_000) == 4000 and ivf.default_nlist(1_000_000, 100) == 100 and ivf.default_nlist(5) == 1


def test_large_query_side_keeps_few_candidates():
    from shotbank.operators.knn import TopK

    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(20_000, 16)), rng.normal(size=(800, 16))
    top = TopK(q, 5, "ip")
    for lo in range(0, 800, 100):
        top.add(c[lo:lo + 100], np.arange(lo, lo + 100).astype(str))
    top.result()
    assert top.kept <= 4 * 20_000 * 5  # eight offers of vectors in random order
    top = TopK(q, 5, "ip")
    top.add(c, np.arange(800).astype(str))
    top.result()
    assert top.kept <= 2 * 20_000 * 5


def test_sparse_vectors_in_every_plan(spark):
    from shotbank.operators import embed as emb

    kb = emb.lexical_vectors(fx.triplets(spark, SF_SMALL), "question", dim=128)
    q = emb.lexical_vectors(fx.table(spark, SF_SMALL, "benchmark").selectExpr("item_id as query_id", "text"),
                            "text", dim=128)
    want = sorted(knn(q, kb, 3, strategy="broadcast_queries").collect())
    for strategy in STRATS:
        got = sorted(knn(q, kb, 3, strategy=strategy, block_rows=7 if strategy == "broadcast_queries" else 50).collect())
        assert got == want, strategy
    hits = sorted(emb.lexical_search(q, kb, 3).collect())  # the join finds the same, but for hits of score 0
    assert hits == [r for r in want if r.score > 0]


def test_lexical_search_gives_no_filler(spark):
    from shotbank.operators import embed as emb

    rows = [(f"d{i:02d}", t) for i, t in enumerate(["a b", "a c", "a", "d d e", "", "a b a"])]
    kb = emb.lexical_vectors(spark.createDataFrame(rows, "id string, t string"), "t")
    q = emb.lexical_vectors(spark.createDataFrame([(1, "d"), (2, "a b"), (3, "nothing"), (4, "")], "query_id long, t string"), "t")
    got = sorted(emb.lexical_search(q, kb, 3).collect())
    assert [(r.query_id, r.rank, r.id) for r in got] == [(1, 1, "d03"), (2, 1, "d00"), (2, 2, "d05"), (2, 3, "d02")]
    assert emb.lexical_search(q, kb.limit(0), 3).count() == emb.lexical_search(q.limit(0), kb, 3).count() == 0


def _topics(spark, n, topics, seed, prefix):
    """Texts of a few topics with words of their own and a common word."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = rng.integers(topics)
        rows.append((f"{prefix}{i:05d}", " ".join(f"t{t}w{w}" for w in rng.integers(0, 12, 8)) + " the the"))
    return spark.createDataFrame(rows, "id string, text string")


def test_lexical_blocks_prune_and_lose_nothing(spark):
    from shotbank.operators import embed as emb
    from shotbank.operators import lexical

    kb = emb.lexical_vectors(_topics(spark, 3000, 40, 1, "d"), "text")
    kb = kb.union(kb.where("id < 'd00040'"))  # repeated rows are hits of their own
    q = emb.lexical_vectors(_topics(spark, 60, 40, 2, "q").withColumnRenamed("id", "query_id"), "text")
    want = sorted(r for r in knn(q, kb, 5).collect() if r.score > 0)
    info: dict = {}
    index = lexical.build_index(kb.repartition(5))
    assert sorted(lexical.search(q, index, 5, info=info).collect()) == want
    assert info["pairs"].value == 60 * 3040 and info["scored"].value < 0.3 * info["pairs"].value
    for options in ({"block_bytes": 8 * 1024 * 17}, {}):
        assert sorted(lexical.search(q, lexical.build_index(kb, block=7), 5, **options).collect()) == want
    one = index.selectExpr("size(ids) as n", "size(vectors) as v", "array_max(top.values) as w").collect()
    assert all(r.n == r.v <= lexical.BLOCK and 0 < r.w <= 1 for r in one) and sum(r.n for r in one) == 3040


def test_lexical_search_scores_few_pairs_in_double(spark, monkeypatch):
    """Copies beyond the k first by id are no hits, and exact scores are taken a bounded number of vectors at a time."""
    from shotbank.operators import embed as emb, knn as knn_op, lexical

    rows = [(f"d{i:05d}", f"the same words w{i % 3}") for i in range(1500)]
    kb = emb.lexical_vectors(spark.createDataFrame(rows, "id string, text string"), "text")
    q = emb.lexical_vectors(spark.createDataFrame([(i, f"same w{i % 3}") for i in range(90)], "query_id long, text string"), "text")
    want = sorted(knn(q, kb, 5).collect())
    index = lexical.build_index(kb)
    assert sorted(lexical.search(q, index, 5).collect()) == want

    sizes, exact = [], knn_op.pair_scores
    monkeypatch.setattr(knn_op, "pair_scores", lambda a, b, metric: (sizes.append(a.size), exact(a, b, metric))[1])
    qmat = knn_op.arrow_matrix(q.toArrow().column("embedding"))
    top = knn_op.TopK(qmat, 5, "ip")
    for rb in index.toArrow().to_batches():
        lexical._visit(top, qmat.astype(np.float32), rb)
    assert top.kept < 90 * 1500 / 10 and max(sizes) <= 1 << 20
    top = knn_op.TopK(np.ones((2000, 1024)), 3, "ip")
    top.add(np.ones((200, 1024)), np.arange(200))
    assert max(sizes) <= 1 << 20 and top.result()[1][:3].tolist() == [0, 1, 2]


def test_lexical_search_scores_few_pairs_of_texts_without_topics(spark):
    """5,000 texts of one vocabulary, where nearly every block may hold a hit: searched in part first, then folded vectors rule
    out most pairs, and tasks return few rows. Some queries have no hit, no k hits, several forms or no id."""
    from shotbank.operators import embed as emb, lexical

    rng = np.random.default_rng(5)
    words = lambda n: " ".join(f"w{int(w)}" for w in np.minimum(rng.zipf(1.3, n), 3000))
    rows = [(f"d{i:05d}", words(25)) for i in range(5000)]
    kb = emb.lexical_vectors(spark.createDataFrame(rows + [(f"e{i}", rows[i][1]) for i in range(40)] + [("only", "zzz")], "id string, text string"), "text")
    asked = [(i, words(12)) for i in range(80)] + [(3, words(12)), (90, "yyyy xxxx"), (91, "zzz"), (92, rows[7][1]), (None, words(12)), (None, words(9))]
    q = emb.lexical_vectors(spark.createDataFrame(asked, "query_id long, text string"), "text")
    key = lambda r: (r.query_id is not None, r.query_id or 0, r.rank)
    want = sorted((r for r in knn(q, kb, 5).collect() if r.score > 0), key=key)
    path = scratch_path(spark, "index")
    lexical.build_index(kb).write.parquet(path)
    index = spark.read.parquet(path)
    assert index.count() > 256
    info: dict = {}
    found = lexical.search(q, index, 5, info=info)
    assert sorted(found.collect(), key=key) == want
    assert info["pairs"].value == len(asked) * 5041 and info["scored"].value < 0.2 * info["pairs"].value
    assert sorted(lexical.search(q, index, 5, block_bytes=8 * 1024 * 30).collect(), key=key) == want


def test_self_join_has_a_partition_for_few_tile_pairs(spark, monkeypatch):
    from shotbank.operators import knn as knn_op

    monkeypatch.setattr(knn_op, "MEET_ROWS", 10)
    rng = np.random.default_rng(3)
    rows = [(i, f"v{i % 90:03d}", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(95)]
    df = spark.createDataFrame(rows, "pos long, id string, embedding array<double>")
    got = knn_op.self_knn(df, 3, query_id="pos")
    assert "hashpartitioning(_a" in got._jdf.queryExecution().toString() and ", 55)" in got._jdf.queryExecution().toString()
    assert sorted(got.collect()) == sorted(knn(df.withColumnRenamed("pos", "query_id"), df, 3).collect())
