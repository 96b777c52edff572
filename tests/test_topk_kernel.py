"""The numpy top-k kernel against a brute-force sort, with heavy ties and many chunks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shotbank.operators import knn as K


@settings(max_examples=300, deadline=None)
@given(nq=st.integers(1, 6), nc=st.integers(1, 60), d=st.integers(1, 3), k=st.integers(1, 8),
       levels=st.integers(1, 3), chunk=st.integers(1, 17), seed=st.integers(0, 10_000),
       metric=st.sampled_from(["ip", "l2"]))
def test_topk_equals_brute_force(nq, nc, d, k, levels, chunk, seed, metric):
    rng = np.random.default_rng(seed)
    q = rng.integers(-levels, levels + 1, size=(nq, d)).astype(float)  # few distinct scores: many ties
    c = rng.integers(-levels, levels + 1, size=(nc, d)).astype(float)
    ids = np.array([f"id{rng.integers(0, 1000):03d}" for _ in range(nc)], dtype=object)
    old = K.TILE_ROWS
    K.TILE_ROWS = chunk  # force several tiles on both sides
    try:
        top = K.TopK(q, k, metric)
        top._merge_at = 1 + int(rng.integers(0, 20))  # merge at varying points
        top.add(c, ids)
        qpos, got_ids, got_scores, ranks = top.result(with_rank=True)
    finally:
        K.TILE_ROWS = old
    s = K.scores(q, c, metric)
    for i in range(nq):
        key = -s[i] if metric == "ip" else s[i]
        want = sorted(range(nc), key=lambda j: (key[j], ids[j]))[:k]
        mine = [j for j in range(len(qpos)) if qpos[j] == i]
        assert [got_ids[j] for j in mine] == [ids[j] for j in want]
        assert [ranks[j] for j in mine] == list(range(1, len(want) + 1))
        assert np.allclose([got_scores[j] for j in mine], [s[i, j] for j in want])
