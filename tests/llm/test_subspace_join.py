import math
import random

import numpy as np
import pytest

from shotbank.llm import subspace_join


def brute(rows):
    def unit(e):
        ok = e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e)
        return np.array(e, float) / np.linalg.norm(e) if ok else None

    n, low = [0] * len(rows), list(range(len(rows)))
    units = [unit(r[1]) if r[0] is not None and r[2] is not None else None for r in rows]
    edges = []
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] >= 0.93:
                    n[i] += 1
                    n[j] += 1
                    edges.append((i, j))
    changed = True
    ids = [r[0] for r in rows]
    while changed:
        changed = False
        for i, j in edges:
            m = min(ids[i], ids[j])
            changed |= ids[i] != m or ids[j] != m
            ids[i] = ids[j] = m
    return sorted(((r[0], k, c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, n, ids)), key=str)


def vectors(count=160, d=16, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.normal(size=(12, d))
    for i in range(count):
        c = centres[i % 12] + rng.normal(size=d) * rng.choice([0.0, 0.05, 0.25, 0.4])
        out.append((i, [float(np.float32(x)) for x in c * rng.choice([1, 3])], int(i % 12 % 3)))
    return out


AWKWARD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None] + [0.0] * 14, 1), (903, [float("nan")] + [1.0] * 15, 1),
           (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1.0] * 16, None), (907, [1.0] * 16, None),
           (None, [1.0] * 16, 2), (908, [1.0] * 16, 2), (909, [2.0] * 16, 2), (910, [1.0, 1.0], 2), (911, [1.0], 2), (912, [3.0], 2),
           (908, [1.0] * 16, 2)]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("tile", [subspace_join.TILE, 7])
def test_links_and_components_match_brute_force(spark, tile):
    rows = vectors() + AWKWARD
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rep", "2 as n_links", "3 as h1")
    got = subspace_join.near_duplicates(df, tile=tile).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert subspace_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_keep_the_pigeonhole():
    rng = random.Random(1)
    for d in (1, 2, 5, 16, 64, 100):
        axes = subspace_join.blocks_of(d)
        assert sorted(np.concatenate(axes)) == list(range(d))
        x, y = np.array([rng.gauss(0, 1) for _ in range(d)]), np.array([rng.gauss(0, 1) for _ in range(d)])
        total = ((x - y) ** 2).sum()
        assert any(((x - y)[a] ** 2).sum() <= total * len(a) / d * subspace_join.SLACK for a in axes)
