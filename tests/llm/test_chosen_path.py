import random

import numpy as np
import pytest

from shotbank.llm import chosen_path

from .conftest import DOC_SCHEMA, awkward_rows, doc, words


def sets(rows):
    out = []
    for r in rows:
        w = (r[1] or "").lower().split()
        out.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute(rows):
    s = sets(rows)
    ids = [r[0] for r in rows]
    n, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-9:
                n[i] += 1
                n[j] += 1
                edges.append((i, j))
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            both = [x for x in (ids[i], ids[j]) if x is not None]
            m = min(both) if both else None
            changed |= ids[i] != m or ids[j] != m
            ids[i] = ids[j] = m
    return sorted(((r[0], c, k, r[0] == c) for r, k, c in zip(rows, n, ids)), key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    out, passage = [], words(rng, 60)
    for g in range(25):
        base = words(rng, rng.choice([4, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 5, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(["x1", "x2", "y3"])
            if g % 3 == 0:  # a passage that many unlike documents share
                t = t[:len(t) // 2] + passage + t[len(t) // 2:]
            out.append(doc(len(out), " ".join(t)))
    return out


def check(spark, rows, **options):
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), **options).drop("h1", "h2").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_matches_brute_force(spark):
    check(spark, corpus() + [(r[0] if r[0] is None else r[0] + 1000, *r[1:]) for r in awkward_rows()])


def test_split_buckets_and_tiles_lose_nothing(spark, monkeypatch):
    # buckets of more than 4 are split unless alike, groups of more than 3 are tiled
    monkeypatch.setattr(chosen_path, "SMALL", 4)
    check(spark, corpus(7), tile=3, runs=40)


def deep_corpus(n=1500, seed=11):
    """Texts of 12 of 30 long passages, so that buckets stay large over many splits, each with a near copy."""
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(5000)}" for _ in range(25)] for _ in range(30)]
    out = []
    for _ in range(n):
        base = [w for i in sorted(rng.sample(range(30), 12)) for w in pool[i]]
        copy = list(base)
        for at in rng.sample(range(len(copy)), 6):
            copy[at] = f"x{rng.randrange(10 ** 6)}"
        out.append((" ".join(base), " ".join(copy)))
    return out


def lost_pairs(spark, **options):
    """(lost, all) pairs of :func:`deep_corpus` that link by the whole sets and meet in no bucket."""
    memo = chosen_path._Hashes()
    pairs = [tuple(chosen_path.shingles(t, memo) for t in p) for p in deep_corpus()]
    pairs = [p for p in pairs if len(np.intersect1d(*p)) >= 0.8 * len(np.union1d(*p))]
    rows = [(2 * i + k, bytearray(chosen_path.embed(s).tobytes())) for i, p in enumerate(pairs) for k, s in enumerate(p)]
    classes = chosen_path.written(spark.createDataFrame(rows, "cid long, sk binary"), "deep")
    met = (chosen_path.buckets(classes, **options).selectExpr("key", "cid div 2 as pair", "cid").distinct()
           .groupBy("key", "pair").count().where("count = 2").select("pair").distinct().count())
    return len(pairs) - met, len(pairs)


@pytest.mark.parametrize("small", [64, chosen_path.SMALL])
def test_recall_in_deep_buckets(spark, monkeypatch, small):
    """Production parameters against the whole sets; with small buckets these sets go through many splits."""
    monkeypatch.setattr(chosen_path, "SMALL", small)
    lost, n = lost_pairs(spark)
    assert n > 1000 and lost <= 0.001 * n


def test_pairs_that_must_meet_at_the_greatest_depth():
    """Pairs at the threshold, followed to MAX_DEPTH through buckets that never become small."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.integers(1, 1 << 32, (n, chosen_path.BINS), np.uint32)
    y = np.where(rng.random(x.shape) < 0.8, x, rng.integers(1, 1 << 32, x.shape, np.uint32))
    met = np.zeros(n, bool)
    for seed in chosen_path.mix(np.arange(1, chosen_path.runs_for() + 1, dtype=np.uint64) * chosen_path._ODD).view(np.int64):
        at, key = np.arange(n), np.full(n, seed)
        for _ in range(chosen_path.MAX_DEPTH):
            both = []
            for z in (x, y):
                row, child = chosen_path.children(key, z[at])
                both.append(set(zip(at[row].tolist(), child.tolist())))
            both = sorted(both[0] & both[1])
            at, key = np.array([a for a, _ in both], np.int64), np.array([k for _, k in both], np.int64)
        met[at] = True
    assert met.mean() >= chosen_path.RECALL


def test_keep_first(spark, awkward):
    rows = awkward_rows()
    got = chosen_path.keep_first(awkward)
    assert got.columns == awkward.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    by_id = {(d, first) for d, c, k, first in brute(rows)}
    assert len(kept) == len(set(kept)) and {d for d, _ in kept} == {d for d, first in by_id if first}


def test_empty_table(spark, no_docs):
    assert chosen_path.near_duplicates(no_docs).count() == 0
    assert chosen_path.keep_first(no_docs).count() == 0


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.999, 1) == 7 and chosen_path.runs_for(0.999, 3) > chosen_path.runs_for(0.999, 2)
    assert chosen_path.runs_for() == chosen_path.runs_for(chosen_path.RECALL, chosen_path.MAX_DEPTH)
