"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors whose cosine is at least c lie within a squared distance of t = 2 - 2c. An orthogonal rotation
keeps distances; cut into blocks, each with a budget proportional to its dimensions, two such vectors keep
within the budget of at least one block. Each block is range-joined on a grid over its first axes, and
the pairs that a block lets through are verified exactly in double precision.

A pair is judged in the first block that lets it through and in one cell of it, so nothing need be
removed later: every task returns, per vector, how many others it links with, and a spanning forest of the
links, never the links themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotbank.llm.common import components, forest, map_rows, written

MIN_COSINE = 0.93
BLOCKS = 8
#: Axes of a block that its grid is over.
GRID = 2
#: Vectors that one task compares with another such tile at a time; fuller cells are split into tiles.
TILE = 1500
#: Vectors that the rotation is fitted on (it only affects speed).
SAMPLE = 4096
SLACK = 1 + 1e-9


def blocks_of(d: int, blocks: int = BLOCKS) -> list[np.ndarray]:
    """Axes of each block: dealt in turn, so that each block gets some of the leading ones."""
    m = max(1, min(blocks, d // 2))
    return [np.arange(b, d, m) for b in range(m)]


def rotation(sample: np.ndarray) -> np.ndarray:
    """Principal axes of the sample, the widest first (orthogonal whatever the sample)."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, np.argsort(-values)]


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): each row with the hashes of its vector, and one row per distinct (label, vector).

    Rows that link with nothing (null id, label or vector, null or non-finite components, zero
    length) have null hashes.
    """
    e = F.col("embedding").cast("array<double>")
    fine = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
            & F.exists(e, lambda v: v != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.when(F.coalesce(fine, F.lit(False)), e).alias("v"))
    rows = rows.select("vec_id", "label", "v", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")).alias("h1"),
                       F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit("second"), "label")).alias("h2"))
    distinct = (rows.where("h1 is not null").groupBy("h1", "h2", "label", "v")
                .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    return rows.select("vec_id", "h1", "h2"), distinct


def _rotations(distinct: DataFrame, sample: int) -> dict[int, np.ndarray]:
    got = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for d, vs in by.items():
        x = np.array(vs)
        with np.errstate(over="ignore"):
            x = x / np.maximum(np.abs(x).max(1), 1e-300)[:, None]
        out[d] = rotation(x / np.sqrt((x * x).sum(1))[:, None])
    return out


def _place(shared, budget: float):
    """Copies of a vector: its home cell in each block, and the later neighbour cells within reach."""

    def run(cols: dict) -> dict:
        out = {k: [] for k in ("row", "d", "block", "cell", "home")}
        raw = []
        for i, v in enumerate(cols["v"]):
            x = v.values.to_numpy()
            x = x / np.abs(x).max()  # no square may overflow or vanish
            raw.append(x.tobytes())
            d = len(x)
            x = x / np.sqrt((x * x).sum())
            y = x @ shared.value.get(d, np.eye(d))
            for b, axes in enumerate(blocks_of(d)):
                reach = np.sqrt(budget * len(axes) / d) * SLACK
                width = 2 * reach
                p = y[axes[:GRID]]
                home = np.floor(p / width).astype(int)
                cells = [(0.0, ())]
                for c, at in zip(home, p):
                    near = [(max(0.0, c * width - at, at - (c + 1) * width) ** 2, (c,))]
                    near += [((at - c * width) ** 2, (c - 1,)), (((c + 1) * width - at) ** 2, (c + 1,))]
                    cells = [(s + q, k + j) for s, k in cells for q, j in near if s + q <= reach * reach * SLACK]
                mine = tuple(home)
                for _, cell in cells:
                    # a pair of two cells meets in the later one, which the vector of the earlier one is copied to
                    if cell >= mine:
                        out["row"].append(i)
                        out["d"].append(d)
                        out["block"].append(b)
                        out["cell"].append(",".join(map(str, cell)))
                        out["home"].append(cell == mine)
        take = pa.array(out.pop("row"), pa.int64())
        return {**out, "rep": cols["rep"].take(take), "n": cols["n"].take(take), "label": cols["label"].take(take),
                "raw": pa.array(raw, pa.binary()).take(take)}

    return run


def _judge(shared, budget: float, min_cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["t"] == rows["t1"]]
        right = left if rows["t1"].iloc[0] == rows["t2"].iloc[0] else rows[rows["t"] == rows["t2"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "low": []})
        b, d = int(rows["block"].iloc[0]), int(rows["d"].iloc[0])
        axes, turn = blocks_of(d), shared.value.get(d, np.eye(d))
        limits = [budget * len(a) / d * SLACK for a in axes]
        x, y = _unit(list(left["raw"])), _unit(list(right["raw"]))
        xr, yr = x @ turn, y @ turn
        u, v = xr[:, axes[b]], yr[:, axes[b]]
        near = (u * u).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * u @ v.T <= limits[b] + 1e-7
        near &= left["home"].to_numpy()[:, None] | right["home"].to_numpy()[None]
        if right is left:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        links = np.zeros(len(left) + len(right), np.int64)
        reps = np.concatenate([left["rep"].to_numpy(), right["rep"].to_numpy()])
        sizes = np.concatenate([left["n"].to_numpy(), right["n"].to_numpy()])
        low = np.arange(len(reps))
        heads, tails = [], []
        for a in range(0, len(i), 1 << 16):
            p, q = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
            diff = (xr[p] - yr[q]) ** 2
            mine = diff[:, axes[b]].sum(1) <= limits[b]
            for e in range(b):  # an earlier block that lets the pair through has judged it
                mine &= diff[:, axes[e]].sum(1) > limits[e]
            p, q = p[mine], q[mine]
            ok = (x[p] * y[q]).sum(1) >= min_cosine
            heads.append(p[ok])
            tails.append(q[ok] + len(left))
        if heads:
            p, q = np.concatenate(heads), np.concatenate(tails)
            np.add.at(links, p, sizes[q])
            np.add.at(links, q, sizes[p])
            low = forest(reps, p, q)
        some = links > 0
        return pd.DataFrame({"rep": reps[some], "links": links[some], "low": reps[low[some]]})

    return run


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is at least ``min_cosine``. Equal vectors
    are compared once, for all their rows. Rows that cannot link (see :func:`classes`) have 0 links
    and are their own component; a null vec_id gives a null component and isn't kept. Vectors of
    different lengths never link. Repeated rows count as vectors of their own. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, distinct = classes(vectors)
    distinct = written(distinct, "vectors")
    budget = 2 - 2 * min_cosine
    shared = spark.sparkContext.broadcast(_rotations(distinct, SAMPLE))
    copies = map_rows(distinct.select("rep", "n", "label", "v"), "rep long, n long, label string, d int, block int, "
                      "cell string, home boolean, raw binary", _place(shared, budget))
    copies = written(copies, "cells")
    key = ["label", "d", "block", "cell"]
    # a full cell is cut into tiles; each pair of tiles is a group of its own
    full = (copies.groupBy(*key).agg(F.count("*").alias("size"))
            .select(*(F.col(k).alias("k_" + k) for k in key), F.ceil(F.col("size") / tile).cast("int").alias("tiles"), "size")
            .where("size > 1"))
    t = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")
    tiled = (copies.join(full, [F.col(k) == F.col("k_" + k) for k in key]).select(*key, "home", "rep", "n", "raw", "tiles", t.alias("t"))
             .select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
             .select(*key, "home", "rep", "n", "raw", "t", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2")))
    found = written(tiled.groupBy(*key, "t1", "t2").applyInPandas(_judge(shared, budget, min_cosine),
                                                                 "rep long, links long, low long"), "links")
    links = found.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    # a class is known by its smallest id, which another class may have too if ids repeat
    known = (distinct.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "rep", "n")
             .join(links, F.col("rep") == F.col("r"), "left").join(comp, F.col("rep") == F.col("node"), "left")
             .select("g1", "g2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    return (rows.join(known, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept")))
