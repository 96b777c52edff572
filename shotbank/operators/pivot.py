"""Exact k-nearest-neighbour join over cells with triangle-inequality bounds; neither side passes the driver.

Every vector lies in the cell of a centroid (an IVF index, or pivots drawn from the corpus). A cell keeps how far its
vectors lie from the centroid - the widest angle and the norms for inner product and cosine, the radius for squared
distance - so the best score that any of them can have with a query is bounded by the query and the centroid alone.

1. Cells are packed into parts of bounded size (a hot cell is several parts).
2. Every query goes to the parts of its ``nprobe`` nearest cells; the k-th score found there is its threshold.
3. It then goes to the other parts that hold a cell whose bound reaches the threshold, and to no others.

Both steps are shuffle joins on (part, query tile), so a task holds one part and one tile of queries. Inside, cells are
visited in the order of their bounds, and those beaten by the running k-th score are left out. Only centroids are shipped.
The result is exact for every ``nprobe`` and packing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotbank.functions import vectors as V
from shotbank.operators.knn import (BROADCAST_BYTES, TopK, _empty, _sort_key, arrow_batch, arrow_matrix, fetch_blocks,
                                    hit_frame, hit_schema, knn, present, rank_candidates, rows_per_block, side_sizes)
from shotbank.session import scratch_path, ship_package

#: Bytes of float64 vectors in a part, and in a tile of queries.
PART_BYTES = 32 * 1024 * 1024
PIVOTS = 4096
#: Bounds that a task holds at a time.
BOUNDS = 1 << 20
_SLACK = 1e-9


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell_stats(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cell, centroid, cosine, low, high, radius, rows) of every cell that has vectors: the smallest cosine with the
    centroid, the smallest and largest norm, the largest distance. One aggregate; the vectors are not shuffled."""
    v, c = F.col("embedding").cast("array<double>"), F.col("centroid").cast("array<double>")
    far = F.sqrt(F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    norms = V.norm(v) * V.norm(c)
    one = index.join(centroids.select(F.col("cell").cast("int").alias("cell"), "centroid"), "cell").select(
        "cell", V.norm(v).alias("norm"), F.when(norms > 0, V.dot(v, c) / norms).alias("cosine"), far.alias("far"))
    stats = one.groupBy(F.col("cell").alias("_cell")).agg(
        F.min("cosine").alias("cosine"), F.min("norm").alias("low"), F.max("norm").alias("high"),
        F.max("far").alias("radius"), F.count(F.lit(1)).alias("rows"))
    return centroids.join(stats, F.col("cell").cast("int") == F.col("_cell")).select(
        F.col("_cell").alias("cell"), c.alias("centroid"), "cosine", "low", "high", "radius", "rows")


def low_keys(q: np.ndarray, c: np.ndarray, cosine: np.ndarray, low: np.ndarray, high: np.ndarray, radius: np.ndarray,
             metric: str) -> np.ndarray:
    """The least sort key (negative score, or squared distance) that a vector of each cell can have with each query."""
    dot = q @ c.T
    qn, cn = np.sqrt((q * q).sum(1))[:, None], np.sqrt((c * c).sum(1))[None, :]
    if metric == "l2":
        far = np.sqrt(np.maximum(qn * qn + cn * cn - 2 * dot, 0))
        slack = _SLACK * (1 + qn + cn + radius[None, :])
        return np.maximum(far - radius[None, :] - slack, 0) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(dot / (qn * cn), -1, 1))
    wide = np.arccos(np.clip(np.nan_to_num(cosine, nan=-1.0), -1, 1)) + 1e-7  # arccos is steep at 1
    best = np.cos(np.maximum(np.nan_to_num(angle, nan=0.0) - wide[None, :], 0))
    if metric == "cosine":
        return -best - _SLACK
    return -qn * np.where(best >= 0, high[None, :], low[None, :]) * best - _SLACK * (1 + qn * high[None, :])


def search(queries: DataFrame, index: DataFrame, cells: DataFrame, k: int, metric: str = "ip", nprobe: int = 1,
           query_id: str = "query_id", query_vec: str = "embedding", part_bytes: int = PART_BYTES,
           block_bytes: int = BROADCAST_BYTES, info: dict | None = None) -> DataFrame:
    """(query_id, rank, id, score): the exact top-k of ``index(id, embedding, cell)``; ``cells`` from :func:`cell_stats`.

    Rows with the same ``query_id`` are ranked together, as in ``knn``. ``info`` receives ``queries``, ``parts``,
    ``max_hits`` and the accumulators ``scored`` and ``visits`` ((query, vector) pairs compared, (query, part) pairs)."""
    spark = queries.sparkSession
    ship_package(spark)
    qid_type, cid_type = queries.schema[query_id].dataType, index.schema["id"].dataType
    info = {} if info is None else info
    q = queries.where(present(queries, query_vec)).select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("vec"))
    q = _written(q.withColumn("uid", F.monotonically_increasing_id()), "queries")
    nq, d = side_sizes(q, "vec")
    info.update(queries=nq, max_hits=nq * max(k, 0), strategy="partitioned",
                **{name: spark.sparkContext.accumulator(0) for name in ("scored", "visits")})
    rows = rows_per_block(d, part_bytes)
    # cells follow one another in parts; a window over one row per cell
    upto = F.sum("rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = _written(cells.withColumn("_upto", upto).select(
        *cells.columns, F.floor((F.col("_upto") - F.col("rows")) / rows).cast("int").alias("part"),
        F.floor((F.col("_upto") - 1) / rows).cast("int").alias("last_part")), "cells")
    nc, _ = side_sizes(cells, "centroid")
    if not nq or not nc or k <= 0:
        return _empty(spark, qid_type, cid_type)
    info["parts"] = cells.agg(F.max("last_part")).first()[0] + 1
    spread = F.pmod(F.xxhash64("id", "embedding"), F.col("last_part") - F.col("part") + 1).cast("int")
    vectors = (index.select("id", "embedding", F.col("cell").cast("int").alias("cell")).join(cells.select("cell", "part", "last_part"), "cell")
               .select("id", "embedding", "cell", (F.col("part") + spread).alias("part")))
    tiles = math.ceil(nq / rows)
    schema = hit_schema(qid_type, cid_type)

    def visit(places: DataFrame) -> DataFrame:
        """Hits of the queries in the parts of ``places(uid, part, kth)``."""
        asked = places.join(q, "uid").withColumn("tile", F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int"))
        asked = _written(asked, "asked")
        groups = asked.select(F.col("part").alias("in_part"), F.col("tile").alias("in_tile")).distinct()
        met = vectors.join(groups, F.col("part") == F.col("in_part"))
        kernel = _visit_part(k, metric, schema, info["scored"], info["visits"])
        return asked.groupBy("part", "tile").cogroup(met.groupBy("in_part", "in_tile")).applyInArrow(kernel, schema)

    if info["parts"] == 1:  # there is nothing that a bound could leave out
        everywhere = q.select("uid", F.lit(0).alias("part"), F.lit(None).cast("double").alias("kth"))
        return rank_candidates(visit(everywhere), k, metric)
    near = knn(q.select("uid", "vec"), cells.select(F.col("cell").alias("id"), "centroid"), nprobe, metric, query_id="uid",
               query_vec="vec", corpus_vec="centroid", strategy="broadcast_corpus", block_bytes=block_bytes)
    seeds = (near.select(F.col("query_id").alias("uid"), F.col("id").alias("cell")).join(cells.select("cell", "part", "last_part"), "cell")
             .select("uid", F.explode(F.sequence("part", "last_part")).alias("part")).distinct())
    seeds = _written(seeds.withColumn("kth", F.lit(None).cast("double")), "seeds")
    first = _written(visit(seeds), "hits")
    # a query's threshold is its k-th score so far
    kth = (rank_candidates(first, k, metric).where(F.col("rank") == k)
           .select(F.col("query_id").alias("_id"), F.col("score").alias("kth")))
    open_ = _written(q.join(kth, q["query_id"].eqNullSafe(F.col("_id")), "left").select("uid", "vec", "kth"), "open")
    rest = None
    for block in fetch_blocks(cells, nc, rows_per_block(d, block_bytes)):
        shared = spark.sparkContext.broadcast({n: block.column(n).to_numpy() for n in ("cosine", "low", "high", "radius", "part", "last_part")}
                                              | {"centroid": arrow_matrix(block.column("centroid"))})
        found = open_.mapInArrow(_open_parts(shared, metric), "uid long, part int, kth double")
        rest = found if rest is None else rest.union(found)
    rest = rest.join(seeds.select("uid", "part"), ["uid", "part"], "left_anti").distinct()
    return rank_candidates(first.union(visit(rest)), k, metric)


def _open_parts(shared, metric: str):
    """The parts with a cell that may hold a hit, for every query."""

    def run(batches):
        c = shared.value
        for rb in batches:
            if not rb.num_rows:
                continue
            q, kth = arrow_matrix(rb.column("vec")), rb.column("kth").to_numpy(zero_copy_only=False).astype(float)
            limit = _sort_key(kth, metric)
            step, parts = max(1, BOUNDS // len(c["part"])), int(c["last_part"].max()) + 1
            for lo in range(0, len(q), step):
                keys = low_keys(q[lo:lo + step], c["centroid"], c["cosine"], c["low"], c["high"], c["radius"], metric)
                i, j = np.nonzero(keys <= limit[lo:lo + step, None])
                many = c["last_part"][j] - c["part"][j] + 1
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pairs = np.unique(np.repeat((i + lo) * parts + c["part"][j], many) + at)
                who = pa.array(pairs // parts)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("uid").take(who), pa.array((pairs % parts).astype(np.int32)), rb.column("kth").take(who)],
                    names=["uid", "part", "kth"])

    return run


def _visit_part(k: int, metric: str, schema, scored, visits):
    def run(asked: pa.Table, vectors: pa.Table) -> pa.Table:
        q = arrow_matrix(asked.column("vec"))
        top = TopK(q, k, metric)
        top.kth = _sort_key(asked.column("kth").to_numpy().astype(float), metric)
        if vectors.num_rows and len(q):
            compared = visit_cells(top, q, arrow_matrix(vectors.column("embedding")),
                                    vectors.column("id").to_numpy(), vectors.column("cell").to_numpy(), metric)
            scored.add(compared)
            visits.add(len(q))
        return pa.Table.from_batches([arrow_batch(hit_frame(asked.column("query_id").to_numpy(), *top.result()), schema)])

    return run


def visit_cells(top: TopK, q: np.ndarray, c: np.ndarray, ids: np.ndarray, cell: np.ndarray, metric: str) -> int:
    """Each query meets the cell of the nearest centre, then those whose bound its k-th key so far doesn't beat. Centres
    and bounds are those of the vectors that are here. Returns how many pairs were compared. Queries go in turns whose
    bounds are at most ``BOUNDS``, however many cells and queries meet."""
    order = np.argsort(cell, kind="stable")
    c, ids, cell = c[order], ids[order], cell[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    norm = np.sqrt((c * c).sum(1))
    unit = c / np.where(norm > 0, norm, 1)[:, None] if metric != "l2" else c
    centre = np.add.reduceat(unit, starts, axis=0) / sizes[:, None]
    own = np.repeat(centre, sizes, axis=0)
    length = np.sqrt((own * own).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where((norm > 0) & (length > 0), (unit * own).sum(1) / length, np.where(norm > 0, -1.0, 1.0))
    radius = np.sqrt(((c - own) ** 2).sum(1))
    high, none = np.maximum.reduceat(norm, starts), np.zeros(len(starts))
    widest = (np.minimum.reduceat(cosine, starts), np.minimum.reduceat(norm, starts), high, np.maximum.reduceat(radius, starts))

    def visit(top: TopK, q: np.ndarray) -> int:
        keys = low_keys(q, centre, *widest, metric)
        best, compared = low_keys(q, centre, none + 1, high, high, none, metric).argmin(1), 0
        for first in (True, False):
            for x in np.argsort(keys.mean(0)) if not first else range(len(starts)):
                who = np.flatnonzero(((best == x) if first else (best != x)) & (keys[:, x] <= top.kth))
                if len(who):
                    here = slice(starts[x], starts[x] + sizes[x])
                    top.add(c[here], ids[here], who)
                    compared += len(who) * int(sizes[x])
            top.settle()
        return compared

    step = max(1, BOUNDS // len(starts))
    if len(q) <= step:
        return visit(top, q)
    compared = 0
    for lo in range(0, len(q), step):
        turn = TopK(q[lo:lo + step], top.k, metric)
        turn.kth = top.kth[lo:lo + step].copy()
        compared += visit(turn, q[lo:lo + step])
        top.take(turn, lo)
    return compared


def pivots(corpus: DataFrame, n: int, vec: str = "embedding", corpus_id: str = "id") -> DataFrame:
    """(cell, centroid): the ``n`` vectors of the smallest hash, drawn from all rows."""
    drawn = (corpus.where(present(corpus, vec)).select(F.col(vec).cast("array<double>").alias("centroid"), F.xxhash64(corpus_id).alias("_h"))
             .orderBy("_h", "centroid").limit(n))
    return drawn.select((F.row_number().over(Window.orderBy("_h", "centroid")) - 1).cast("int").alias("cell"), "centroid")


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", *, query_id: str = "query_id",
             query_vec: str = "embedding", corpus_id: str = "id", corpus_vec: str = "embedding", n_pivots: int | None = None,
             nprobe: int = 1, part_bytes: int = PART_BYTES, info: dict | None = None) -> DataFrame:
    """Exact top-k between two tables of any size: both are dealt by the pivots of the corpus (see :func:`search`).

    ``n_pivots``: 4 sqrt(rows), at most ``PIVOTS``, unless given; it changes the work, not the result."""
    from shotbank.operators.ivf import assign_cells, default_nlist

    n, _ = side_sizes(corpus.where(present(corpus, corpus_vec)), corpus_vec)
    cents = _written(pivots(corpus, n_pivots or min(default_nlist(n), PIVOTS), corpus_vec, corpus_id), "pivots")
    index = _written(assign_cells(corpus, cents, metric, corpus_id, corpus_vec), "dealt")
    return search(queries, index, cell_stats(index, cents), k, metric, nprobe, query_id, query_vec, part_bytes, info=info)
