"""Inverted-file (IVF) index: coarse cells, each vector stored in its nearest cell.

* ``train_centroids`` - k-means (``pyspark.ml``), by cosine for ``ip`` (unit centroids), by
  distance for ``l2``.
* ``label_centroids`` - mean vector per label: a deterministic centroid table.
* ``assign_cells``    - nearest centroid per vector; the centroid table is shipped in tiles of
  bounded size, the vectors pass through a narrow ``mapInArrow``.
* ``write_index`` / ``read_index`` - Parquet partitioned by ``cell``, with a manifest: a search
  reads only the cells its queries probe (partition pruning). A cell is written by as many
  tasks as its rows need, so there are neither tasks x cells small files nor one task per hot cell.
* ``bounded_search``  - exact top-k: the nearest cells, then those whose bound reaches the k-th hit.
* ``ivf_search``      - approximate: per query the ``nprobe`` nearest cells, then exact top-k inside them.
  Queries are shipped in blocks of bounded size with their cells; the index is scanned in place,
  pruned to the cells of the block, and a vector is scored only against the queries that probe its cell.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotbank.operators.knn import (BROADCAST_BYTES, TopK, _empty, approximate_keys, arrow_batch, arrow_matrix, fetch_blocks,
                                    hit_frame, hit_schema, knn, present, rank_candidates, rows_per_block,
                                    side_sizes)
from shotbank.session import scratch_path, ship_package

#: Vectors per cell that ``default_nlist`` aims at, and rows of a cell that one task writes.
CELL_ROWS = 10
FILE_ROWS = 1_000_000


def default_nlist(n: int, max_nlist: int | None = None) -> int:
    """One cell per ``CELL_ROWS`` vectors for small tables, about 4 sqrt(n) for large ones;
    ``max_nlist`` caps it (the reference's cap is 100)."""
    nlist = max(1, min(n // CELL_ROWS, math.ceil(4 * math.sqrt(n))))
    return min(nlist, max_nlist) if max_nlist else nlist


def train_centroids(vectors: DataFrame, nlist: int | None = None, seed: int = 42,
                    vec: str = "embedding", max_iter: int = 20, metric: str = "ip",
                    max_nlist: int | None = None) -> DataFrame:
    """(cell, centroid array<double>) from k-means over the vectors (distributed, iterative).

    For ``ip`` and ``cosine`` the clustering is by cosine and the centroids have unit length, so the
    nearest centroid by inner product is the nearest by angle; zero vectors, which have no direction,
    are left out of the training (``assign_cells`` still gives them a cell)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    col = F.col(vec).cast("array<double>")
    data = vectors.where(F.col(vec).isNotNull())
    if metric != "l2":
        data = data.where(F.exists(vec, lambda x: x != 0))
    data = data.select(array_to_vector(col).alias("features"))
    if nlist is None:
        nlist = default_nlist(data.count(), max_nlist)
    measure = "euclidean" if metric == "l2" else "cosine"
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="features", distanceMeasure=measure).fit(data)
    rows = []
    for i, c in enumerate(model.clusterCenters()):
        norm = np.sqrt((c * c).sum())
        rows.append((i, [float(x) for x in (c / norm if metric != "l2" and norm > 0 else c)]))
    return vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>")


def label_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """(cell, centroid): the mean vector of every label; cell = label.

    One partial aggregate per label (a mean vector per task): the shuffle does not grow with the vectors."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    data = vectors.where(F.col(vec).isNotNull()).select(F.col(label).cast("int").alias("cell"),
                                                        array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    return data.groupBy("cell").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid"))


def assign_cells(vectors: DataFrame, centroids: DataFrame, metric: str = "ip",
                 id_col: str = "id", vec: str = "embedding", block_bytes: int = BROADCAST_BYTES, info: dict | None = None) -> DataFrame:
    """(id, embedding, cell): the nearest centroid of every vector, ties to the lower cell.

    The centroids are a tree of two levels: about 2 sqrt(nlist) groups around some of them. A vector meets the groups'
    centres, the members of the nearest group, and those of other groups only if the triangle inequality doesn't
    rule them out, so the cell is that of a comparison with all, at less cost where vectors cluster.
    A centroid table of more than ``block_bytes`` is shipped in tiles; the best cell so far travels
    with the vectors, and the table is written between two tiles. ``info`` receives the accumulator ``compared``
    ((vector, centroid or centre) pairs)."""
    spark = vectors.sparkSession
    ship_package(spark)
    n, d = side_sizes(centroids, "centroid")
    out = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding")).where(
        F.col("embedding").isNotNull()).select("*", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("_key"))
    schema = out.schema
    compared = spark.sparkContext.accumulator(0)
    if info is not None:
        info["compared"] = compared
    side = centroids.select(F.col("cell").cast("int").alias("cell"), "centroid")
    for i, block in enumerate(fetch_blocks(side, n, rows_per_block(d, block_bytes))):
        if i:
            path = scratch_path(spark, "cells")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
        order = np.argsort(block.column("cell").to_numpy())
        cmat = arrow_matrix(block.column("centroid"))[order]
        shared = spark.sparkContext.broadcast((block.column("cell").to_numpy()[order], cmat, _groups(cmat, metric)))
        out = out.mapInArrow(_nearest(shared, metric, schema, compared), schema)
    return out.drop("_key")


def _groups(c: np.ndarray, metric: str) -> np.ndarray:
    """The group of each centroid: the nearest of about 2 sqrt(n) of them, taken at even steps."""
    heads = np.unique(np.linspace(0, len(c) - 1, max(1, math.ceil(2 * math.sqrt(len(c))))).astype(int)) if len(c) else np.zeros(0, int)
    out = np.zeros(len(c), np.int64)
    for lo in range(0, len(c), 4096):
        key, _ = approximate_keys(c[lo:lo + 4096], c[heads], "l2" if metric == "l2" else "ip")
        if metric != "l2":  # by angle
            size = np.sqrt((c[heads] * c[heads]).sum(1))
            key = key / np.where(size > 0, size, 1)
        out[lo:lo + 4096] = key.argmin(1)
    return out


def _nearest(shared, metric: str, schema: T.StructType, compared):
    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from shotbank.operators.pivot import visit_cells

        cells, cmat, groups = shared.value
        out_schema = to_arrow_schema(schema)
        for rb in batches:
            if not rb.num_rows:
                continue
            q = arrow_matrix(rb.column("embedding"))
            top = TopK(q, 1, metric)
            compared.add(visit_cells(top, q, cmat, cells, groups, metric) + len(q) * (int(groups.max()) + 1))
            qpos, ids, _ = top.result()
            best, key = np.full(rb.num_rows, -1), np.full(rb.num_rows, np.inf)
            best[qpos], key[qpos] = ids.astype(np.int64), top.key
            best[best < 0] = cells[0]  # no centroid is comparable (a zero vector by cosine): the lowest cell
            old_key = rb.column("_key").to_numpy(zero_copy_only=False)
            old = rb.column("cell").to_numpy(zero_copy_only=False)
            keep = ~np.isnan(old_key) & ((old_key < key) | ((old_key == key) & (old < best)))
            best, key = np.where(keep, old, best), np.where(keep, old_key, key)
            # id and vector pass through as Arrow arrays
            yield pa.RecordBatch.from_arrays(
                [rb.column("id"), rb.column("embedding"), pa.array(best.astype(np.int32)), pa.array(key)],
                schema=out_schema)

    return run


def deal_by_cell(index: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """The rows dealt by (cell, part) for writing: a cell has one part, and so one file, per ``file_rows`` rows."""
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_parts"))
    return (index.join(sizes, "cell")
            .withColumn("_part", F.pmod(F.xxhash64("id", "embedding"), F.col("_parts")).cast("int"))
            .repartition("cell", "_part").select(*index.columns))


def write_index(index: DataFrame, path: str, metric: str = "ip", nlist: int | None = None,
                file_rows: int = FILE_ROWS) -> DataFrame:
    """Write (id, embedding, cell) partitioned by cell under ``path/index`` and a one-row manifest
    (index_type, metric, nlist, dimension, rows) under ``path/manifest``; return the written table.

    Rows are dealt by (cell, part): a cell has one part per ``file_rows`` rows."""
    spark = index.sparkSession
    deal_by_cell(index, file_rows).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/index")
    stored = _load(spark, f"{path}/index")
    manifest = stored.agg(F.lit("IndexIVFFlat").alias("index_type"), F.lit(metric).alias("metric"),
                          F.lit(nlist).cast("int").alias("nlist") if nlist is not None
                          else F.count_distinct("cell").cast("int").alias("nlist"),
                          F.max(F.size("embedding")).alias("dimension"), F.count(F.lit(1)).alias("rows"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return stored


def _load(spark, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"index not found: {path}") from e
        raise


def read_index(spark, path: str) -> DataFrame:
    """The index written under ``path``; ``FileNotFoundError`` if there is none."""
    return _load(spark, f"{path}/index")


def read_manifest(spark, path: str) -> DataFrame:
    return _load(spark, f"{path}/manifest")


def rebuild_index(spark, vectors_path: str, out: str, nlist: int | None = None, seed: int = 42,
                  metric: str = "ip", max_nlist: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-train centroids over stored vectors and overwrite ``out/centroids``, ``out/index`` and ``out/manifest``."""
    vectors = _load(spark, vectors_path)
    cents = train_centroids(vectors, nlist=nlist, seed=seed, metric=metric, max_nlist=max_nlist)
    cents.write.mode("overwrite").parquet(f"{out}/centroids")
    cents = spark.read.parquet(f"{out}/centroids")
    return cents, write_index(assign_cells(vectors, cents, metric), out, metric, cents.count())


def ivf_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int,
               nprobe: int = 1, metric: str = "ip", query_id: str = "query_id",
               query_vec: str = "embedding", block_bytes: int = BROADCAST_BYTES,
               block_rows: int | None = None, info: dict | None = None) -> DataFrame:
    """(query_id, rank, id, score): exact top-k among the vectors of the probed cells.

    Every query row probes its own cells; rows with the same id are ranked together, as in ``knn``. The
    result does not depend on ``block_bytes`` or ``block_rows``.
    """
    spark = queries.sparkSession
    ship_package(spark)
    qid_type, cid_type = queries.schema[query_id].dataType, index.schema["id"].dataType
    q = queries.where(present(queries, query_vec)).select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("embedding"))
    nq, d = side_sizes(q, "embedding")
    info = {} if info is None else info
    info.update(strategy="shipped", queries=nq, max_hits=nq * k)
    if nq == 0 or k <= 0:
        return _empty(spark, qid_type, cid_type)
    schema = hit_schema(qid_type, cid_type)
    cents = centroids.select(F.col("cell").cast("int").alias("id"), F.col("centroid").alias("embedding"))
    parts = None
    for block in fetch_blocks(q, nq, block_rows or rows_per_block(d, block_bytes)):
        qids, qmat = block.column("query_id").to_numpy(), arrow_matrix(block.column("embedding"))
        # the nearest cells of each row of the block, numbered by its place
        place = spark.createDataFrame(block.select(["embedding"]).append_column("n", [list(range(len(qids)))]))
        near = knn(place, cents, nprobe, metric, query_id="n", strategy="broadcast_corpus", block_bytes=block_bytes).toArrow()
        probes = np.stack([near.column("query_id").to_numpy(), near.column("id").to_numpy()], 1).astype(np.int64)
        cells = np.unique(probes[:, 1])
        shared = spark.sparkContext.broadcast((qids, qmat, probes))
        pruned = index.where(F.col("cell").isin([int(c) for c in cells])).select("id", "embedding", "cell")
        found = pruned.mapInArrow(_scan_cells(shared, k, metric, schema), schema)
        parts = found if parts is None else parts.union(found)
    return rank_candidates(parts, k, metric)


def bounded_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, nprobe: int = 1, metric: str = "ip",
                   query_id: str = "query_id", query_vec: str = "embedding", cells: DataFrame | None = None,
                   info: dict | None = None) -> DataFrame:
    """(query_id, rank, id, score): the exact top-k. ``cells`` are the index's ``pivot.cell_stats``, if they are stored
    with it; else they are computed. After the ``nprobe`` nearest cells a query visits just the others
    whose bound (from their widest angle or radius) reaches its k-th score; see :mod:`shotbank.operators.pivot`."""
    from shotbank.operators import pivot

    return pivot.search(queries, index, pivot.cell_stats(index, centroids) if cells is None else cells, k, metric, nprobe, query_id, query_vec, info=info)


def _scan_cells(shared, k: int, metric: str, schema: T.StructType):
    def run(batches):
        qids, qmat, probes = shared.value
        by = np.argsort(probes[:, 1], kind="stable")
        cells, first = np.unique(probes[by, 1], return_index=True)
        probing = dict(zip(cells.tolist(), np.split(probes[by, 0], first[1:])))
        top = TopK(qmat, k, metric)
        for rb in batches:
            if not rb.num_rows:
                continue
            c, ids = arrow_matrix(rb.column("embedding")), rb.column("id").to_numpy(zero_copy_only=False)
            cell = rb.column("cell").to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            here, at = np.unique(cell[order], return_index=True)
            for x, rows in zip(here.tolist(), np.split(order, at[1:])):
                if x in probing:
                    top.add(c[rows], ids[rows], np.sort(probing[x]))
        yield arrow_batch(hit_frame(qids, *top.result()), schema)

    return run
