"""Exact k-nearest-neighbour search between a table of queries and a table of vectors.

Output: one row per (query, hit) - ``query_id, rank, id, score`` - with the best
``k`` hits of every query, ranked by score (descending for ``ip`` / ``cosine``,
ascending squared distance for ``l2``), ties broken by ``id`` ascending. Scores are
computed pair by pair in double precision and rounded to 12 decimals, so they do not
depend on how the tables are cut and identical vectors always tie.

Rows with the same ``query_id`` are one query asked in several forms: the hits of all
of them are ranked together. Every vector row is a hit of its own.

There is one physical plan: one side is shipped in blocks of at most ``block_bytes``
and the other side is scanned where it lies, once per block, without a shuffle. Each task
keeps a running top-k and emits at most ``k`` rows per query; one ``row_number`` window
(planned as WindowGroupLimit partial -> exchange -> final) merges them.

* ``broadcast_queries`` ships the queries, ``broadcast_corpus`` the vectors (e.g. IVF
  centroids); ``auto`` counts both sides and takes the one that scans fewer bytes.
* A side of several blocks is written once with its block number and fetched block by block,
  so the driver and the tasks hold one block at a time.

No plan materialises all (query, vector) pairs as rows: candidates come from a numpy
matrix product inside a task, and only top-k candidates leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotbank.session import scratch_path, ship_package

# bytes of float64 matrix that are shipped at a time
BROADCAST_BYTES = 128 * 1024 * 1024
# rows per side of one score matrix held at a time
TILE_ROWS = 2048
# numbers of either side of the pairs that are scored exactly at a time
_PAIR_NUMBERS = 1 << 20
# scores are rounded to this many decimals before ranking
SCORE_DECIMALS = 12
# rows of a tile of a self join: a task compares two of them
MEET_ROWS = 16384
# a self join's tile pairs are dealt into so many partitions at most
_PARTITIONS = 10_000
# hits are shipped to the metadata scan up to this many bytes
HIT_BYTES = 32 * 1024 * 1024
_HIT_ROW = 64

_HIGHER_BETTER = {"ip": True, "cosine": True, "l2": False}


# ---------------------------------------------------------------- numpy kernel

def as_matrix(values) -> np.ndarray:
    """Stack a sequence of dense vectors into a float64 matrix."""
    vals = list(values)
    if not vals:
        return np.zeros((0, 0), dtype=np.float64)
    return np.stack([np.asarray(v, dtype=np.float64) for v in vals])


def arrow_matrix(col) -> np.ndarray:
    """float64 matrix from an Arrow column of vectors, without per-row objects.

    A vector is a list (dense) or a struct ``(size, indices, values)`` (sparse, e.g. lexical
    vectors; densified here, one batch at a time)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 0), dtype=np.float64)
    if pa.types.is_struct(col.type):
        size, indices, values = (col.field(f) for f in ("size", "indices", "values"))
        lengths = np.diff(indices.offsets.to_numpy())
        m = np.zeros((n, int(size[0].as_py())), dtype=np.float64)
        m[np.repeat(np.arange(n), lengths), indices.flatten().to_numpy()] = values.flatten().to_numpy()
        return m
    lengths = np.diff(col.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError(f"vector dimensions differ: {lengths.min()} vs {lengths.max()}")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, int(lengths[0]))


def arrow_batch(pdf: pd.DataFrame, schema: T.StructType):
    """pandas frame -> Arrow record batch with the Spark output schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pandas(pdf, schema=to_arrow_schema(schema), preserve_index=False)


def dim_of(df: DataFrame, vec: str):
    """Column giving a vector's dimension, dense (array size) or sparse (``size`` field)."""
    if isinstance(df.schema[vec].dataType, T.StructType):
        return F.col(vec)["size"]
    return F.size(vec)


def _check(q: np.ndarray, c: np.ndarray, metric: str) -> None:
    if metric not in _HIGHER_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    if q.shape[1] != c.shape[1]:
        raise ValueError(f"vector dimensions differ: {q.shape[1]} vs {c.shape[1]}")


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.sqrt((m * m).sum(1))[:, None]


def pair_scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs (q[i], c[i]), each from its two rows alone. ``cosine`` takes unit rows."""
    out = np.empty(len(q))
    for part in _pair_parts(len(q), q.shape[1]):
        a, b = q[part], c[part]
        out[part] = ((a - b) ** 2).sum(1) if metric == "l2" else (a * b).sum(1)
    return np.round(out, SCORE_DECIMALS)


def _pair_parts(n: int, d: int) -> Iterator[slice]:
    step = max(1, _PAIR_NUMBERS // max(d, 1))
    return (slice(lo, lo + step) for lo in range(0, n, step))


def scores(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """All scores between two matrices (small inputs; the kernel scores candidates only)."""
    _check(q, c, metric)
    if metric == "cosine":
        q, c = _unit(q), _unit(c)
    i, j = np.divmod(np.arange(len(q) * len(c)), len(c))
    return pair_scores(q[i], c[j], metric).reshape(len(q), len(c))


def _sort_key(s: np.ndarray, metric: str) -> np.ndarray:
    key = -s if _HIGHER_BETTER[metric] else s.copy()
    key[np.isnan(key)] = np.inf
    return key


def select_topk(qpos: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int):
    """Indices of the first ``k`` entries per ``qpos`` ordered by (key, id), and their ranks."""
    if len(qpos) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    id_rank = np.unique(ids, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((id_rank, key, qpos))
    qs = qpos[order]
    starts = np.r_[0, np.flatnonzero(qs[1:] != qs[:-1]) + 1]
    lengths = np.diff(np.r_[starts, len(qs)])
    within = np.arange(len(qs)) - np.repeat(starts, lengths)
    keep = within < k
    return order[keep], within[keep] + 1


def approximate_keys(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs by a matrix product, and per row of ``q`` how far rounding may move them. ``cosine`` takes unit rows."""
    key = q @ c.T
    size_q, size_c = (q * q).sum(1), (c * c).sum(1)
    if metric == "l2":
        key = size_q[:, None] + size_c[None, :] - 2.0 * key
    else:
        key = -key
    key[np.isnan(key)] = np.inf
    with np.errstate(invalid="ignore"):
        scale = np.nan_to_num(size_q) + np.nan_to_num(size_c).max(initial=0.0)
    return key, 1e-13 * len(q[0]) * scale + 2 * 10.0 ** -SCORE_DECIMALS


class TopK:
    """Running top-k per query over successive blocks of vectors.

    Both sides are cut into tiles. In a tile a matrix product gives approximate keys; only
    pairs that reach the query's k-th best key so far (or, before there is one, the tile's own
    k-th), with a margin for the product's rounding, are scored exactly. Candidates are merged
    whenever as many wait as the answer holds.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.k, self.metric = k, metric
        self.q = _unit(q) if metric == "cosine" else q
        n = q.shape[0]
        self.kth = np.full(n, np.inf)
        self.qpos = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=object)
        self.score = np.zeros(0, dtype=np.float64)
        self.key = np.zeros(0, dtype=np.float64)
        self.kept = 0  # candidates that were scored exactly
        self._pending: list[tuple] = []
        self._pending_n = 0
        self._merge_at = max(n * k, 1)

    def add(self, c: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Offer vectors to all queries, or to those at ``rows``."""
        rows = np.arange(len(self.q)) if rows is None else rows
        if len(rows) == 0 or len(c) == 0:
            return
        _check(self.q, c, self.metric)
        c = _unit(c) if self.metric == "cosine" else c
        for lo in range(0, len(c), TILE_ROWS):
            for qlo in range(0, len(rows), TILE_ROWS):
                self._tile(rows[qlo:qlo + TILE_ROWS], c[lo:lo + TILE_ROWS], ids[lo:lo + TILE_ROWS])
            self.merge()

    def merge(self, share: float = 1.0) -> None:
        """Merge what waits if it is as much as the answer holds, or this share of it."""
        if self._pending_n >= share * self._merge_at:
            self._flush()

    def _tile(self, rows: np.ndarray, c: np.ndarray, ids: np.ndarray) -> None:
        q = self.q[rows]
        self.pick(rows, c, ids, *approximate_keys(q, c, self.metric))

    def pick(self, rows: np.ndarray, c: np.ndarray, ids: np.ndarray, key: np.ndarray, margin: np.ndarray) -> None:
        """Score exactly what may be a hit, given approximate keys of the queries at ``rows`` with ``c``."""
        limit = self.kth[rows]
        new = ~np.isfinite(limit)
        if new.any() and key.shape[1] > self.k:
            limit[new] = np.partition(key[new], self.k - 1, axis=1)[:, self.k - 1]
        bar = limit + margin
        if key.dtype == np.float32:  # compared as they are, rounded up
            bar = np.nextafter(bar.astype(np.float32), np.float32(np.inf))
        near = key <= bar[:, None]
        if not np.isfinite(limit).all():
            near &= np.isfinite(key)
        i, j = np.nonzero(near)
        if len(i) > 4 * len(rows) * self.k:
            i, j = self._nearest(i, j, key, margin)
        self.kept += len(i)
        for lo in range(0, len(i), TILE_ROWS * 512):  # bounded, however many tie
            a, b = i[lo:lo + TILE_ROWS * 512], j[lo:lo + TILE_ROWS * 512]
            s = self._exact(self.q, c, rows[a], b)
            exact = _sort_key(s, self.metric)
            ok = exact <= limit[a] + 10.0 ** -SCORE_DECIMALS + margin[a]
            a, b, s, exact = a[ok], b[ok], s[ok], exact[ok]
            if len(a) > 4 * len(rows) * self.k:
                keep, _ = select_topk(a, ids[b], exact, self.k)
                a, b, s, exact = a[keep], b[keep], s[keep], exact[keep]
            self._pending.append((rows[a], ids[b].astype(object), s, exact))
            self._pending_n += len(a)

    def offer(self, i: np.ndarray, c: np.ndarray, ids: np.ndarray, j: np.ndarray, score: np.ndarray, margin: np.ndarray) -> None:
        """Score exactly the pairs (query i, row j of ``c``), i in order, that may be hits by their approximate scores (``ip``)."""
        if len(i) > 4 * len(np.unique(i)) * self.k:
            near = self._first(i, -score, margin)
            i, j = i[near], j[near]
        self.kept += len(i)
        for lo in range(0, len(i), TILE_ROWS * 512):
            a, b = i[lo:lo + TILE_ROWS * 512], j[lo:lo + TILE_ROWS * 512]
            s = self._exact(self.q, c, a, b)
            self._pending.append((a, ids[b].astype(object), s, _sort_key(s, self.metric)))
            self._pending_n += len(a)

    def _nearest(self, i, j, key, margin) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j), i in order, those that rounding leaves within the ``k`` best of their query here."""
        ok = self._first(i, key[i, j].astype(np.float64), margin)
        return i[ok], j[ok]

    def _first(self, i, near, margin) -> np.ndarray:
        """Which of the pairs of queries i, in order, with approximate keys ``near`` these are."""
        order = np.lexsort((near, i))
        starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        last = np.minimum(starts + self.k, np.append(starts[1:], len(i))) - 1
        full = np.diff(np.append(starts, len(i))) > self.k
        bar = np.where(full, near[order[last]] + 2 * margin[i[starts]], np.inf)
        return near <= np.repeat(bar, np.diff(np.append(starts, len(i))))

    def _exact(self, q, c, a, b) -> np.ndarray:
        out = np.empty(len(a))
        for part in _pair_parts(len(a), c.shape[1]):
            out[part] = pair_scores(q[a[part]], c[b[part]], self.metric)
        return out

    def take(self, other: TopK, first: int) -> None:
        """Merge the hits of ``other``, whose queries are those from ``first`` on; ``settle`` ends it."""
        qpos, ids, score = other.result()
        self._pending.append((qpos + first, ids, score, _sort_key(score, self.metric)))
        self._pending_n += len(qpos)

    def settle(self) -> None:
        """Merge what waits, so that ``kth`` holds each query's k-th best key so far."""
        self._flush()

    def _flush(self) -> None:
        if not self._pending:
            return
        parts = [(self.qpos, self.ids, self.score, self.key)] + self._pending
        qpos, ids, score, key = (np.concatenate([p[x] for p in parts]) for x in range(4))
        keep, rank = select_topk(qpos, ids, key, self.k)
        self.qpos, self.ids, self.score, self.key = qpos[keep], ids[keep], score[keep], key[keep]
        last = rank == self.k
        at = self.qpos[last]
        self.kth[at] = np.minimum(self.kth[at], self.key[last])  # it may begin with a bound known before
        self._pending, self._pending_n = [], 0

    def result(self, with_rank: bool = False):
        self._flush()
        keep, rank = select_topk(self.qpos, self.ids, self.key, self.k)
        out = (self.qpos[keep], self.ids[keep], self.score[keep])
        return out + (rank,) if with_rank else out


# ---------------------------------------------------------------- Spark plan

def hit_schema(qid_type, cid_type) -> T.StructType:
    return T.StructType([T.StructField("query_id", qid_type), T.StructField("id", cid_type),
                         T.StructField("score", T.DoubleType())])


def hit_frame(qids, qpos, ids, score) -> pd.DataFrame:
    return pd.DataFrame({"query_id": qids[qpos] if len(qpos) else qids[:0], "id": ids, "score": score})


def rank_candidates(cands: DataFrame, k: int, metric: str) -> DataFrame:
    """Global top-k per query over per-task candidates (at most k per query and task, and Spark
    limits each group again before the exchange)."""
    order = F.col("score").desc() if _HIGHER_BETTER[metric] else F.col("score").asc()
    w = Window.partitionBy("query_id").orderBy(order, F.col("id").asc())
    return (cands.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score"))


def rows_per_block(d: int, block_bytes: int = BROADCAST_BYTES) -> int:
    return max(1, block_bytes // (8 * max(d, 1)))


def side_sizes(df: DataFrame, vec: str) -> tuple[int, int]:
    """(rows, dimension) of a vector table, one distributed aggregate."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(dim_of(df, vec)).alias("d")).first()
    return int(row["n"] or 0), int(row["d"] or 0)


def fetch_blocks(side: DataFrame, n: int, rows: int) -> Iterator[pa.Table]:
    """The ``n`` rows of ``side`` in Arrow tables of about ``rows`` rows. More than one block: the
    side is written with a block number (so the numbers hold) and read block by block."""
    blocks = max(1, math.ceil(n / rows))
    if blocks == 1:
        yield side.toArrow()
        return
    path = scratch_path(side.sparkSession, "blocks")
    number = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
    side.withColumn("_block", number).write.partitionBy("_block").parquet(path)
    stored = side.sparkSession.read.schema(T.StructType([*side.schema.fields, T.StructField("_block", T.IntegerType())])).parquet(path)
    for b in range(blocks):
        yield stored.where(F.col("_block") == b).drop("_block").toArrow()


def present(df: DataFrame, vec: str):
    """A usable vector: not NULL, and for a sparse struct a non-NULL ``size``."""
    if isinstance(df.schema[vec].dataType, T.StructType):
        return F.col(vec)["size"].isNotNull()
    return F.col(vec).isNotNull()


def _empty(spark, qid_type, cid_type) -> DataFrame:
    return spark.createDataFrame([], "query_id {}, rank int, id {}, score double".format(
        qid_type.simpleString(), cid_type.simpleString()))


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "ip", *,
        query_id: str = "query_id", query_vec: str = "embedding",
        corpus_id: str = "id", corpus_vec: str = "embedding",
        strategy: str = "auto", block_bytes: int = BROADCAST_BYTES,
        block_rows: int | None = None, info: dict | None = None) -> DataFrame:
    """Exact top-k search. Returns (query_id, rank, id, score).

    The result is the same whatever ``strategy``, ``block_bytes`` and ``block_rows`` (rows of the
    shipped side per block, instead of bytes). ``info``, when given, receives the sizes and the plan
    (callers use ``max_hits`` as the proven bound of the hits).
    """
    if metric not in _HIGHER_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    if strategy not in ("auto", "broadcast_queries", "broadcast_corpus"):
        raise ValueError(f"unknown strategy {strategy!r}")
    spark = queries.sparkSession
    ship_package(spark)
    q = queries.where(present(queries, query_vec)).select(F.col(query_id).alias("_qid"), F.col(query_vec).alias("_vec"))
    c = corpus.where(present(corpus, corpus_vec)).select(F.col(corpus_id).alias("_cid"), F.col(corpus_vec).alias("_vec"))
    qid_type = queries.schema[query_id].dataType
    cid_type = corpus.schema[corpus_id].dataType
    info = {} if info is None else info
    if k <= 0:
        info.update(queries=0, strategy="empty", max_hits=0)
        return _empty(spark, qid_type, cid_type)
    nq, d = side_sizes(q, "_vec")
    nc = None
    rows = block_rows or rows_per_block(d, block_bytes)
    if strategy == "auto":
        strategy = "broadcast_queries"
        if nq > rows:
            nc, _ = side_sizes(c, "_vec")
            if math.ceil(nc / rows) * nq < math.ceil(nq / rows) * nc:
                strategy = "broadcast_corpus"
    if strategy == "broadcast_corpus" and nc is None:
        nc, _ = side_sizes(c, "_vec")
    info.update(queries=nq, strategy=strategy, max_hits=nq * k)
    if nq == 0 or nc == 0:
        return _empty(spark, qid_type, cid_type)

    schema = hit_schema(qid_type, cid_type)
    parts = []
    if strategy == "broadcast_queries":
        for block in fetch_blocks(q, nq, rows):
            parts.append(c.mapInArrow(_scan_vectors(spark.sparkContext.broadcast(
                (block.column("_qid").to_numpy(), arrow_matrix(block.column("_vec")))), k, metric, schema), schema))
    else:
        for block in fetch_blocks(c, nc, rows):
            parts.append(q.mapInArrow(_scan_queries(spark.sparkContext.broadcast(
                (block.column("_cid").to_numpy(), arrow_matrix(block.column("_vec")))), k, metric, schema), schema))
    cands = parts[0]
    for p in parts[1:]:
        cands = cands.union(p)
    return rank_candidates(cands, k, metric)


def _scan_vectors(shared, k: int, metric: str, schema: T.StructType):
    def run(batches):
        qids, qmat = shared.value
        top = TopK(qmat, k, metric)
        for rb in batches:
            if rb.num_rows:
                top.add(arrow_matrix(rb.column("_vec")), rb.column("_cid").to_numpy(zero_copy_only=False))
        yield arrow_batch(hit_frame(qids, *top.result()), schema)

    return run


def _scan_queries(shared, k: int, metric: str, schema: T.StructType):
    def run(batches):
        cids, cmat = shared.value
        for rb in batches:
            if rb.num_rows:
                top = TopK(arrow_matrix(rb.column("_vec")), k, metric)
                top.add(cmat, cids)
                yield arrow_batch(hit_frame(rb.column("_qid").to_numpy(zero_copy_only=False), *top.result()), schema)

    return run


def self_knn(vectors: DataFrame, k: int, metric: str = "ip", *, query_id: str = "id", id_col: str = "id", vec: str = "embedding",
             tile_bytes: int = 32 * 1024 * 1024, info: dict | None = None) -> DataFrame:
    """Exact top-k of every vector among all (itself included): (query_id, rank, id, score), as ``knn`` of the table
    with itself.

    Rows are dealt into tiles of about ``tile_bytes``, at most ``MEET_ROWS`` rows, and every two tiles meet once, in a
    partition of their own (or few): a task's work does not grow with the table. A score is computed once and offered to
    both of its vectors. Each row is sent once per tile; nothing passes the driver.
    ``info`` receives ``queries``, ``max_hits`` and the accumulator ``pairs`` of the scores computed."""
    if metric not in _HIGHER_BETTER:
        raise ValueError(f"unknown metric {metric!r}")
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.where(present(vectors, vec)).select(F.col(query_id).alias("query_id"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    n, d = side_sizes(rows, "vec")
    info = {} if info is None else info
    info.update(queries=n, max_hits=n * max(k, 0), strategy="tile pairs", pairs=spark.sparkContext.accumulator(0))
    schema = hit_schema(vectors.schema[query_id].dataType, vectors.schema[id_col].dataType)
    if not n or k <= 0:
        return _empty(spark, schema["query_id"].dataType, schema["id"].dataType)
    tiles = math.ceil(n / min(MEET_ROWS, rows_per_block(d, tile_bytes)))
    path = scratch_path(spark, "tiles")  # the tile of a row is drawn from its place, so it is written
    rows.withColumn("tile", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).cast("int")).write.parquet(path)
    dealt = spark.read.parquet(path).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = dealt.select("query_id", "id", "vec", "tile", F.least("tile", "_other").alias("_a"), F.greatest("tile", "_other").alias("_b"))
    # as many partitions as pairs: the default number would hold ever more of them
    dealt_pairs = pairs.repartition(min(tiles * (tiles + 1) // 2, _PARTITIONS), "_a", "_b")
    found = dealt_pairs.groupBy("_a", "_b").applyInArrow(_meet(k, metric, schema, info["pairs"]), schema)
    return rank_candidates(found, k, metric)


def _meet(k: int, metric: str, schema: T.StructType, counted):
    def run(rows: pa.Table) -> pa.Table:
        a, b = (rows.column(c)[0].as_py() for c in ("_a", "_b"))
        tile = rows.column("tile").to_numpy()
        m = arrow_matrix(rows.column("vec"))
        qids, ids = rows.column("query_id").to_numpy(), rows.column("id").to_numpy()
        top = TopK(m, k, metric)
        left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
        for lo in range(0, len(left), TILE_ROWS):
            x = left[lo:lo + TILE_ROWS]
            for at in range(lo if a == b else 0, len(right), TILE_ROWS):
                y = right[at:at + TILE_ROWS]
                same = a == b and at == lo
                approx, margin = approximate_keys(top.q[x], top.q[y], metric)
                counted.add(len(x) * (len(x) + 1) // 2 if same else len(x) * len(y))
                top.pick(x, top.q[y], ids[y], approx, margin)
                if not same:  # the same scores, for the other side
                    top.pick(y, top.q[x], ids[x], approx.T, np.full(len(y), margin.max(initial=0.0)))
                top.settle()
        return pa.Table.from_batches([arrow_batch(hit_frame(qids, *top.result()), schema)])

    return run


def attach(hits: DataFrame, vectors: DataFrame, id_col: str = "id",
           columns: tuple[str, ...] = ("question", "rationale", "answer", "task", "source"),
           max_rows: int | None = None, hit_bytes: int = HIT_BYTES) -> DataFrame:
    """Late materialisation: metadata joined to the (small) hit table after ranking.

    The hit table has at most k rows per query (``max_rows``, known from the search); if that many
    rows fit ``hit_bytes`` the hits are shipped and the wide metadata table is streamed without a
    shuffle; otherwise it is a shuffle join on id.
    """
    meta = vectors.select(F.col(id_col).alias("id"), *columns)
    side = F.broadcast(hits) if max_rows is not None and max_rows * _HIT_ROW <= hit_bytes else hits
    return side.join(meta, "id", "inner")
