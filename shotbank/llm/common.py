"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.session import drop_scratch, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also ships this package to the Python workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (cuts the lineage,
    and a lost executor never makes an earlier step run again)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`written`, in as many buckets by ``key`` as a shuffle has partitions: a join on ``key``
    shuffles only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    known = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").option("path", path).saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"drop table {known}")  # the name only; the files stay
    out._scratch = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables from :func:`written` that nothing will read any more."""
    for t in tables:
        drop_scratch(t.sparkSession, t._scratch)


#: Bytes of rows that a Python worker is sent at a time, about, where the session doesn't set it.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``.

    Spark's own bounds (10,000 rows, 64 MB) let the buffers of a few batches of texts take hundreds of MB in an
    executor and its workers, which keep them for later stages. A bound that the session has set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, schema: str, fn, slice_bytes: int | None = None) -> DataFrame:
    """``mapInArrow`` where ``fn(columns: dict of arrays) -> dict of lists`` works on one batch, or on
    parts of it of about ``slice_bytes``.

    The result holds only the columns of ``schema``."""
    from pyspark.sql.types import StructType

    names = df.columns
    struct = StructType.fromDDL(schema)
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b, slice_bytes)):
            out = fn({n: batch.column(i) for i, n in enumerate(names)})
            yield pa.RecordBatch.from_arrays(
                [out[f.name] if isinstance(out[f.name], pa.Array) and out[f.name].type == f.type
                 else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return in_batches(df, run, struct)


def _parts(batch: pa.RecordBatch, slice_bytes: int | None) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    step = n if not slice_bytes or not n else max(1, n * slice_bytes // max(1, batch.nbytes))
    for a in range(0, max(n, 1), max(step, 1)):
        yield batch.slice(a, step)


def keep_rows(df: DataFrame, needs: list[str], fn) -> DataFrame:
    """The rows of ``df``, all columns, for which ``fn(columns: dict of arrays) -> list of booleans`` holds.

    ``needs`` names the columns that ``fn`` sees."""
    places = [df.columns.index(n) for n in needs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(fn({n: batch.column(i) for n, i in zip(needs, places)}), pa.bool_()))

    return in_batches(df, run, df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _arrow_schema(struct) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


def held_out(id_col, mod: int, rest: int = 2):
    """crc32(id as text) mod ``mod`` is ``rest`` (a null id counts as the empty text)."""
    text = F.coalesce(id_col.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % mod) == rest


def forest(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For links between places p and q of ``ids``, the place each is led to: one place for every set that
    hangs together. An id that stands at several places counts as one."""
    _, first, back = np.unique(ids, return_index=True, return_inverse=True)
    same = first[back]
    p, q, low = same[p], same[q], same.copy()
    while True:
        before = low.copy()
        least = np.minimum(low[p], low[q])
        np.minimum.at(low, p, least)
        np.minimum.at(low, q, least)
        low = low[low]
        if (low == before).all():
            return low


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges(a, b)``.

    Alternating large-star / small-star rounds: every round is two aggregations over the edges.
    A star's centre may hold a large share of the edges, so neighbours are never collected: only
    ``min`` is taken, and the join back on the centre is one that Spark can split. Each round is
    written, so the plan stays short and a lost executor costs one round at most.
    """
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                .distinct(), "edges")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("c"), F.least("a", "m").alias("m"))
        # each larger neighbour of a centre is linked with the smallest node around that centre
        return (both.where("b > a").join(low, F.col("a") == F.col("c"))
                .select(F.col("m").alias("a"), "b").where("a <> b").distinct())

    def small_star(e: DataFrame) -> DataFrame:
        # e holds (smaller, larger); the centre is the larger one
        low = e.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("c"), "m")
        linked = e.join(low, F.col("b") == F.col("c"))
        return (linked.select(F.col("m").alias("a"), F.col("a").alias("b"))
                .union(low.select(F.col("m").alias("a"), F.col("c").alias("b")))
                .where("a <> b").distinct())

    before = None
    for _ in range(max_rounds):
        last, e = e, written(small_star(large_star(e)), "edges")
        dropped(last)
        # a fixed point: every larger node hangs on one centre, and no centre hangs on another
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: not settled; raise max_rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        e.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
