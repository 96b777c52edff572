"""A stored index that is replaced, appended to and compacted without a moment at which it can't be read.

Layout under ``root``: ``data/batch=<name>/cell=<n>`` (vectors, one batch per write), ``centroids/<name>`` and
``commits/<version>``. A version is one small file that names its batches and centroids. It is created last and only if
it does not exist, so a job that is killed before leaves the version before it in force, and of two writers
that start from one version the second fails. Batches are never written again; ``vacuum`` deletes those that no
kept version names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotbank.operators.ivf import FILE_ROWS, assign_cells, deal_by_cell, train_centroids


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass(frozen=True)
class Version:
    """What a version consists of. ``rows`` and ``dimension`` are of all its batches."""

    version: int
    batches: tuple[str, ...]
    centroids: str
    metric: str
    nlist: int
    dimension: int
    rows: int


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, in order."""
    return sorted(int(n) for n in _names(spark, f"{root}/commits") if n.isdigit())


def _commit(spark: SparkSession, root: str, v: Version) -> Version:
    fs, path = _fs(spark, f"{root}/commits/{v.version:010d}")
    body = json.dumps(asdict(v)) + "\n"
    try:
        out = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            raise Conflict(f"version {v.version} of {root} exists") from e
        raise
    out.write(bytearray(body.encode()))
    out.close()
    return v


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version, the last one unless ``number`` is given; ``FileNotFoundError`` if there is none.

    A commit file whose line has no end was never finished; it is passed over."""
    for n in reversed(versions(spark, root)) if number is None else [number]:
        try:
            lines = spark.read.text(f"{root}/commits/{n:010d}", wholetext=True).collect()
        except AnalysisException as e:
            raise FileNotFoundError(f"index not found: {root} version {n}") from e
        if lines and lines[0][0].endswith("\n"):
            found = json.loads(lines[0][0])
            return Version(**{**found, "batches": tuple(found["batches"])})
    raise FileNotFoundError(f"index not found: {root}")


def load(spark: SparkSession, root: str, number: int | None = None) -> tuple[DataFrame, DataFrame, Version]:
    """(index(id, embedding, cell), centroids, version): the last version unless ``number`` is given."""
    v = version(spark, root, number)
    data = spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/batch={b}" for b in v.batches))
    return data.select("id", "embedding", F.col("cell").cast("int").alias("cell")), spark.read.parquet(f"{root}/centroids/{v.centroids}"), v


def _write(index: DataFrame, root: str, file_rows: int) -> str:
    name = uuid.uuid4().hex[:12]
    deal_by_cell(index, file_rows).write.partitionBy("cell").parquet(f"{root}/data/batch={name}")
    return name


def _counted(spark: SparkSession, root: str, v: Version) -> Version:
    data = spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/batch={b}" for b in v.batches))
    one = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    return replace(v, rows=int(one["n"]), dimension=int(one["d"] or 0))


def create(index: DataFrame, centroids: DataFrame, root: str, metric: str = "ip", file_rows: int = FILE_ROWS) -> Version:
    """Write ``index(id, embedding, cell)`` with its ``centroids(cell, centroid)`` as the next version; a version before
    it, if any, stays readable by its number."""
    spark = index.sparkSession
    name = uuid.uuid4().hex[:12]
    centroids.select(F.col("cell").cast("int").alias("cell"), "centroid").write.parquet(f"{root}/centroids/{name}")
    nlist = spark.read.parquet(f"{root}/centroids/{name}").count()
    known = versions(spark, root)
    v = Version((known[-1] if known else 0) + 1, (_write(index, root, file_rows),), name, metric, nlist, 0, 0)
    return _commit(spark, root, _counted(spark, root, v))


def append(vectors: DataFrame, root: str, id_col: str = "id", vec: str = "embedding", file_rows: int = FILE_ROWS) -> Version:
    """Add vectors: only they are read, given the cell of the nearest stored centroid and written as a batch. None: no
    new version."""
    spark = vectors.sparkSession
    v = version(spark, root)
    least, most = vectors.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if most is None:
        return v
    if (least, most) != (v.dimension, v.dimension):
        raise ValueError(f"vector dimensions differ: {least} to {most} vs {v.dimension}")
    cells = assign_cells(vectors, spark.read.parquet(f"{root}/centroids/{v.centroids}"), v.metric, id_col, vec)
    added = _write(cells, root, file_rows)
    alone = _counted(spark, root, replace(v, batches=(added,)))
    return _commit(spark, root, replace(v, version=v.version + 1, batches=(*v.batches, added), rows=v.rows + alone.rows))


def compact(spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> Version:
    """Write all batches as one; the rows and their cells stay as they are."""
    index, _, v = load(spark, root)
    if len(v.batches) == 1:
        return v
    return _commit(spark, root, replace(v, version=v.version + 1, batches=(_write(index, root, file_rows),)))


def rebuild(spark: SparkSession, root: str, nlist: int | None = None, seed: int = 42, max_nlist: int | None = None) -> Version:
    """Train centroids over all stored vectors and deal them anew. The version in force is read while the next is built."""
    index, _, v = load(spark, root)
    name = uuid.uuid4().hex[:12]
    train_centroids(index, nlist, seed, metric=v.metric, max_nlist=max_nlist).write.parquet(f"{root}/centroids/{name}")
    centroids = spark.read.parquet(f"{root}/centroids/{name}")
    batch = _write(assign_cells(index.select("id", "embedding"), centroids, v.metric), root, FILE_ROWS)
    return _commit(spark, root, replace(v, version=v.version + 1, batches=(batch,), centroids=name, nlist=centroids.count()))


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete versions but the last ``keep``, and batches and centroids that those don't name (left by killed jobs, too);
    returns what was deleted. Not while a writer is at work: its batch is not named yet."""
    numbers = versions(spark, root)
    kept = [version(spark, root, n) for n in numbers[-max(keep, 1):]]
    named = {f"data/batch={b}" for v in kept for b in v.batches} | {f"centroids/{v.centroids}" for v in kept}
    there = [f"data/{n}" for n in _names(spark, f"{root}/data")] + [f"centroids/{n}" for n in _names(spark, f"{root}/centroids")]
    gone = [f"commits/{n:010d}" for n in numbers[:-max(keep, 1)]] + [n for n in there if n not in named]
    for n in gone:
        fs, path = _fs(spark, f"{root}/{n}")
        fs.delete(path, True)
    return gone
