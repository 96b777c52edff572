"""Session helpers: one place for the settings every job relies on.

Nothing here is cluster specific. On a cluster the session already exists and
``spark.checkpoint.dir`` names the shared folder; locally (tests, bench) the
helpers fill in what is unset and leave everything that is set alone.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Spark already runs one task per core; numpy kernels inside Python workers
    # must not start a BLAS thread pool each on top of that
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def build_session(master: str | None = None, app_name: str = "shotbank",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a session with the library's defaults where nothing is set.

    What the caller asks for (``shuffle_partitions``, ``extra``) is set in any case. The defaults
    apply to a new session; of an active one, or of settings given to ``spark-submit``, none that is
    set is changed. A local session without ``spark.checkpoint.dir`` gets a folder of its own.
    """
    from pyspark import SparkConf

    asked = dict(extra or {})
    if shuffle_partitions:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    active = SparkSession.getActiveSession()
    builder = SparkSession.builder
    if active is None:
        given = SparkConf()  # spark-submit's and the environment's
        builder = builder.appName(app_name)
        if master:
            builder = builder.master(master)
        asked = {**{k: v for k, v in _DEFAULTS.items() if not given.contains(k)}, **asked}
    for key, value in asked.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if active is None:
        spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir(spark) is None and is_local(spark):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shotbank-ckpt-"))
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shotbank`` importable in the Python workers (like ``--py-files``).

    The kernels that run inside ``mapInArrow`` / ``applyInPandas`` refer to this
    package's functions, so the workers must be able to import it whatever the
    driver's working directory is. The package sources are zipped once per
    application on the driver and added with ``addPyFile``; Spark distributes
    the file to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="shotbank-py-"), "shotbank.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg_dir):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process (and share a machine's folders)."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder that ``spark.checkpoint.dir`` names, if it is set."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared folder for a written table.

    Without ``spark.checkpoint.dir`` a local session gets a folder under the system's temp directory;
    anywhere else this is an error, as executors would each write to their own disk.
    """
    base = checkpoint_dir(spark)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shotbank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a table that was written to a ``scratch_path`` (only such a table)."""
    base = (checkpoint_dir(spark) or "").rstrip("/")
    if not base or not path.startswith(base + "/"):
        raise ValueError(f"{path} is not under the scratch folder")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True))
