"""Spark session and checkpoint-directory helpers.

The library never picks storage on a cluster: lineage is cut with
``DataFrame.checkpoint()`` into the directory the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (local tests,
the bench) does :func:`ensure_checkpoint_dir` create a scratch folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "16g",
    # per-round checkpoints of iterative fits are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # one BLAS thread per task: Spark already runs one task per core
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "countmix",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory; with none configured, a new
    local one in local mode (tests, one machine) and an error elsewhere."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir and not (sc.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="countmix-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``countmix`` importable in Python workers (the ``--py-files``
    mechanism): zip the package once per SparkContext and ``addPyFile`` it.
    A no-op when the package is already importable from a site directory."""
    sc = spark.sparkContext
    # model state moves between driver and executors as Arrow batches
    # (topic matrices, EM statistics); the row-by-row path is far slower
    if spark.conf.get("spark.sql.execution.arrow.pyspark.enabled", "false") != "true":
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="countmix-pyfiles-")
    path = os.path.join(out_dir, "countmix.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)
