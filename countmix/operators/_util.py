"""Small helpers shared by operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS


def bounded_broadcast(df: DataFrame, n_rows: int | None = None,
                      max_rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its known exact row count is within the bound.

    Beyond the bound, or when the count is not known, the plain DataFrame is
    returned: Spark shuffles both sides, or broadcasts the small one once its
    measured size allows (AQE, which also splits a hot key's partition).
    """
    limit = LIMITS.max_broadcast_rows if max_rows is None else max_rows
    return F.broadcast(df) if n_rows is not None and n_rows <= limit else df


def ship(spark) -> None:
    """Ensure Python workers can import this package (see session.ship_package)."""
    from ..session import ship_package
    ship_package(spark)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the session's checkpoint directory."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to ``path`` in the shared folder and read back:
    cuts the lineage and survives the loss of executors."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` stored in a new folder."""
    return stored(df, scratch(df.sparkSession, name), compression)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared storage that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and broadcasts of finished
    iterations now; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


class sized_shuffles:
    """Context manager: run the enclosed jobs with ``spark.sql.shuffle.partitions``
    set to ``n`` (sized from the data by the caller), then restore it.

    Iterative fits run many small aggregations per round; sizing their
    shuffles to the matrix (non-zeros per partition, at least one per core)
    instead of a session-wide default keeps each round's task count right at
    every scale."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.old = spark, int(n), None

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False
