"""Materialised stages in storage that the whole cluster shares.

Iterative plans cut their lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading
it back.  Unlike ``localCheckpoint`` such a table survives the loss of an executor, and unlike
``DataFrame.checkpoint`` it is written by one job, compressed and columnar.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, weakref.ref] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; a fresh temporary folder where the setting is absent
    and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="strandlink-")
    spark.conf.set("spark.checkpoint.dir", root)
    _remember(spark, root)
    return root


def _remember(spark: SparkSession, path: str) -> None:
    _made[path] = weakref.ref(spark)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/strandlink/{label}-{uuid.uuid4().hex[:12]}"
    _remember(spark, path)
    return path


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with an empty lineage.

    ``release`` asks the driver to collect its garbage, after which Spark deletes the shuffle files of frames that
    are no longer referenced.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    schema = df.schema
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a frame from :func:`materialize`; the caller must have no further use for it."""
    path = getattr(df, "_stage_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


def _sweep() -> None:
    for path, ref in list(_made.items()):
        spark = ref()
        if spark is not None and spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # the gateway may be gone at exit; the folder is temporary anyway
                return


atexit.register(_sweep)
