"""Make the package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import strandlink

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to executors through Spark's own file server, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(strandlink.__file__)))
    out = os.path.join(tempfile.mkdtemp(), "strandlink.zip")
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "strandlink")):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(d, n)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    # rows of these tables hold whole texts: smaller batches bound what a Python worker holds at once; a setting of the
    # caller's own stays as it is
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not sc.getConf().contains(key) and spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    _shipped.add(sc.applicationId)
