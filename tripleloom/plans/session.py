"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tripleloom_package", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(tempfile.mkdtemp(), "tripleloom_package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(at)
    sc._tripleloom_package = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary one (tests); on
    a cluster that would lose data, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tripleloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def remember(spark: SparkSession, path: str) -> str:
    """Note a path for :func:`clean`."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tripleloom_tables"):
        sc._tripleloom_tables = []
    sc._tripleloom_tables.append(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return remember(spark, f"{shared_dir(spark)}/tripleloom-tables/{uuid.uuid4().hex}")


def clean(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; nothing made from them can be read afterwards."""
    paths = getattr(spark.sparkContext, "_tripleloom_tables", [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    n = len(paths)
    paths.clear()
    return n
