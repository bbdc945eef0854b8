"""Session helpers: reading tables and cutting lineage without losing fault tolerance."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset, one of its own in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "WEFTLINE_SHARED_DIR" not in os.environ:
        os.environ["WEFTLINE_SHARED_DIR"] = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, os.environ["WEFTLINE_SHARED_DIR"], ignore_errors=True)
    return f"file://{os.environ['WEFTLINE_SHARED_DIR']}"


_written: set[str] = set()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This ends its lineage and survives the loss of any executor, and unlike an RDD checkpoint the copy
    is columnar and compressed. The tables stay until ``clear`` or the end of the session's driver.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clear, df.sparkSession)
    _written.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote; results that read them must have been used."""
    while _written:
        path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001  (the session may have ended)
            return


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("weftline", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._weftline_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
