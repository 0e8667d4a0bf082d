"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table and reads it again: what follows plans from its real size, and lost executors cost no recomputation.

    The folder is ``spark.checkpoint.dir``, or one inside the warehouse where
    that is unset; tables go when the driver exits.
    """
    path = _path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, tag: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def local_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared folder as a mounted path, for files that are no tables; it goes when the driver exits."""
    place = urlparse(_path(spark, tag))
    if place.scheme not in ("", "file"):
        raise ValueError(f"files need a shared folder that is mounted: {place.geturl()}")
    os.makedirs(place.path)
    return place.path


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark, "_jvm", None) is None or spark.sparkContext._jsc is None:
        return
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended: its owner clears the folder
        pass
