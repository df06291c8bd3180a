"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: set[str] = set()


def _remove() -> None:
    """What this driver wrote, where it sees the folder; other stores need a rule of their own for old files."""
    for path in _made:
        shutil.rmtree(urlparse(path).path, ignore_errors=True)


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all is on this machine (tests), a folder of our own."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lattica-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def state(spark: SparkSession, *paths: str) -> tuple:
    """Names, lengths and times of the files of tables: it changes when one of them does."""
    found = []
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(where, True)
        while files.hasNext():
            f = files.next()
            found.append((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there. The files go when the driver ends."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    if urlparse(path).scheme in ("", "file"):
        if not _made:
            atexit.register(_remove)
        _made.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(spark: SparkSession) -> bool:
    """Whether the shared folder is one of a file system, so that workers can map its files into memory."""
    return urlparse(root(spark)).scheme in ("", "file")


def _drop(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def posix_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that workers map into memory.

    The shared folder must be mounted as a file system for that; any other scheme is an error.
    """
    at = urlparse(root(spark))
    if not mounted(spark):
        raise ValueError(f"memory mapping needs a mounted shared folder, not {at.scheme}://")
    path = f"{at.path}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(_drop, path)
    return path


def put(path: str, data: bytes | memoryview) -> None:
    """Write a file whole or not at all, so that a task that runs twice does no harm."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)
