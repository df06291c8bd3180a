"""Folders and files that the driver and every executor can see, and rows by their places in files."""

from __future__ import annotations

import ctypes
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import posix_folder, put, root, table

__all__ = ["MOST_ROWS", "PLACE", "located", "picked", "give_back", "posix_folder", "put", "release", "renamed", "root", "small_batches", "table", "tidy", "without"]


#: Where a row is: a hash of its file's path, and its place in the file.
PLACE = ["__file", "__row"]
#: Rows up to which a set of places is sent to every executor (two integers each); beyond, texts are joined with it by shuffle.
MOST_ROWS = 500_000


def _scans(docs: DataFrame) -> bool:
    """Whether ``docs`` is Parquet files with nothing but deterministic filters and projections on top."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.deterministic():
        node = node.child()
    if node.nodeName() != "LogicalRelation" or not node.relation().getClass().getName().endswith("HadoopFsRelation"):
        return False
    return node.relation().fileFormat().getClass().getName().endswith("ParquetFileFormat")


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``PLACE``, which tell rows apart however often they are read.

    Rows of Parquet files have a place already; anything else is written once and read back.
    """
    if not _scans(docs):
        docs = table(docs.sparkSession, docs, "located")
    at = docs.metadataColumn("_metadata")
    return docs.withColumns({PLACE[0]: F.xxhash64(at["file_path"]), PLACE[1]: at["row_index"]})


def renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their places, __0, __1, ..., so that no name of theirs clashes with one of an operator's; ``toDF`` names them back."""
    return docs.toDF(*(f"__{i}" for i in range(len(docs.columns))))


def _side(places: DataFrame) -> DataFrame:
    places = table(places.sparkSession, places, "places")
    return F.broadcast(places) if places.limit(MOST_ROWS + 1).count() <= MOST_ROWS else places


def picked(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``located`` rows that stand in ``places``, with what else it says of them."""
    return rows.join(_side(places), PLACE)


def without(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``located`` rows that don't stand in ``places``, without their places."""
    return rows.join(_side(places.select(*PLACE)), PLACE, "left_anti").drop(*PLACE)


def release(written: DataFrame) -> None:
    """Remove the files of a ``table`` that nothing reads any more."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts; the session keeps the setting, as its queries run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidy(run):
    """``run`` over a partition, after which the worker gives back memory that its allocators hold."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
