"""Results that change in place: a table of sorted segments that are merged when they are read.

A commit adds one segment, whose size is that of the batch: rows of the columns ``key``, ``gone`` (a tombstone) and ``row`` (all other
columns), sorted by key, with Parquet's Bloom filter over the keys. The log names the live segments in order, with their least and
greatest keys; a later segment's row hides an earlier one's. Commits are optimistic: a writer makes its segment, then claims the next
number of the log, and looks again if another writer has it. ``compact`` merges the newest segments while the one before them isn't
twice their size, so that there are logarithmically many and a row is written again logarithmically often.

A batch has one row for a key: of repeated ones the one with the greatest ``order``, of these (or without an order) the one whose JSON
is greatest. A null key is an error. An empty batch adds no segment. Columns may have any names. The folder needs a file system
that links or renames without overwriting (a mounted one, or HDFS).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _log(spark: SparkSession, path: str) -> dict:
    """The newest entry of the log; there is one from ``create`` on."""
    fs, where = _at(spark, f"{path}/log/*.json")
    found = [s.getPath() for s in fs.globStatus(where) or []]
    if not found:
        raise FileNotFoundError(f"no results table in {path}")
    newest = max(found, key=lambda p: p.getName())  # of fixed width
    stream = fs.open(newest)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, entry: dict) -> bool:
    """Makes an entry of the log, whole, unless one of its number is there."""
    fs, where = _at(spark, f"{path}/log/{entry['number']:012d}.json")
    _, part = _at(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = fs.create(part)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    try:
        if urlparse(path).scheme not in ("", "file"):
            return fs.rename(part, where)
        try:
            os.link(urlparse(part.toString()).path, urlparse(where.toString()).path)
        except FileExistsError:
            return False
        return True
    finally:
        fs.delete(part, False)


def create(spark: SparkSession, path: str, schema: StructType, key: str) -> None:
    """An empty table of rows of a schema; one that is there stays, if it has the same columns."""
    fs, where = _at(spark, f"{path}/log")
    fs.mkdirs(where)
    try:
        had = _log(spark, path)
    except FileNotFoundError:
        if _claim(spark, path, {"number": 0, "key": key, "schema": schema.json(), "segments": [], "writers": {}}):
            return
        had = _log(spark, path)
    kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    if had["key"] != key or kinds(_schema(had)) != kinds(schema):
        raise ValueError(f"{path} holds results of another form")


def _schema(log: dict) -> StructType:
    return StructType.fromJson(json.loads(log["schema"]))


def _stored(log: dict) -> str:
    schema = _schema(log)
    rest = ", ".join(f"`{f.name.replace('`', '``')}`: {f.dataType.simpleString()}" for f in schema.fields if f.name != log["key"])
    return f"key {schema[log['key']].dataType.simpleString()}, gone boolean, row struct<{rest}>"


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _segment(spark: SparkSession, path: str, rows: DataFrame) -> dict | None:
    """Writes rows (key, gone, row) with unique keys as a segment; None if there are none."""
    name = uuid.uuid4().hex
    at = f"{path}/segments/{name}"
    sized = rows.repartitionByRange("key").sortWithinPartitions("key")  # as many files as the session's plan finds fit for the bytes
    sized.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(at)
    r = spark.read.schema(rows.schema).parquet(at).agg(F.count(F.lit(1)), F.min("key").cast("string"), F.max("key").cast("string")).first()
    return {"name": name, "rows": r[0], "low": r[1], "high": r[2]} if r[0] else None


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> bool:
    """Puts a change of the log through: ``change`` makes the next entry out of the newest, again for as long as other writers are first, or None to leave it."""
    while True:
        log = _log(spark, path)
        entry = change(log)
        if entry is None:
            return False
        if _claim(spark, path, entry | {"number": log["number"] + 1}):
            return True


def upsert(rows: DataFrame, path: str, order: str | None = None, writer: str | None = None, batch: int | None = None) -> bool:
    """Puts rows over those of the same keys. With an ``order`` a row that has less of it than the stored one is left out (null is least; of
    equals the new one counts). A ``batch`` of a ``writer`` counts once: numbers not above its last are left out. Whether it was committed."""
    spark = rows.sparkSession
    log = _log(spark, path)
    if batch is not None and log["writers"].get(writer, -1) >= batch:
        return False
    key, names = log["key"], [f.name for f in _schema(log).fields]
    checked = F.coalesce(_column(key), F.raise_error(F.lit("a result has a null key")).cast(_schema(log)[key].dataType))
    rest = F.struct(*(_column(n) for n in names if n != key))
    rank = F.struct(*([_column(order)] if order else []), F.to_json(F.struct(rest)))
    made = rows.select(checked.alias("key"), F.lit(False).alias("gone"), rest.alias("row"), rank.alias("rank")).groupBy("key").agg(F.max_by(F.struct("gone", "row"), "rank").alias("x")).select("key", "x.gone", "x.row")
    return _add(spark, path, made, order, writer, batch)


def _add(spark: SparkSession, path: str, made: DataFrame, order: str | None = None, writer: str | None = None, batch: int | None = None) -> bool:
    while True:
        log = _log(spark, path)
        own = made
        if order:  # seen against the table as it is; another writer's commit asks for another look
            now = _merged(spark, path, log).select("key", F.col("row")[order].alias("had"))
            own = made.join(now, "key", "left").filter(F.col("had").isNull() | (F.col("row")[order] >= F.col("had"))).select("key", "gone", "row")
        segment = _segment(spark, path, own.select("key", "gone", "row"))

        def change(newest: dict) -> dict | None:
            if order and newest["number"] != log["number"] or batch is not None and newest["writers"].get(writer, -1) >= batch:
                return None
            writers = newest["writers"] | ({writer: batch} if batch is not None else {})
            return newest | {"segments": newest["segments"] + ([segment] if segment else []), "writers": writers}

        if segment is None and batch is None:
            return False
        if _commit(spark, path, change):
            return True
        if batch is not None and _log(spark, path)["writers"].get(writer, -1) >= batch:
            return False


def delete(keys: DataFrame, path: str) -> bool:
    """Takes out the rows of some keys, a table with the key's column, by tombstones."""
    spark = keys.sparkSession
    log = _log(spark, path)
    kind = _stored(log)
    made = keys.select(_column(log["key"]).alias("key")).filter("key is not null").distinct()
    empty = F.lit(None).cast(spark.createDataFrame([], kind).schema["row"].dataType)
    return _add(spark, path, made.select("key", F.lit(True).alias("gone"), empty.alias("row")))


def clear(spark: SparkSession, path: str, where: Column) -> bool:
    """Takes out the results that meet a condition, so that their work is done again."""
    return delete(read(spark, path).filter(F.coalesce(where, F.lit(False))), path)


def repair(spark: SparkSession, path: str, broken: DataFrame, size: int) -> bool:
    """Takes out the results of broken shards, a table of shard_id, where the key is a row's place."""
    key = _column(_log(spark, path)["key"])
    had = read(spark, path).select(key).withColumn("shard_id", F.floor(key / size).cast("long"))
    return delete(had.join(broken.select("shard_id"), "shard_id", "left_semi"), path)


def _frame(spark: SparkSession, path: str, log: dict, segments: list[dict]) -> DataFrame:
    """Rows of segments with their places among them."""
    frames = [spark.read.schema(_stored(log)).parquet(f"{path}/segments/{s['name']}").withColumn("nr", F.lit(i)) for i, s in enumerate(segments)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def _latest(spark: SparkSession, path: str, log: dict, segments: list[dict]) -> DataFrame:
    if len(segments) == 1:
        return _frame(spark, path, log, segments).drop("nr")
    got = _frame(spark, path, log, segments).groupBy("key").agg(F.max_by(F.struct("gone", "row"), "nr").alias("x"))
    return got.select("key", "x.gone", "x.row")


def _merged(spark: SparkSession, path: str, log: dict, segments: list[dict] | None = None) -> DataFrame:
    """Live rows (key, row). The first segment, by far the largest, is only filtered by the later ones' keys; these alone are grouped."""
    segments = log["segments"] if segments is None else segments
    if not segments:
        return spark.createDataFrame([], _stored(log)).drop("gone")
    if len(segments) == 1:
        return _latest(spark, path, log, segments).filter("not gone").drop("gone")
    later = _latest(spark, path, log, segments[1:])
    first = _frame(spark, path, log, segments[:1]).drop("nr").filter("not gone")
    return first.join(later.select("key"), "key", "left_anti").unionAll(later.filter("not gone")).drop("gone")


def _named(log: dict, merged: DataFrame) -> DataFrame:
    return merged.select(*(F.col("key").alias(f.name) if f.name == log["key"] else F.col("row")[f.name].alias(f.name) for f in _schema(log).fields))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now. Filters on the key reach the files, whose footers tell ranges and Bloom filters."""
    log = _log(spark, path)
    return _named(log, _merged(spark, path, log))


def read_between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Rows with keys from ``low`` to ``high``, whole numbers both; segments with none of these aren't opened."""
    log = _log(spark, path)
    own = [s for s in log["segments"] if int(s["low"]) <= high and low <= int(s["high"])]
    return _named(log, _merged(spark, path, log, own).filter(F.col("key").between(low, high)))


def segments(spark: SparkSession, path: str) -> list[dict]:
    """name, rows, low and high of the live segments, oldest first."""
    return _log(spark, path)["segments"]


def compact(spark: SparkSession, path: str, all_of_them: bool = False) -> bool:
    """Merges the newest segments, or all; writers go on meanwhile, and what they add stays on top. Tombstones go once nothing is below them."""
    log = _log(spark, path)
    had, n, rows = log["segments"], 1, 0
    if len(had) < 2:
        return False
    rows = had[-1]["rows"]
    while n < len(had) and (all_of_them or had[-n - 1]["rows"] < 2 * rows):
        n += 1
        rows += had[-n]["rows"]
    if n < 2:
        return False
    own = had[-n:]
    whole = _merged(spark, path, log).select("key", F.lit(False).alias("gone"), "row") if n == len(had) else _latest(spark, path, log, own)
    segment = _segment(spark, path, whole)
    names = [s["name"] for s in own]

    def change(newest: dict) -> dict | None:
        now = [s["name"] for s in newest["segments"]]
        at = now.index(names[0]) if names[0] in now else -1
        if at < 0 or now[at : at + n] != names:  # another one has compacted them
            return None
        return newest | {"segments": newest["segments"][:at] + ([segment] if segment else []) + newest["segments"][at + n :]}

    return _commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, keep: int = 2, seconds: float = 86400) -> int:
    """Removes segments that none of the last ``keep`` entries of the log names, and older entries, if they are older than some seconds: younger
    ones may be a writer's or a reader's. How many segments went."""
    fs, where = _at(spark, f"{path}/log/*.json")
    entries = sorted((s.getPath() for s in fs.globStatus(where)), key=lambda p: p.getName())
    used = set()
    for p in entries[-keep:]:
        stream = fs.open(p)
        used |= {s["name"] for s in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["segments"]}
        stream.close()
    before, gone = (time.time() - seconds) * 1000, 0
    for s in fs.globStatus(_at(spark, f"{path}/segments/*")[1]) or []:
        if s.getPath().getName() not in used and s.getModificationTime() <= before:
            gone += fs.delete(s.getPath(), True)
    for p in entries[:-keep]:
        if fs.getFileStatus(p).getModificationTime() <= before:
            fs.delete(p, False)
    return gone
