"""Records of quoted, multi-line CSV files, read in byte ranges.

A line break ends a record where the number of quotes before it is even; a doubled quote changes nothing. A first pass counts the quotes of every
range; from one row for each range it follows in which state each begins. A second pass cuts each range into the
records that begin in it, reading on to the end of the last. Fields are left to Spark's own parser.
"""

from __future__ import annotations

import csv
import io
import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range, and of what is read on for a record that leaves it.
RANGE, STEP = 32 << 20, 1 << 20
_QUOTE, _BREAK = 0x22, 0x0A
_PACKED = (".gz", ".bz2", ".lz4", ".snappy", ".zst", ".deflate", ".xz")


def files(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """Names and sizes of the files of a table in a mounted folder; None where they can't be read in ranges."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = urlparse(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())
    if at.scheme != "file" or not os.path.exists(at.path):
        return None
    found = [at.path] if os.path.isfile(at.path) else sorted(f.path for f in os.scandir(at.path) if f.is_file() and f.name[0] not in "._")
    return None if not found or any(f.endswith(_PACKED) for f in found) else [(f, os.path.getsize(f)) for f in found]


def _odd(data: bytes) -> bool:
    return bool(np.count_nonzero(np.frombuffer(data, np.uint8) == _QUOTE) & 1)


def _breaks(data: bytes, odd: bool) -> np.ndarray:
    """Places of the line breaks that end a record, in bytes that begin inside quotes or not."""
    x = np.frombuffer(data, np.uint8)
    inside = (np.cumsum(x == _QUOTE) & 1).astype(bool) ^ odd
    return np.flatnonzero((x == _BREAK) & ~inside)


def _records(path: str, start: int, size: int, odd: bool) -> list[bytes]:
    """The records that begin in a range; a range that isn't the first begins with what its first byte's record leaves over."""
    with open(path, "rb") as f:
        f.seek(max(start - 1, 0))
        data = f.read(size + (start > 0))  # with the byte before, which may be a break
        own = len(data)
        if start:
            odd ^= data[:1] == b'"'
        ends = _breaks(data, odd)
        while not len(ends) or ends[-1] < own - 1:  # the last record goes on
            more = f.read(STEP)
            if not more:
                break
            data += more
            beyond = _breaks(data, odd)
            ends = beyond[: np.searchsorted(beyond, own - 1) + 1]
    begins = np.concatenate([[] if start else [0], ends + 1]).astype(np.int64)
    begins = begins[begins < min(own, len(data))]
    stops = np.append(ends, len(data))[np.searchsorted(ends, begins)]
    return [data[a:z].removesuffix(b"\r") for a, z in zip(begins.tolist(), stops.tolist(), strict=True)]


def header(path: str) -> list[str]:
    """Names of the columns in the first record of a file."""
    with open(path, "rb") as f:
        data = f.read(STEP)
        while not len(_breaks(data, False)) and (more := f.read(STEP)):
            data += more
    ends = _breaks(data, False)
    first = data[: ends[0]] if len(ends) else data
    return next(csv.reader(io.StringIO(first.decode("utf-8-sig").removesuffix("\r"), newline="")), [])


def records(spark: SparkSession, found: list[tuple[str, int]], range_bytes: int = RANGE) -> DataFrame:
    """value: the text of each record but the first of each file; empty lines are none."""
    ranges = [(path, a, min(range_bytes, size - a)) for path, size in found for a in range(0, size, range_bytes)]
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(min(len(rows), 10_000), "path", "start") if rows else spark.createDataFrame([], schema)

    def count(batches):
        for batch in batches:
            out = []
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as f:
                    f.seek(start)
                    out.append(_odd(f.read(size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.bool_())], ["path", "start", "odd"])

    sizes = dict(found)
    odd, states, last = False, [], None
    for r in sorted(dealt(ranges, "path string, start long, size long").mapInArrow(count, "path string, start long, odd boolean").collect()):  # a row for each range
        odd = odd and r.path == last
        states.append((r.path, r.start, min(range_bytes, sizes[r.path] - r.start), odd))
        odd, last = odd ^ r.odd, r.path

    def read(batches):
        for batch in batches:
            for path, start, size, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = _records(path, start, size, odd)[0 if start else 1 :]
                for k in range(0, len(got), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in got[k : k + 1000] if x], pa.string())], ["value"])

    return dealt(states, "path string, start long, size long, odd boolean").mapInArrow(read, "value string")
