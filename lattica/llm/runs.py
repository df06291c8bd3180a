"""Running sums within keys of any size.

Rows are ranged by key and order, so that a key with a third of all rows lies in many partitions; each partition sums its own rows,
and what a partition carries into the next goes by way of one row for each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: A Mersenne prime: sums of products modulo it stay within 64 bits.
P = (1 << 61) - 1
_U = np.uint64


def _folded(x: np.ndarray) -> np.ndarray:
    x = (x & _U(P)) + (x >> _U(61))
    return np.where(x >= P, x - _U(P), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo P of numbers below P."""
    al, ah, bl, bh = a & _U(0x7FFFFFFF), a >> _U(31), b & _U(0x7FFFFFFF), b >> _U(31)
    mid = al * bh + ah * bl
    return _folded(_U(2) * ah * bh + (mid >> _U(30)) + ((mid & _U(0x3FFFFFFF)) << _U(31)) + _folded(al * bl))


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo P."""
    out, e, square = np.ones(len(exponents), _U), exponents.astype(_U), base % P
    for bit in range(int(e.max()).bit_length() if len(e) else 0):
        odd = (e >> _U(bit)) & _U(1) == 1
        out[odd] = times(out[odd], np.full(int(odd.sum()), square, _U))
        square = square * square % P
    return out


def _summed(x: np.ndarray, modulus: bool) -> np.ndarray:
    """Running sums with a leading 0."""
    if not modulus:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])
    x = x.astype(_U)
    low, high = np.cumsum(x & _U(0xFFFFFFFF)), np.cumsum(x >> _U(32))
    both = times(_folded(high), np.full(len(x), 1 << 32, _U)) + _folded(low)
    return np.concatenate([np.zeros(1, _U), _folded(both)]).astype(np.int64)


def running(rows: DataFrame, key: str, order: list[Column], values: list[str], modulus: bool = False) -> DataFrame:
    """``rows`` with each of ``values`` (long) replaced by its sum over the rows of ``key`` up to and with this one, and ``part``, the
    partition of the ordered rows that each lies in. With ``modulus`` sums are modulo P, of numbers from 0 to P - 1. The result is a table in the shared folder."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key), *order]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    names = dealt.columns
    at_key, at = names.index(key), [names.index(v) for v in values]

    def run(batches):
        last, carry, place = None, np.zeros(len(values), np.int64), 0
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            keys = batch.column(at_key)
            new = np.ones(m, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            goes_on = keys[0].as_py() == last
            first = int(np.flatnonzero(new[1:])[0]) + 1 if new[1:].any() else m
            columns = list(batch.columns)
            for j, c in enumerate(at):
                total = _summed(batch.column(c).to_numpy(), modulus)
                own = total[1:] - total[start]
                if goes_on:
                    own[:first] += carry[j]
                own = own % P if modulus else own
                carry[j] = own[-1]
                columns[c] = pa.array(own)
            last = keys[m - 1].as_py()
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(place, place + m))], [*names, "nth"])
            place += m

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    summed = shared.table(spark, dealt.mapInArrow(run, f"{kinds}, nth long"), "runs")
    ends = summed.groupBy("part").agg(F.min_by(key, "nth").alias("first"), F.max_by(F.struct(F.col(key).alias("key"), *values), "nth").alias("last"))
    carried, before, held = [], None, [0] * len(values)
    for r in sorted(ends.collect(), key=lambda r: r.part):  # one row for each partition
        if before is not None and r.first == before:
            carried.append((r.part, r.first, *held))
        whole = before is not None and r.first == before and r.last.key == before
        held = [(h if whole else 0) + r.last[v] for h, v in zip(held, values, strict=True)]
        held = [h % P for h in held] if modulus else held
        before = r.last.key
    if not carried:
        return summed.drop("nth")
    kind = summed.schema[key].dataType.simpleString()
    carry = spark.createDataFrame(carried, f"part int, `{key}` {kind}, " + ", ".join(f"more_{v} long" for v in values))
    whole = summed.join(F.broadcast(carry), ["part", key], "left")
    plus = lambda v: F.coalesce(F.col(v) + F.col(f"more_{v}"), F.col(v))
    return whole.select(*(((F.pmod(plus(v), F.lit(P)) if modulus else plus(v)).alias(v) if v in values else F.col(v)) for v in names))
