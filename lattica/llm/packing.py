"""Packing into optimal length buckets.

The lengths of all documents make one histogram, with a bin for each length that occurs. Dynamic programming over it finds the bucket boundaries
with the least padding. Inside each bucket documents are dealt by hash to shards of a bounded number
of rows, and every shard is cut into batches under a token budget.

Edge cases: a null or empty text has length 1, its end id; a document longer than the budget is a
batch of its own; equal ids, null ones too, are spread over shards by their places in files; an empty table
gives no rows; extra columns stay untouched, but one that has the name of a column added here gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from . import pieces, shared

BUCKETS, BUDGET, SHARD_BATCHES = 16, 65_536, 64
ADDED = ("bucket", "bucket_size", "batch_id", "place", "padding")


def lengths(docs: DataFrame, keep: list[str], tokenizer: str, text: str = "text") -> DataFrame:
    """``keep`` columns and n_tokens, the end id included, of every row."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    table = pieces.build(docs, tokenizer, text)

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(batch.num_columns - 1)):
                n = table.count(block) + 1
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, block.rows) for c in batch.columns[:-1]), pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(shared.tidy(run), f"{schema}, n_tokens long")


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Ascending upper ends of at most ``buckets`` buckets over ascending sizes: the least sum of padded sizes.

    The best start of the last bucket never falls as its end grows, so each round divides and conquers.
    """
    n = len(sizes)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        cost, come = best.copy(), np.arange(n + 1)
        spans = [(1, n, 0, n - 1)]  # ends from and to, with starts from and to
        while spans:
            first, last, lo, hi = spans.pop()
            j = (first + last) // 2
            to = min(hi, j - 1) + 1
            here = best[lo:to] + sizes[j - 1] * (total[j] - total[lo:to])
            k = lo + int(np.argmin(here))
            if here[k - lo] < cost[j]:
                cost[j], come[j] = here[k - lo], k
            spans += [s for s in ((first, j - 1, lo, k), (j + 1, last, k, hi)) if s[0] <= s[1]]
        best = cost
        back.append(come)
    out, j = [], n
    for come in reversed(back):
        if j and come[j] < j:
            out.append(int(sizes[j - 1]))
            j = int(come[j])
    return out[::-1]


@dataclass
class Plan:
    ends: list[int]
    rows: list[int]
    budget: int

    def capacity(self, k: int) -> int:
        return max(1, self.budget // self.ends[k])

    def shards(self, k: int) -> int:
        return max(1, -(-self.rows[k] // (SHARD_BATCHES * self.capacity(k))))


def plan(sized: DataFrame, length: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> Plan:
    """From the histogram of every row's length; the distinct lengths reach the driver, whose number is at most
    the root of twice the tokens of all documents."""
    found = sized.groupBy(F.col(length).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()
    sizes, counts = np.array([r["size"] for r in found], np.int64), np.array([r.n for r in found], np.int64)
    ends = boundaries(sizes, counts, buckets)
    at = np.searchsorted(ends, sizes)
    return Plan(ends, [int(counts[at == k].sum()) for k in range(len(ends))], budget)


def pack(sized: DataFrame, how: Plan, key: str = "doc_id", length: str = "n_tokens") -> DataFrame:
    """Adds bucket, bucket_size, batch_id, place (in the batch) and padding to every row."""
    sized = sized.drop(*(c for c in sized.columns if c.lower() in ADDED and c not in (key, length)))
    if not how.ends:
        return sized.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_size"), F.lit("").alias("batch_id"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("padding"))
    plain = shared.renamed(sized)
    id_, n = (F.col(plain.columns[sized.columns.index(c)]) for c in (key, length))
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), F.col("bucket") + 1)
    bucket = sum((F.when(n > e, 1).otherwise(0) for e in how.ends[:-1]), F.lit(0))
    k = range(len(how.ends))
    # Dealt out by id and place in the file: null or equal ids are spread like others.
    rows = shared.located(plain).withColumns({"bucket": bucket.cast("int"), "__deal": F.xxhash64(F.lit(3), id_, F.col("__row"))})
    rows = rows.withColumns({"bucket_size": pick(how.ends).cast("long"), "__cap": pick([how.capacity(i) for i in k]), "__shard": F.pmod("__deal", pick([how.shards(i) for i in k]))})
    order = Window.partitionBy("bucket", "__shard").orderBy(F.xxhash64(F.lit(4), F.col("__deal")), id_, n, "__file")
    rows = rows.withColumn("__nr", F.row_number().over(order) - 1)
    rows = rows.withColumns({"batch_id": F.concat_ws("-", "bucket", "__shard", F.floor(F.col("__nr") / F.col("__cap")).cast("string")), "place": F.pmod(F.col("__nr"), F.col("__cap")), "padding": F.col("bucket_size") - n})
    return rows.select(*plain.columns, *ADDED).toDF(*sized.columns, *ADDED)
