"""Integer k-means with Drake's adaptive bounds.

Every vector keeps an upper bound of the distance to its centroid, lower bounds for its several nearest
other centroids in ascending order, and one more lower bound for all centroids besides. When centroids have moved, the bounds are
shifted by what they moved. The first lower bound above the upper one certifies that only the centroids before it can be nearest,
and only these are measured; where none is, all centroids are measured exactly. Distances are exact integers;
bounds are rounded outwards, so that they never decide a tie.

The state of a round is a table in the shared folder, written in one pass over the table of the round before, which then goes. Of the new
table only the vectors that changed their centroid are read for the sums. The driver holds k centroids and k sums.

Edge cases: vectors that are null, of another length, or have a null or non-finite component are left out; so is nothing else,
and without a vector there are no rows; fewer vectors than centroids give one centroid each; repeated
vectors and ids count as often as they occur; a null id never seeds a centroid before others do; a component of 2**27 or more after
scaling is an error, as squared distances would leave 64 bits; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SEVERAL = 3
LARGEST = 1 << 27
#: Centroids times components that are sent to every task.
MOST_CELLS = 1 << 22
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of a column of packed arrays of one width, as a copy."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and width else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype).reshape(len(column), width).copy()


def _packed(rows: np.ndarray) -> pa.Array:
    step = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * step).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of v to every row of c."""
    most = max((int(np.abs(x).max()) for x in (v, c) if x.size), default=0)
    if most <= 1 << 20 and v.shape[1] <= 1 << 10:  # products and their sums are whole numbers below 2**53
        a, b = v.astype(np.float64), c.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = np.square(v.astype(np.int64) - row.astype(np.int64)).sum(axis=1)
    return out


def _ordered(lower: np.ndarray) -> np.ndarray:
    """No bound above the next; lowering a lower bound is safe."""
    return np.minimum.accumulate(lower[:, ::-1], axis=1)[:, ::-1]


def full(v: np.ndarray, c: np.ndarray, several: int) -> tuple[np.ndarray, ...]:
    """Cluster, upper bound, nearest other centroids and lower bounds from exact distances to all centroids."""
    d = squares(v, c)
    order = np.argsort(d, axis=1, kind="stable")  # the smaller number first among equals
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    near = order[:, 1 : several + 1]
    lower = np.full((len(v), near.shape[1] + 1), np.inf)
    lower[:, : far.shape[1] - 1] = far[:, 1 : several + 2] * _DOWN
    return order[:, 0], far[:, 0] * _UP, near, lower


def reassign(v: np.ndarray, c: np.ndarray, moved: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The state under centroids that moved by at most ``moved``, and the number of distances measured for each row."""
    several = near.shape[1]
    cluster, near = cluster.copy(), near.copy()
    upper = upper + moved[cluster]
    lower = lower - np.concatenate([moved[near], np.full((len(v), 1), moved.max(initial=0.0))], axis=1)
    lower = _ordered(np.maximum(lower, 0.0))
    spent = np.zeros(len(v), np.int64)

    def uncertain(rows: np.ndarray) -> np.ndarray:
        """How many of the other centroids, in order, may be nearest; ``several`` + 1: any."""
        return (upper[rows, None] >= lower[rows]).sum(axis=1)

    rows = np.flatnonzero(upper >= lower[:, 0])
    if len(rows):  # the exact distance to the own centroid often certifies it
        for a in np.unique(cluster[rows]):
            own = rows[cluster[rows] == a]
            upper[own] = np.sqrt(squares(v[own], c[a : a + 1])[:, 0].astype(np.float64)) * _UP
        spent[rows] += 1
        open_ = uncertain(rows)
        for z in range(1, several + 1):
            own = rows[open_ == z]
            if not len(own):
                continue
            these = np.concatenate([cluster[own, None], near[own, :z]], axis=1)
            d = np.square(v[own, None, :].astype(np.int64) - c[these].astype(np.int64)).sum(axis=2)
            order = np.lexsort((these, d), axis=1)
            these, far = np.take_along_axis(these, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            cluster[own], upper[own] = these[:, 0], far[:, 0] * _UP
            near[own, :z], lower[own, :z] = these[:, 1:], far[:, 1:] * _DOWN
            spent[own] += z
        own = rows[open_ > several]
        if len(own):
            cluster[own], upper[own], near[own], lower[own] = full(v[own], c, several)
            spent[own] += len(c)
    return cluster, upper, near, _ordered(lower), spent


def _vectors(rows: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """id and packed integers of the rows that count."""
    e = F.col("e")
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("e"))
    good = (F.size(e) == width) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def pack(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)
            x = np.floor(x * scale)
            if len(x) and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more after scaling")
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(x.astype(np.int32))], ["id", "v"])

    return rows.filter(F.coalesce(good, F.lit(False))).mapInArrow(pack, f"id {rows.schema['id'].dataType.simpleString()}, v binary")


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their cluster add to sums of components and to counts, as Python integers."""

    def add(batches):
        sums = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            new, old = (batch.column(i).to_numpy() for i in (0, 1))
            v = np.concatenate([_matrix(batch.column(2), np.int32, width).astype(np.int64), np.ones((len(new), 1), np.int64)], axis=1)
            for j in range(k):
                sums[j] += v[new == j].sum(axis=0) - v[old == j].sum(axis=0)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], ["at", "s"])

    part = state.filter("cluster <> was").select("cluster", "was", "v").mapInArrow(add, "at long, s long")
    out = np.zeros(k * (width + 1), object)
    for r in part.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k x (width + 1) rows at most
        out[r.at] = int(r.s)
    out = out.reshape(k, width + 1)
    return out[:, :-1], out[:, -1]


def seeds(vectors: DataFrame, k: int, rank: Column, width: int) -> np.ndarray:
    """The k vectors first by ``rank`` of their id, null ranks last, equal ranks by their bytes."""
    first = vectors.select(rank.alias("r"), "v").orderBy(F.col("r").asc_nulls_last(), F.hex("v")).limit(k).collect()
    return np.array([np.frombuffer(r.v, np.int32) for r in first], np.int64).reshape(len(first), width)


def cluster(rows: DataFrame, k: int, rounds: int, rank: Column, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 1024, several: int = SEVERAL) -> tuple[DataFrame, np.ndarray]:
    """id, cluster, distance (squared) and spent (distances measured in all rounds) of each vector, and the final centroids.

    ``rank``: an expression of the column ``id``; the first k vectors by it are the first centroids. Each round assigns all vectors and
    moves each centroid that has any to the floor of their mean; after the last all are assigned once more. Rounds end early once no centroid moves.
    """
    spark = rows.sparkSession
    if k * width > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} components of centroids")
    vectors = shared.table(spark, _vectors(rows, key, vector, width, scale), "vectors")
    kind = vectors.schema["id"].dataType.simpleString()
    c = seeds(vectors, k, rank, width)
    k = len(c)
    if not k:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("spent")), c
    several = min(several, k - 1)

    def start(batches):
        for batch in batches:
            v = _matrix(batch.column(1), np.int32, width)
            own, upper, near, lower = full(v, c, several)
            yield _state(batch.column(0), batch.column(1), own, np.full(len(v), -1), upper, near, lower, np.full(len(v), k))

    def step(c: np.ndarray, moved: np.ndarray):
        def run(batches):
            for batch in batches:
                v, was = _matrix(batch.column(1), np.int32, width), batch.column(2).to_numpy()
                own, upper, near, lower, spent = reassign(v, c, moved, was, batch.column(4).to_numpy(), _matrix(batch.column(5), np.int32, several).astype(np.int64), _matrix(batch.column(6), np.float64, several + 1))
                yield _state(batch.column(0), batch.column(1), own, was, upper, near, lower, batch.column(7).to_numpy() + spent)

        return run

    schema = f"id {kind}, v binary, cluster int, was int, upper double, near binary, lower binary, spent long"
    state = shared.table(spark, vectors.mapInArrow(start, schema), "clusters")
    shared.release(vectors)
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for _ in range(rounds):
        more, n = _sums(state, k, width)
        sums, counts = sums + more, counts + n
        new = np.array([[s // m for s in row] if m else own for row, m, own in zip(sums, counts, c.tolist(), strict=True)], np.int64).reshape(k, width)
        moved = np.sqrt(np.square(new - c).sum(axis=1).astype(np.float64)) * _UP
        if not moved.any():
            break
        c = new
        state, old = shared.table(spark, state.mapInArrow(step(c, moved), schema), "clusters"), state
        shared.release(old)
    final = c

    def measure(batches):
        for batch in batches:
            own = batch.column(2).to_numpy()
            d = np.square(_matrix(batch.column(1), np.int32, width).astype(np.int64) - final[own]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d), batch.column(3)], ["id", "cluster", "distance", "spent"])

    return state.select("id", "v", "cluster", "spent").mapInArrow(measure, f"id {kind}, cluster int, distance long, spent long"), c


def _state(ids, v, own, was, upper, near, lower, spent) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, v, pa.array(own.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), _packed(near.astype(np.int32)), _packed(lower), pa.array(spent.astype(np.int64))],
        ["id", "v", "cluster", "was", "upper", "near", "lower", "spent"])


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """What ``cluster`` returns, with cluster_inertia, inertia (sums of squared distances) and the digest of the cluster's centroid."""
    sums = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())  # one row for each centroid
    total = sum(sums.values())
    of = [(j, sums.get(j, 0), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for j, row in enumerate(centroids.tolist())]
    of = assigned.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster")
