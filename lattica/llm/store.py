"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks; every distinct chunk is stored
once under its digest, a document is a recipe of digests, and Merkle manifests over the recipes let
a reader prove that what it rebuilt is what was written.

Files below the store's folder: ``encoded`` (rows of kind 'chunk': digests, the chunk's one, and ids as
little-endian unsigned integers of 16 bits, or of 32 behind a zero byte), ``recipes`` (doc_id, n_tokens, start, digests, Merkle leaf; ascending ids, in files by ranges of ids)
and ``manifest`` (a Merkle root for each file of recipes and one over all).

Edge cases: a null or empty text is the end id alone; ids may be of any type with an order, null ones come
first; rows that share an id are separate documents next to each other, equal ones in any order; a very long
text is a recipe of many chunks; an empty table is an empty store; extra columns, whatever their names, are
never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from . import pieces, shared

DIGEST = 16
LEAST, MEAN, MOST, REACH = 64, 256, 1024, 16
_GEAR = np.random.default_rng(11).integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which a hash of the last 16 ids is a multiple of the mean."""
    n = len(ids)
    if n < REACH:
        return np.zeros(0, np.int64)
    power, inverse = bs._series(bs._P, n + 1), bs._series(bs._P_INV, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.take(_GEAR, ids & 0xFFFF) * power[:n], dtype=np.uint64, out=sums[1:])
    return REACH + np.flatnonzero(bs.mix((sums[REACH:] - sums[:-REACH]) * inverse[: n + 1 - REACH]) % np.uint64(MEAN) == 0)


def cuts(n: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of n ids: at marks, no chunk but the last shorter than the least nor any longer than the most."""
    out, last = [], 0
    for at in [*marked, n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at > last and (at - last >= LEAST or at == n):
            out.append(at)
            last = at
    return out


def chunks_of(ids: np.ndarray, starts: np.ndarray):
    """(row, start, end) of the chunks of the streams ids[starts[r]:starts[r + 1]] in order. A mark depends on its stream
    alone: windows that reach into the stream before are left out."""
    at = marks(ids)
    row = np.searchsorted(starts[1:], at, "left")
    keep = at - starts[row] >= REACH
    at, row = at[keep], row[keep]
    first = np.searchsorted(row, np.arange(len(starts)))
    own = (at - starts[row]).tolist()
    for r, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        last = 0
        for cut in cuts(z - a, own[first[r] : first[r + 1]]):
            yield r, a + last, a + cut
            last = cut


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def _stored(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\x00" + ids.astype("<u4").tobytes()


class Merkle:
    """Root of a run of digests that come one by one: of whole subtrees only one of each height is kept. An odd one out goes up as it is,
    no leaves give the digest of nothing."""

    def __init__(self) -> None:
        self.whole: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.whole and self.whole[-1][0] == height:
            leaf, height = _digest(b"\x01" + self.whole.pop()[1] + leaf), height + 1
        self.whole.append((height, leaf))

    def root(self) -> bytes:
        if not self.whole:
            return _digest(b"")
        out = self.whole[-1][1]
        for _, left in reversed(self.whole[:-1]):
            out = _digest(b"\x01" + left + out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a list of digests."""
    if len(leaves) == 1:
        return leaves[0]
    own = Merkle()
    for leaf in leaves:
        own.add(leaf)
    return own.root()


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode every row and write the store's files. ``folder`` is a path that Spark can write."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    table = pieces.build(rows, tokenizer)

    def encode(batches):
        """Chunks (by digest) that this task has not sent before, and recipes (by id), in one pass."""
        seen: set[bytes] = set()
        for batch in batches:
            for block in bs.blocks(batch.column(1)):
                stream, starts = table.streams(block, end_id)
                keys, data = [], []
                of: list[list[bytes]] = [[] for _ in range(block.rows)]
                whole = stream.astype("<u4", copy=False).tobytes()
                short = stream.astype("<u2").tobytes() if stream.max(initial=0) < 65536 else None
                for r, a, z in chunks_of(stream, starts):
                    d = _digest(whole[4 * a : 4 * z])
                    of[r].append(d)
                    if d not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(d)
                        keys.append(d)
                        data.append(short[2 * a : 2 * z] if short is not None else _stored(stream[a:z]))
                rows, size = batch.column(0).slice(block.first, block.rows), len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * size + ["recipe"] * block.rows), pa.concat_arrays([pa.nulls(size, rows.type), rows]), pa.array([None] * size + np.diff(starts).tolist(), pa.int64()),
                        pa.array(keys + [b"".join(x) for x in of], pa.binary()), pa.array(data + [None] * block.rows, pa.binary()),
                    ],
                    ["kind", "doc_id", "n_tokens", "digests", "ids"],
                )

    def once(batches):
        """Rows by their digests: of neighbouring chunks with the same one the first, and every recipe."""
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            digest, chunk = batch.column("digests"), np.array(pc.equal(batch.column("kind"), "chunk"))
            same = np.empty(batch.num_rows, bool)
            same[0] = digest[0].as_py() == last
            same[1:] = np.array(pc.equal(digest.slice(1), digest.slice(0, batch.num_rows - 1)))
            yield batch.filter(pa.array(~(same & chunk)))  # of one digest chunks come before recipes
            last = digest[batch.num_rows - 1].as_py()

    schema = f"kind string, doc_id {id_type}, n_tokens long, digests binary, ids binary"
    # Recipes go by id, so that the copies of a text are not one group.
    dealt = rows.mapInArrow(shared.tidy(encode), schema).repartition(F.when(F.col("kind") == "chunk", F.xxhash64("digests")).otherwise(F.xxhash64("doc_id"))).sortWithinPartitions("digests", "kind")
    dealt.mapInArrow(shared.tidy(once), schema).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{folder}/encoded")
    encoded = spark.read.schema(schema).parquet(f"{folder}/encoded")
    plain = encoded.filter("kind = 'recipe'").select("doc_id", "n_tokens", "digests")
    placed = shared.table(spark, plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "digests").withColumn("part", F.spark_partition_id()), "placed")
    totals = {r.part: r.n for r in placed.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each range
    before, at = {}, 0
    for part in sorted(totals):
        before[part], at = at, at + totals[part]

    def number(batches):
        """Starts of the documents of one range, in order."""
        done: dict[int, int] = {}
        for batch in batches:
            part, n = np.array(batch.column("part")), np.array(batch.column("n_tokens"))
            start = np.empty(len(n), np.int64)
            for p in np.unique(part):
                own = part == p
                sums = np.cumsum(n[own])
                start[own] = before[int(p)] + done.get(int(p), 0) + sums - n[own]
                done[int(p)] = done.get(int(p), 0) + int(sums[-1])
            leaves = [_leaf(*x) for x in zip(batch.column("doc_id").to_pylist(), n.tolist(), start.tolist(), batch.column("digests").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start), pa.array(leaves, pa.binary())], [*batch.schema.names, "start", "leaf"])

    # A range is a Spark partition again: it is sorted, and split no further.
    ranged = placed.repartition("part").sortWithinPartitions("part", "doc_id", "digests")
    numbered = ranged.mapInArrow(shared.tidy(number), f"doc_id {id_type}, n_tokens long, digests binary, part int, start long, leaf binary")
    numbered.write.parquet(f"{folder}/recipes")

    lines = list(_roots(spark.read.parquet(f"{folder}/recipes")).items())
    spark.createDataFrame(lines, "part int, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def _leaf(key: int | None, n: int, start: int, digests: bytes) -> bytes:
    own = merkle([digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)])
    return _digest(b"\x00" + repr((key, n, start)).encode() + own)


def _leaves(spark: SparkSession, folder: str) -> DataFrame:
    """part, start and Merkle leaf of every stored recipe."""

    def run(batches):
        for batch in batches:
            got = [_leaf(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "start", "digests")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("start"), pa.array(got, pa.binary())], ["part", "start", "leaf"])

    return spark.read.parquet(f"{folder}/recipes").select("part", "start", "doc_id", "n_tokens", "digests").mapInArrow(shared.tidy(run), "part int, start long, leaf binary")


def _roots(leaves: DataFrame) -> dict[int, bytes]:
    """The Merkle root of each range, in the order of its starts, and under -1 the one over all; leaves stay on the executors."""

    def run(batches):
        own: dict[int, Merkle] = {}
        for batch in batches:
            for part, leaf in zip(batch.column("part").to_pylist(), batch.column("leaf").to_pylist(), strict=True):
                own.setdefault(part, Merkle()).add(leaf)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x.root() for x in own.values()], pa.binary())], ["part", "root"])

    dealt = leaves.select("part", "start", "leaf").repartition("part").sortWithinPartitions("part", "start")
    got = {r.part: bytes(r.root) for r in dealt.mapInArrow(shared.tidy(run), "part int, root binary").collect()}  # a row for each range
    return got | {-1: merkle([got[p] for p in sorted(got)])}


def _manifest(spark: SparkSession, folder: str) -> dict[int, bytes]:
    return {r.part: bytes(r.root) for r in spark.read.parquet(f"{folder}/manifest").collect()}


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> list[list[int]]:
    """What each value of each byte of a CRC-32 becomes past so many zero bytes."""
    zeros = b"\x00" * n_bytes
    base = zlib.crc32(zeros, 0)
    bits = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32).reshape(4, 8)
    on = (np.arange(256)[:, None] >> np.arange(8)) & 1 == 1
    return [np.bitwise_xor.reduce(np.where(on, row, np.uint32(0)), axis=1).tolist() for row in bits]


def joined_crc(crcs: list[int], sizes: list[int]) -> int:
    """CRC-32 of a concatenation from those of its parts and their lengths in bytes."""
    out = 0
    for crc, size in zip(crcs, sizes, strict=True):
        a, b, c, d = _shift(size)
        out = a[out & 255] ^ b[out >> 8 & 255] ^ c[out >> 16 & 255] ^ d[out >> 24] ^ crc
    return out


def chunk_ids(digest: bytes, data: bytes) -> np.ndarray:
    """A stored chunk's ids, checked against its digest."""
    ids = np.frombuffer(data, "<u2").astype("<u4") if len(data) % 2 == 0 else np.frombuffer(data[1:], "<u4")
    if _digest(ids.tobytes()) != digest:
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return ids


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/encoded").filter("kind = 'chunk'").select(F.col("digests").alias("digest"), "ids")


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether the recipes give the Merkle roots of the manifest."""
    return _roots(_leaves(spark, folder)) == _manifest(spark, folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of every document, rebuilt from its chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    chunks = _chunks(spark, folder)
    # Every document has a token, so that its start is a key.
    parts = recipes.select("doc_id", "start", F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST} - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("nr", "digest"))

    def build(rows):
        import pandas as pd

        rows = rows.sort_values("nr")
        ids = np.concatenate([chunk_ids(bytes(d), bytes(x)) for d, x in zip(rows["digest"], rows["ids"], strict=True)])
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "start": [rows["start"].iloc[0]], "ids": [ids.astype(np.int64).tolist()]})

    return parts.join(chunks, "digest").groupBy("start").applyInPandas(build, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, ids array<long>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    Each stored chunk is read and checked once; only its CRC and length travel to the recipes. The
    recipes that the rows are made from must give the Merkle roots of the manifest.
    """

    def check(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids = [chunk_ids(k, x) for k, x in zip(keys, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int64())], ["digest", "crc", "n"])

    chunks = _chunks(spark, folder).mapInArrow(shared.tidy(check), "digest binary, crc long, n long")
    recipes = spark.read.parquet(f"{folder}/recipes").drop("leaf")  # made anew below
    parts = recipes.select("start", F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST} - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")).alias("nr", "digest"))
    whole = parts.join(chunks, "digest").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("nr", "crc", "n"))).alias("parts"))

    def combine(batches):
        for batch in batches:
            parts = batch.column("parts")
            flat = parts.flatten()
            crcs, sizes = (flat.field(name).to_numpy().tolist() for name in ("crc", "n"))
            at = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())]).tolist()
            if [sum(sizes[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)] != batch.column("n_tokens").to_pylist():
                raise ValueError("a recipe doesn't give its document's length")
            out = [joined_crc(crcs[a:z], [4 * k for k in sizes[a:z]]) for a, z in zip(at[:-1], at[1:], strict=True)]
            leaves = [_leaf(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "start", "digests")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64()), batch.column("part"), pa.array(leaves, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "leaf"])

    rebuilt = recipes.join(whole, "start").select("doc_id", "start", "n_tokens", "digests", "part", "parts")
    rebuilt = shared.table(spark, rebuilt.mapInArrow(shared.tidy(combine), f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long, part int, leaf binary"), "rebuilt")
    if _roots(rebuilt) != _manifest(spark, folder):
        raise ValueError("the recipes don't give the roots of the manifest")
    return rebuilt.drop("part", "leaf")


def new_folder(spark: SparkSession) -> str:
    return f"{shared.root(spark)}/store-{uuid.uuid4().hex}"
