"""Repeated spans of words, found in a compacted de Bruijn graph and taken out.

Nodes are windows of consecutive words, edges the runs of one word more that lead from a window to the next one. Only windows that occur
at least twice are of interest, and only those whose seed (the least hash among their shorter runs of words) occurs
in several places can; all others never leave the task that read them. Windows are counted in Spark by ranges of their hashes, with what stands before and
after them. Where all occurrences of a window go on, or come, the same way, the ends of texts included, no path branches;
each text is cut between windows where one branches. The pieces are whole nonbranching paths, so that equal pieces
stand wherever their path does. Each is digested from the words at its own coordinates and joined with the path of that digest: a path with a single
occurrence rests on equal hashes of different windows, and all windows with these hashes are then compared by their own digests. So
hashes only choose what is compared, and removal is exact but for 128-bit digests.

Sorted hash arrays lie in the shared folder and are mapped by the workers, which look up what they need in ascending order.
Frequent windows are combined where they are read, so that each brings one entry for each batch of millions.

Edge cases: a null text has no words; a text of fewer words than a window stays as it is; repeated rows are copies of each
other, whatever their ids; a window that is found twice in one text, overlapping itself or not, is repeated; a very long text is a block of its own; an empty
table gives no rows; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared
from .lm import _bucket, _Counter, _emit, _mapped, _merged
from .pieces import ragged

WINDOW, SEED = 35, 11
FLUSH = 2_000_000
_A = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFF)  # before the first word and after the last
REPEATED, ONE_NEXT, ONE_BEFORE = 1, 2, 4


@dataclass(frozen=True)
class Graph:
    """Where the arrays lie: ``seeds`` and ``nodes`` in ``files`` files each. ``bits`` of a window's hash are used."""

    folder: str
    files: int
    window: int
    seed: int
    bits: int


def _after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bs.mix(a * _A + b)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, by doubling; len(h) - n + 1 of them."""
    out, size, power, p = None, 0, h, 1
    while True:
        if n & p:
            if out is None:
                out = power
            else:
                m = max(min(len(out), len(power) - size), 0)
                out = _after(out[:m], power[size : size + m])
            size += p
        if 2 * p > n:
            return out
        power, p = _after(power[: max(len(power) - p, 0)], power[p:]), 2 * p


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` consecutive values."""
    s = 1
    while 2 * s <= width:
        x, s = best(x[: max(len(x) - s, 0)], x[s:]), 2 * s
    rest = width - s
    return best(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x[: max(len(x) - rest, 0)]


@dataclass
class Text:
    """Words of a block and, for each place where a window of one row begins, its seed and hash."""

    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    at: np.ndarray
    seeds: np.ndarray
    chosen: np.ndarray
    nodes: np.ndarray


def read(block: bs.Block, g: Graph) -> Text:
    starts, ends, first = bs.spans(block.raw, block.offsets, bs.SPACED)
    h = bs.hashes(block.raw, starts, ends)
    n, wide = len(h), g.window - g.seed + 1
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)  # words of the row from here on
    if n < g.window:
        none = np.zeros(0, np.uint64)
        return Text(h, starts, ends, first, np.zeros(0, np.int64), none, none, none)
    fine = left[: n - g.window + 1] >= g.window
    runs = grams(h, g.seed)
    least = sliding(runs, wide, np.minimum)
    # A run of words is chosen where it is the seed of a window that it lies in.
    most = sliding(np.concatenate([np.zeros(wide - 1, np.uint64), np.where(fine, least, np.uint64(0)), np.zeros(wide - 1, np.uint64)]), wide, np.maximum)
    chosen = runs[most == runs]
    at = np.flatnonzero(fine)
    nodes = grams(h, g.window)[at] >> np.uint64(64 - g.bits) << np.uint64(64 - g.bits)
    return Text(h, starts, ends, first, at, least[at], chosen, nodes)


def looked_up(keys: np.ndarray, g: Graph, kind: str, values: str | None = None) -> np.ndarray:
    """The values of keys in ascending or any order, 0 where there are none; without ``values``, whether they are there."""
    distinct, back = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.uint8)
    cuts = np.searchsorted(_bucket(distinct, g.files), np.arange(g.files + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
        own, part = _mapped(f"{g.folder}/{kind}-{b}.keys", np.uint64), distinct[cuts[b] : cuts[b + 1]]
        if len(own):
            at = np.minimum(np.searchsorted(own, part), len(own) - 1)
            out[cuts[b] : cuts[b + 1]] = np.where(own[at] == part, _mapped(f"{g.folder}/{kind}-{b}.{values}", np.uint8)[at] if values else 1, 0)
    return out[back]


def _stored(keys_of, texts: DataFrame, g: Graph, kind: str) -> None:
    """Files of the keys that occur at least twice among what ``keys_of`` reads in blocks."""

    def count(batches):
        held = _Counter(lambda h: _bucket(h, g.files))
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                yield from held.add(keys_of(block))
        yield from held.flush()

    def store(rows):
        import pandas as pd

        keys, counts = _merged(rows)
        shared.put(f"{g.folder}/{kind}-{int(rows['bucket'].iloc[0])}.keys", keys[counts > 1].tobytes())
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1]})

    _complete(texts.mapInArrow(shared.tidy(count), "bucket int, keys binary, counts binary").groupBy("bucket").applyInPandas(store, "bucket int"), g, kind, ["keys"])


def _complete(done: DataFrame, g: Graph, kind: str, parts: list[str]) -> None:
    """Run what writes files, and make the empty ones that nothing was for, in tasks."""
    all_files = done.sparkSession.range(g.files).select(F.col("id").cast("int").alias("bucket"))

    def fill(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                for p in parts:
                    shared.put(f"{g.folder}/{kind}-{b}.{p}", b"")
            yield batch

    all_files.join(done, "bucket", "left_anti").mapInArrow(fill, "bucket int").write.format("noop").mode("overwrite").save()


def _sides(t: Text, own: np.ndarray, g: Graph) -> np.ndarray:
    """What stands before and after windows, 32 bits each and never 0."""
    row = np.searchsorted(t.first, own, "right") - 1
    short = (t.words >> np.uint64(33)) + np.uint64(1)
    before = np.where(own > t.first[row], short[own - 1], _NONE)
    beyond = own + g.window
    after = np.where(beyond < t.first[row + 1], short[np.minimum(beyond, len(short) - 1)], _NONE)
    return before << np.uint64(32) | after


def _combined(keys: np.ndarray, sides: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sides (0 for one that isn't always the same) and summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, sides, counts = keys[order], sides[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    both = np.zeros(len(at), np.uint64)
    for shift in (32, 0):
        side = sides >> np.uint64(shift) & np.uint64(0xFFFFFFFF)
        low, high = (f.reduceat(side, at) if len(at) else side for f in (np.minimum, np.maximum))
        both |= np.where(low == high, low, np.uint64(0)) << np.uint64(shift)
    return keys[at], both, np.add.reduceat(counts, at) if len(at) else counts


def build(texts: DataFrame, window: int = WINDOW, seed: int = SEED, file_bytes: int = 32 << 20, bits: int = 64) -> Graph:
    """Count the windows of every row of the only column. ``file_bytes``: text for each file of windows."""
    spark = texts.sparkSession
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    g = Graph(shared.posix_folder(spark, "de-bruijn"), max(4, math.ceil(size / file_bytes)), window, min(seed, window), bits)
    _stored(lambda block: read(block, g).chosen, texts, g, "seeds")

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                t = read(block, g)
                own = np.flatnonzero(looked_up(t.seeds, g, "seeds"))
                held.append(_combined(t.nodes[own], _sides(t, t.at[own], g), np.ones(len(own), np.uint64)))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def packed(held) -> pa.RecordBatch:
        keys, sides, counts = _combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        bucket = _bucket(keys, g.files)
        out = _emit(bucket, keys, counts)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        return out.append_column("sides", pa.array([sides[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))

    def store(rows):
        import pandas as pd

        b = int(rows["bucket"].iloc[0])
        whole = (np.concatenate([bs.unplanes(x, np.uint64) for x in rows[c]]) for c in ("keys", "counts"))
        keys, counts = whole
        keys, sides, counts = _combined(keys, np.concatenate([np.frombuffer(x, np.uint64) for x in rows["sides"]]), counts)
        keep = counts > 1
        flags = REPEATED + ONE_NEXT * (sides & np.uint64(0xFFFFFFFF) > 0) + ONE_BEFORE * (sides >> np.uint64(32) > 0)
        shared.put(f"{g.folder}/nodes-{b}.keys", keys[keep].tobytes())
        shared.put(f"{g.folder}/nodes-{b}.flags", flags[keep].astype(np.uint8).tobytes())
        shared.give_back()
        return pd.DataFrame({"bucket": [b]})

    done = texts.mapInArrow(shared.tidy(count), "bucket int, keys binary, counts binary, sides binary").groupBy("bucket").applyInPandas(store, "bucket int")
    _complete(done, g, "nodes", ["keys", "flags"])
    return g


class _Spaced:
    """Words of a block with one space after each, to digest spans from."""

    def __init__(self, block: bs.Block, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts + 1
        self.at = np.concatenate([[0], np.cumsum(size)])
        padded = np.append(block.raw, np.uint8(0x20))
        self.bytes = padded[np.minimum(ragged(starts, size), len(block.raw))]
        self.bytes[self.at[1:] - 1] = 0x20

    def digest(self, a: int, z: int) -> bytes:
        """Of the words from a up to z."""
        return hashlib.blake2b(self.bytes[self.at[a] : self.at[z]], digest_size=16).digest()


def _pieces(t: Text, g: Graph) -> tuple[np.ndarray, np.ndarray]:
    """First words of the block's nonbranching repeated paths, and their numbers of windows."""
    own = np.flatnonzero(looked_up(t.seeds, g, "seeds"))
    flags = looked_up(t.nodes[own], g, "nodes", "flags")
    own, flags = t.at[own[flags > 0]], flags[flags > 0]
    if not len(own):
        return own, own
    on = np.zeros(len(own), bool)
    on[1:] = (own[1:] == own[:-1] + 1) & (flags[:-1] & ONE_NEXT > 0) & (flags[1:] & ONE_BEFORE > 0)
    row = np.searchsorted(t.first, own, "right")
    on[1:] &= row[1:] == row[:-1]
    heads = np.flatnonzero(~on)
    return own[heads], np.diff(np.append(heads, len(own)))


_OCCURRENCE = "start long, size long, k1 long, k2 long"


def _occurring(rows: DataFrame, find, n_place: int, window: int) -> DataFrame:
    """The columns of ``rows`` (places, then a text) without the text, and a row for each span that ``find`` gives in a block: its first word in the row, its number of
    windows and two halves of its digest."""
    names = rows.columns[:n_place]

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(n_place)):
                t, a, m = find(block)
                if not len(a):
                    continue
                spaced = _Spaced(block, t.starts, t.ends)
                row = np.searchsorted(t.first, a, "right") - 1
                digests = np.frombuffer(b"".join(spaced.digest(x, x + n + window - 1) for x, n in zip(a.tolist(), m.tolist(), strict=True)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(block.first + row)) for c in range(n_place)), pa.array(a - t.first[row]), pa.array(m), pa.array(digests[:, 0]), pa.array(digests[:, 1])],
                    [*names, "start", "size", "k1", "k2"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n_place])
    return rows.mapInArrow(shared.tidy(run), f"{kinds}, {_OCCURRENCE}")


def occurrences(rows: DataFrame, g: Graph) -> DataFrame:
    """Places (shared.PLACE), start and size of every repeated path in located rows (text), with its source: the coordinates of its first occurrence.

    source is null for windows that have been compared one by one.
    """
    spark, n = rows.sparkSession, len(shared.PLACE)
    given = rows.select(*shared.PLACE, "text")

    def find(block):
        t = read(block, g)
        return t, *_pieces(t, g)

    found = shared.table(spark, _occurring(given, find, n, g.window), "paths")
    source = F.min(F.struct(*shared.PLACE, "start"))
    paths = shared.table(spark, found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), source.alias("source")), "sources")
    verified = found.join(paths.filter("n > 1"), ["k1", "k2"])
    lone = paths.filter("n = 1")
    if lone.isEmpty():
        return verified.select(*shared.PLACE, "start", "size", "source")
    # Different windows with equal hashes: compare every window that has such a hash.
    where = lone.select("source.*").join(found, [*shared.PLACE, "start"]).groupBy(*shared.PLACE).agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    doubted = shared.picked(given, where).select("text", "spans")

    def hashed(batches):
        for batch in batches:
            spans = batch.column(1).to_pylist()
            held: list[np.ndarray] = []
            for block in bs.blocks(batch.column(0)):
                t = read(block, g)
                row = np.searchsorted(t.first, t.at, "right") - 1
                inside = np.zeros(len(t.at), bool)
                for r in range(block.rows):
                    for s in spans[block.first + r]:
                        inside |= (row == r) & (t.at >= t.first[r] + s["start"]) & (t.at < t.first[r] + s["start"] + s["size"])
                held.append(t.nodes[inside])
            keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            if len(keys):
                yield _emit(_bucket(keys, g.files), keys, np.ones(len(keys), np.uint64))

    def store(rows):
        import pandas as pd

        shared.put(f"{g.folder}/doubted-{int(rows['bucket'].iloc[0])}.keys", _merged(rows)[0].tobytes())
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1]})

    _complete(doubted.mapInArrow(shared.tidy(hashed), "bucket int, keys binary, counts binary").groupBy("bucket").applyInPandas(store, "bucket int"), g, "doubted", ["keys"])

    def compare(block):
        t = read(block, g)
        own = t.at[looked_up(t.nodes, g, "doubted") > 0]
        return t, own, np.ones(len(own), np.int64)

    single = shared.table(spark, _occurring(given, compare, n, g.window), "windows")
    again = single.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
    one_by_one = single.join(again, ["k1", "k2"]).withColumn("source", F.lit(None).cast(paths.schema["source"].dataType))
    return verified.select(*shared.PLACE, "start", "size", "source").unionByName(one_by_one.select(*shared.PLACE, "start", "size", "source"))


def _kept(words: np.ndarray, spaced: _Spaced, a: int, z: int) -> bytes:
    """The kept words of a row, joined by single spaces."""
    own = spaced.bytes[spaced.at[a] : spaced.at[z]]
    return own[np.repeat(words[a:z], np.diff(spaced.at[a : z + 1]))].tobytes()[:-1]


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, with_text: bool = False, bits: int = 64) -> DataFrame:
    """id, n_words, n_removed (words in windows that occur elsewhere too) and kept_sha256, the digest of the other words joined by spaces; ``with_text``: also
    these words (kept). All rows of ``docs`` are judged as they are given."""
    spark = docs.sparkSession
    rows = shared.located(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    spans = shared.table(spark, occurrences(rows, build(rows.select("text"), window, seed, bits=bits)).select(*shared.PLACE, "start", "size"), "spans")
    few = spans.limit(shared.MOST_ROWS + 1).count() <= shared.MOST_ROWS
    spans = spans.groupBy(*shared.PLACE).agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    whole = rows.join(F.broadcast(spans) if few else spans, shared.PLACE, "left").select("id", "text", "starts", "sizes")

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(1)):
                starts, ends, first = bs.spans(block.raw, block.offsets, bs.SPACED)
                edge = np.zeros(len(starts) + 1, np.int64)
                lists = [batch.column(c).slice(block.first, block.rows) for c in (2, 3)]
                n_spans = np.array([len(x) if x is not None else 0 for x in lists[0].to_pylist()])
                a = np.repeat(first[:-1], n_spans) + lists[0].flatten().to_numpy(zero_copy_only=False)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + lists[1].flatten().to_numpy(zero_copy_only=False) + window - 1, -1)
                stays = np.cumsum(edge)[:-1] == 0
                spaced = _Spaced(block, starts, ends)
                kept = [_kept(stays, spaced, x, z) for x, z in zip(first[:-1], first[1:], strict=True)]
                n = np.diff(first)
                out = [batch.column(0).slice(block.first, block.rows), pa.array(n), pa.array(n - bs.row_sums(stays, first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                out += [pa.array([k.decode() for k in kept])] if with_text else []
                yield pa.RecordBatch.from_arrays(out, ["id", "n_words", "n_removed", "kept_sha256", "kept"][: len(out)])

    kind = rows.schema["id"].dataType.simpleString()
    return whole.mapInArrow(shared.tidy(run), f"id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
