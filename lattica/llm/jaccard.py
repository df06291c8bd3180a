"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed shingles of five words. Texts with equal sets are one class, of which one
member goes on. Banded MinHash values give candidate links, their connected components are the only
places to look for pairs, and inside a component blocks are compared with blocks: MinHash values
are compared a few at a time, a pair is dropped once the posterior probability that its similarity
reaches the threshold falls below the tolerance, and what remains is verified with the sets
themselves. Pairs are counted and joined to components where they are found; they never become rows.

Rows are told apart by their places in files, never by ids. Edge cases: a null text, or one without
words, has no shingles, belongs to a class of its own and has no links; a text of fewer than five
words is one shingle; a class is named by its first row, the one with the least id (rows without an id
come last, equal ids in the order of rows); rows that repeat an id are documents of their own, copies of
each other if their texts are equal; ids may be of any type with an order; a very long text is one row
among others, in a block bounded by bytes; an empty table gives no rows; extra columns, whatever their
names, are never read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, PER_BAND = 32, 4
HASHES = BANDS * PER_BAND
STEP, TOLERANCE = 16, 1e-6
#: Texts and bytes of sets in a block of a large component and in a group of small ones; rows compared at once.
BLOCK, CELL, BLOCK_BYTES, STRIPE = 2048, 1000, 16 << 20, 512
_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(block: bs.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row in order, and each row's first."""
    h, first = bs.words(block)
    n = np.diff(first)
    out = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        moved = np.zeros(len(h), np.uint64)
        moved[: max(len(h) - k, 0)] = h[k:]
        short = np.arange(len(h)) + k >= np.repeat(first[1:], n)
        moved[short] = 0
        out = (out + moved) * np.uint64(0x9E3779B97F4A7C15)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    here = (place == 0) | (place + SHINGLE <= np.repeat(n, n))
    counts = bs.row_sums(here, first)
    return bs.mix(out[here]), np.concatenate([[0], np.cumsum(counts)])


def _sets(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row in ascending order, and each row's first."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[new], np.searchsorted(row[new], np.arange(len(first)))


def signatures(rows: DataFrame) -> DataFrame:
    """Rows (id, text and their places) with two halves of the set's digest, n (its size) and sig (MinHash values)
    in place of the text; ``bare`` is a hash of a text without words."""
    shared.small_batches(rows.sparkSession)
    kept = [*shared.PLACE, "id", "bare"]

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(len(kept))):
                x, first = _sets(*shingles(block))
                n = np.diff(first)
                some = np.flatnonzero(n)
                at = first[:-1][some]
                sig = np.zeros((block.rows, HASHES), np.uint32)
                if len(at):
                    for k in range(HASHES):
                        sig[some, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], at) >> np.uint64(32)
                digest = [bs.row_sums(bs.mix(x ^ np.uint64(s)), first).view(np.int64) for s in (0x51ED27, 0xA3B195)]
                offsets = pa.py_buffer((np.arange(block.rows + 1) * HASHES * 4).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), block.rows, [None, offsets, pa.py_buffer(sig)])
                own = [batch.column(c).slice(block.first, block.rows) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(d) for d in digest), pa.array(n), packed], [*kept, "d1", "d2", "n", "sig"])

    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    given = rows.select(*shared.PLACE, "id", F.when(wordless, F.xxhash64("text")).alias("bare"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(shared.tidy(run), f"{kinds}, d1 long, d2 long, n long, sig binary")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """nr and the set as ascending 64-bit hashes of rows (nr, text)."""

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(1)):
                x, first = _sets(*shingles(block))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array([x[a:z].tobytes() for a, z in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["nr", "items"])

    return rows.select("nr", "text").mapInArrow(shared.tidy(run), "nr long, items binary")


@lru_cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Least number of equal values, by compared values, at which a pair stays: its posterior under a
    uniform prior that the similarity reaches the threshold is at least the tolerance."""

    def tail(m: int, n: int) -> float:
        """Of the Beta(m + 1, n - m + 1) distribution above the threshold, as a binomial sum."""
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next((m for m in range(n + 1) if tail(m, n) >= tolerance), n) for n in range(STEP, HASHES + 1, STEP)]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least place that each of n places is linked to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(before, root):
            return root


def linked(sig_a, items_a, sig_b, items_b, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in a, places in b) whose sets reach the threshold; with ``same`` only those in order.

    Some rows of a meet all of b at a time, so that memory doesn't grow with the number of pairs.
    """
    found = [_linked(sig_a, items_a, sig_b, items_b, range(lo, min(lo + STRIPE, len(sig_a))), threshold, tolerance, same) for lo in range(0, len(sig_a), STRIPE)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(j for _, j in found)])


def _linked(sig_a, items_a, sig_b, items_b, own: range, threshold: float, tolerance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    sig_a, items_a = sig_a[own.start : own.stop], items_a[own.start : own.stop]
    equal = np.zeros((len(sig_a), len(sig_b)), np.uint8)
    alive = np.triu(np.ones(equal.shape, bool), own.start + 1) if same else np.ones(equal.shape, bool)
    i, j = None, None
    for step, least in enumerate(least_matches(threshold, tolerance)):
        columns = range(step * STEP, (step + 1) * STEP)
        if i is None:
            for k in columns:
                equal += sig_a[:, k][:, None] == sig_b[:, k][None]
            i, j = np.nonzero(alive & (equal >= least))
            have = equal[i, j].astype(np.int32)
        else:
            for k in columns:
                have += sig_a[i, k] == sig_b[j, k]
            keep = have >= least
            i, j, have = i[keep], j[keep], have[keep]
    if not len(i):
        return i, j
    both = _intersections(items_a, items_b, i, j)
    size_a, size_b = np.array([len(s) for s in items_a]), np.array([len(s) for s in items_b])
    good = both >= threshold * (size_a[i] + size_b[j] - both) - 1e-9
    return i[good] + own.start, j[good]


def _intersections(items_a, items_b, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of pairs: one by one if few, else by products of membership matrices."""
    rows_a, rows_b = np.unique(i), np.unique(j)
    if len(i) < 4 * (len(rows_a) + len(rows_b)):
        return np.array([len(np.intersect1d(items_a[a], items_b[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    flat_a, flat_b = np.concatenate([items_a[a] for a in rows_a]), np.concatenate([items_b[b] for b in rows_b])
    common = np.intersect1d(flat_a, flat_b)
    owner_a, owner_b = np.repeat(np.arange(len(rows_a)), [len(items_a[a]) for a in rows_a]), np.repeat(np.arange(len(rows_b)), [len(items_b[b]) for b in rows_b])
    place = lambda flat: np.minimum(np.searchsorted(common, flat), max(len(common) - 1, 0))
    if not len(common):
        return np.zeros(len(i), np.int64)
    at_a, at_b = place(flat_a), place(flat_b)
    in_a, in_b = common[at_a] == flat_a, common[at_b] == flat_b
    total = np.zeros((len(rows_a), len(rows_b)), np.float32)
    width = 4096
    for lo in range(0, len(common), width):
        a, b = np.zeros((len(rows_a), width), np.float32), np.zeros((len(rows_b), width), np.float32)
        for m, owner, at, ok in ((a, owner_a, at_a, in_a), (b, owner_b, at_b, in_b)):
            pick = ok & (at >= lo) & (at < lo + width)
            m[owner[pick], at[pick] - lo] = 1
        total += a @ b.T
    return total[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)].astype(np.int64)


def _compare(rows, threshold: float, tolerance: float):
    """Links within one group of candidates: nr, root (least nr it is tied to here), texts and others linked."""
    import pandas as pd

    out = []
    rows = rows.sort_values(["comp", "nr"], kind="stable")
    comp, ids, block, copies = (rows[c].to_numpy() for c in ("comp", "nr", "block", "copies"))
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), HASHES)
    items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
    cuts = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))
    low, high = rows["lo"].to_numpy(), rows["hi"].to_numpy()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if low[a] == high[a]:
            at, to = linked(sig[a:z], items[a:z], sig[a:z], items[a:z], threshold, tolerance, same=True)
        else:
            left, right = np.flatnonzero(block[a:z] == low[a]), np.flatnonzero(block[a:z] == high[a])
            at, to = linked(sig[a + left], [items[a + k] for k in left], sig[a + right], [items[a + k] for k in right], threshold, tolerance)
            at, to = left[at], right[to]
        if len(at):
            root = _roots(z - a, at, to)
            texts = np.bincount(at, minlength=z - a) + np.bincount(to, minlength=z - a)
            others = np.bincount(at, copies[a + to], z - a) + np.bincount(to, copies[a + at], z - a)
            some = np.flatnonzero(texts)
            out.append(pd.DataFrame({"nr": ids[a + some], "root": ids[a + root[some]], "texts": texts[some], "others": others[some].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("nr", "root", "texts", "others")})


def _first(id_: str, nr: str):
    """The row that names a group: the one with the least id, rows without an id last."""
    return F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(nr).alias("nr")))


def _join(rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """For located rows (id, text): their places, what ``join`` returns, bare, and first: the number of the class's first row."""
    spark = rows.sparkSession
    signed = shared.table(spark, signatures(rows).withColumn("nr", F.monotonically_increasing_id()), "signatures")
    full = signed.filter("n > 0")
    classes = full.groupBy("d1", "d2").agg(_first("id", "nr").alias("f"), F.count(F.lit(1)).alias("copies"))
    classes = shared.table(spark, classes.select("d1", "d2", F.col("f.id").alias("copy_id"), F.col("f.nr").alias("copy_nr"), "copies"), "classes")
    reps = full.join(classes.select(F.col("copy_nr").alias("nr"), "copies"), "nr")
    reps = shared.table(spark, reps.select("nr", "sig", "copies", "n"), "representatives")

    part = lambda b: F.xxhash64(F.lit(b), F.substring("sig", 1 + b * PER_BAND * 4, PER_BAND * 4))
    bands = reps.select("nr", F.explode(F.array(*(part(b) for b in range(BANDS)))).alias("band"))
    least = bands.groupBy("band").agg(F.min("nr").alias("u"), F.max("nr").alias("top")).filter("u < top").select("band", "u")
    edges = bands.join(least, "band").filter("nr > u").select("u", F.col("nr").alias("v"))
    found = components(edges).select(F.col("v").alias("nr"), F.col("label").alias("comp")).join(reps, "nr")
    found = shared.table(spark, found, "candidates")

    # Blocks of large components meet pairwise; small components share groups. Both are bounded by texts and by bytes.
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    sizes = sizes.select("comp", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("items") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    large = shared.table(spark, sizes.filter("blocks > 1"), "large")  # by far fewer than texts, so that these needn't be dealt out by component
    large = F.broadcast(large) if large.limit(shared.MOST_ROWS + 1).count() <= shared.MOST_ROWS else large
    count, items = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_cells = max(1, math.ceil(count / CELL), math.ceil(items * 8 / BLOCK_BYTES))
    own = shared.picked(rows, signed.join(found.select("nr"), "nr").select(*shared.PLACE, "nr"))
    wanted = found.join(large, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(shingle_sets(own), "nr").withColumn("block", F.pmod(F.xxhash64("nr"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = wanted.select("*", other).select(
        "nr", "comp", "block", "copies", "sig", "items", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(n_cells))).otherwise(F.xxhash64("comp")).alias("cell"), (F.col("blocks") > 1).alias("large"))
    links = dealt.groupBy("large", "cell", "lo", "hi").applyInPandas(lambda rows: _compare(rows, threshold, tolerance), "nr long, root long, texts long, others long")
    links = shared.table(spark, links, "links")

    labels = components(links.select(F.col("root").alias("u"), F.col("nr").alias("v"))).select(F.col("v").alias("copy_nr"), F.col("label"))
    sums = links.groupBy(F.col("nr").alias("copy_nr")).agg(F.sum("texts").alias("texts"), F.sum("others").alias("others"))
    tied = shared.table(spark, classes.select("copy_nr", "copy_id").join(labels, "copy_nr").join(sums, "copy_nr"), "tied")
    named = tied.groupBy("label").agg(_first("copy_id", "copy_nr").alias("f")).select("label", F.col("f.id").alias("class_id"), F.col("f.nr").alias("first"), F.lit(True).alias("named"))
    of_class = classes.join(tied.join(named, "label").drop("copy_id", "label"), "copy_nr", "left").withColumns({
        "class_id": F.when(F.col("named"), F.col("class_id")).otherwise(F.col("copy_id")), "first": F.coalesce("first", "copy_nr"), "known": F.lit(True)}).drop("named")
    whole = signed.select(*shared.PLACE, "id", "bare", "nr", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2").join(of_class, ["d1", "d2"], "left")
    pick = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.col("id")).alias(c)
    return whole.select(
        *shared.PLACE, "id", "bare", "nr", pick("class_id"), pick("copy_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
        (F.coalesce("others", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("first", "nr").alias("first"), (F.col("n") > 0).alias("has_words"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return shared.located(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: id, class_id, copy_id, n_copies, n_text_links, n_links, row_nr, class_nr.

    class_id: least id of the connected texts. copy_id: least id of the texts with the same shingles,
    n_copies: their number. n_text_links: different shingle sets at the threshold. n_links: other
    documents at the threshold, copies included. Where ids are null or repeat, class_nr tells classes apart: it is
    the row_nr of the class's first row.
    """
    got = _join(_rows(docs, key, text), threshold, tolerance)
    return got.select("id", "class_id", "copy_id", "n_copies", "n_text_links", "n_links", F.col("nr").alias("row_nr"), F.col("first").alias("class_nr"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents, with all columns, that are the first of their class.

    Rows that repeat an id and a text without words are one document; other texts without words all stay, and so
    does every text that isn't near another, whatever its id.
    """
    spark = docs.sparkSession
    here = shared.located(shared.renamed(docs))
    named = lambda c: F.col(f"__{docs.columns.index(c)}")
    joined = _join(here.select(*shared.PLACE, named(key).alias("id"), named(text).alias("text")), threshold, tolerance)
    joined = shared.table(spark, joined.filter("first <> nr or not has_words").select(*shared.PLACE, "id", "bare", "nr", "has_words"), "later")
    again = joined.filter("not has_words and id is not null")
    least = again.groupBy("id", "bare").agg(F.min("nr").alias("nr")).select("nr")
    gone = joined.filter("has_words").unionByName(again.join(least, "nr", "left_anti"))
    return shared.without(here, gone).toDF(*docs.columns)
