"""Interpolated modified Kneser-Ney bigram model.

Words are counted in Spark, stored as sorted hash arrays in the shared folder and memory-mapped by
the workers that score. No table of words or bigrams passes through the driver: it sees one row of
totals for each file. Frequent first words are dealt out over several files, so none grows with
one word's share.

Counts are exact at any size; word ids have 32 bits, and more distinct words than these are an error.

Edge cases: a null or empty text has one token, its end; a model of no documents knows no token and
gives every token the probability 1; repeated rows count as often as they occur; a very long text is a
block of its own; words with equal 64-bit hashes are one word; extra columns, whatever their names, are
never read.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared

END = bs.word_hash(" end ")  # has spaces, so no word equals it
UNKNOWN, START = 0xFFFFFFFF, 0xFFFFFFFE
MANY = 0xFFFFFFFF  # pairs that occur so often or more have their counts in a file of their own
FLUSH = 3_000_000
PACKED = "bucket int, keys binary, counts binary"


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of hashes, so that files in order hold all keys in order."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _emit(bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[a]) for a, _ in parts], pa.int32()),
            pa.array([bs.planes(keys[a:b]) for a, b in parts], pa.binary()),
            pa.array([bs.planes(counts[a:b].astype(np.uint64)) for a, b in parts], pa.binary()),
        ],
        ["bucket", "keys", "counts"],
    )


class _Counter:
    """Counts of keys that are handed on whenever many have gathered."""

    def __init__(self, bucket):
        self.bucket, self.held, self.size = bucket, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        self.held.append((keys, counts))
        self.size += len(keys)
        if self.size > FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = bs.merge_counts(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            self.held, self.size = [], 0
            yield _emit(self.bucket(keys), keys, counts)


def _merged(rows) -> tuple[np.ndarray, np.ndarray]:
    return bs.merge_counts(
        np.concatenate([bs.unplanes(x, np.uint64) for x in rows["keys"]]),
        np.concatenate([bs.unplanes(x, np.uint64) for x in rows["counts"]]),
    )


def _tokens(block: bs.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with an end after each row, and each row's first token."""
    h, first = bs.words(block)
    return np.insert(h, first[1:], np.uint64(END)), first + np.arange(len(first))


@dataclass
class Vocabulary:
    """Sorted word hashes in files; a word's id is its place among them."""

    folder: str
    offsets: np.ndarray
    tokens: int
    often: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ways: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def ids(self, sorted_hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending hashes; UNKNOWN for words that aren't there."""
        out = np.full(len(sorted_hashes), UNKNOWN, np.uint64)
        n = len(self.offsets) - 1
        cuts = np.searchsorted(_bucket(sorted_hashes, n), np.arange(n + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = _mapped(f"{self.folder}/word-{b}.keys", np.uint64)
            part = sorted_hashes[cuts[b] : cuts[b + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                out[cuts[b] : cuts[b + 1]] = np.where(own[at] == part, at.astype(np.uint64) + np.uint64(self.offsets[b]), np.uint64(UNKNOWN))
        return out

    def gather(self, what: str, dtype: type, ids: np.ndarray) -> np.ndarray:
        """Values of ascending known ids from the files of one kind."""
        out = np.zeros(len(ids), dtype)
        cuts = np.searchsorted(ids, self.offsets.astype(np.uint64))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            out[cuts[b] : cuts[b + 1]] = _mapped(f"{self.folder}/word-{b}.{what}", dtype)[(ids[cuts[b] : cuts[b + 1]] - np.uint64(self.offsets[b])).astype(np.int64)]
        return out

    def sequence(self, block: bs.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens before and at each place, and each row's first place."""
        h, first = _tokens(block)
        distinct, back = np.unique(h, return_inverse=True)
        here = self.ids(distinct)[back]
        before = np.empty_like(here)
        before[1:] = here[:-1]
        before[first[:-1]] = START
        return before, here, first

    def pair_bucket(self, pairs: np.ndarray, n: int) -> np.ndarray:
        """Files by first word; those of a frequent one are spread by the second."""
        before, here = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        out = bs.mix(before) % np.uint64(n)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, before), len(self.often) - 1)
            hot = self.often[at] == before
            out[hot] = (out[hot] + bs.mix(here[hot]) % self.ways[at[hot]]) % np.uint64(n)
        return out.astype(np.int64)


#: Files that a worker keeps mapped; those used longest ago are given up, as a process has a bounded number of maps.
MOST_MAPS = 16_384
_maps: dict[str, np.ndarray] = {}


def _mapped(path: str, dtype: type) -> np.ndarray:
    found = _maps.pop(path, None)
    if found is None:
        with open(path, "rb") as f:
            empty = not f.read(1)
        found = np.zeros(0, dtype) if empty else np.asarray(np.memmap(path, dtype, "r"))
        if len(_maps) >= MOST_MAPS:
            del _maps[next(iter(_maps))]
    _maps[path] = found  # the last used is the last
    return found


def _discounts(n: list[float]) -> np.ndarray:
    """D1, D2 and D3+ of n1..n4; fixed ones where a small corpus leaves a count of counts empty."""
    if min(n) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))])


@dataclass
class Model:
    words: Vocabulary
    pair_files: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    pairs: int
    left_over: float
    start_total: float
    start_weight: float

    def word_probability(self, followed: np.ndarray) -> np.ndarray:
        """Of words by the number of distinct words before them; 0 for unknown ones."""
        return (followed - self.word_discounts[np.minimum(followed, 3).astype(np.int64)]) / max(self.pairs, 1) + self.left_over / (self.words.size + 1)

    def pair_counts(self, distinct: np.ndarray) -> np.ndarray:
        out = np.zeros(len(distinct))
        bucket = self.words.pair_bucket(distinct, self.pair_files)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.pair_files + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            rows = order[cuts[b] : cuts[b + 1]]
            own = _mapped(f"{self.words.folder}/pair-{b}.keys", np.uint64)
            if len(own):
                at = np.minimum(np.searchsorted(own, distinct[rows]), len(own) - 1)
                found = np.where(own[at] == distinct[rows], _mapped(f"{self.words.folder}/pair-{b}.counts", np.uint32)[at], 0).astype(float)
                if (found >= MANY).any():
                    many, counts = _mapped(f"{self.words.folder}/pair-{b}.many", np.uint64).reshape(2, -1)
                    big = found >= MANY
                    found[big] = counts[np.searchsorted(many, distinct[rows][big])]
                out[rows] = found
        return out

    def score(self, block: bs.Block) -> dict[str, np.ndarray]:
        """For each row: tokens, known tokens, and base-10 log probabilities under unigrams and the model."""
        before, here, first = self.words.sequence(block)
        one, one_at = np.unique(here, return_inverse=True)
        known = one[one < np.uint64(START)]
        pad = len(one) - len(known)
        count = np.pad(self.words.gather("counts", np.uint64, known).astype(float), (0, pad))
        n, v = self.words.tokens, self.words.size
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        p_word = self.word_probability(np.pad(self.words.gather("followed", np.uint32, known).astype(float), (0, pad))) if v else np.ones(len(one))

        pair, pair_at = np.unique(before << np.uint64(32) | here, return_inverse=True)
        left, left_at = np.unique(pair >> np.uint64(32), return_inverse=True)
        known = left[left < np.uint64(START)]
        total, weight = np.zeros(len(left)), np.ones(len(left))
        total[: len(known)] = self.words.gather("totals", np.float64, known)
        weight[: len(known)] = self.words.gather("weights", np.float32, known)
        total[left == START], weight[left == START] = self.start_total, self.start_weight
        weight[total == 0] = 1.0
        c = self.pair_counts(pair)
        p = np.maximum(c - self.pair_discounts[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(total[left_at], 1)
        right = np.searchsorted(one, pair & np.uint64(0xFFFFFFFF))
        p = p + weight[left_at] * p_word[right]
        return {
            "n_tokens": np.diff(first),
            "n_known": np.add.reduceat((count > 0)[one_at].astype(np.int64), first[:-1]),
            "base_score": np.add.reduceat(base[one_at], first[:-1]),
            "score": np.add.reduceat(np.log10(p)[pair_at], first[:-1]),
        }


def _count_words(spark: SparkSession, texts: DataFrame, folder: str, n: int, threshold: float, n_rows: int) -> Vocabulary:
    def count(batches):
        held = _Counter(lambda h: _bucket(h, n))
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                yield from held.add(_tokens(block)[0])
        yield from held.flush()

    def store(rows):
        import pandas as pd

        b = int(rows["bucket"].iloc[0])
        keys, counts = _merged(rows)
        shared.put(f"{folder}/word-{b}.keys", keys.tobytes())
        shared.put(f"{folder}/word-{b}.counts", counts.tobytes())
        often = np.flatnonzero(counts > threshold)
        return pd.DataFrame({"bucket": [b], "size": [len(keys)], "total": [int(counts.sum())], "often": [often.astype(np.int64).tolist()], "counts": [counts[often].astype(np.int64).tolist()]})

    done = texts.mapInArrow(shared.tidy(count), PACKED).groupBy("bucket").applyInPandas(store, "bucket int, size long, total long, often array<long>, counts array<long>").collect()
    sizes = np.zeros(n, np.int64)
    for r in done:
        sizes[r.bucket] = r.size
    for b in {*range(n)} - {r.bucket for r in done}:
        for kind in ("keys", "counts"):
            shared.put(f"{folder}/word-{b}.{kind}", b"")
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= START:
        raise ValueError("more distinct words than 32-bit ids")
    often = sorted((int(offsets[r.bucket]) + i, c) for r in done for i, c in zip(r.often, r.counts, strict=True))
    often += [(START, n_rows)] if n_rows > threshold else []
    return Vocabulary(folder, offsets, sum(r.total for r in done), np.array([i for i, _ in often], np.uint64), np.array([math.ceil(c / threshold) for _, c in often], np.uint64))


def _count_pairs(spark: SparkSession, texts: DataFrame, words: Vocabulary, n: int, span: int) -> DataFrame:
    """Write the files of pairs; what they add to each word's totals, by ranges of ``span`` words."""
    folder = words.folder

    def count(batches):
        held = _Counter(lambda p: words.pair_bucket(p, n))
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                before, here, _ = words.sequence(block)
                yield from held.add(before << np.uint64(32) | here)
        yield from held.flush()

    def store(rows):
        import pandas as pd

        b = int(rows["bucket"].iloc[0])
        keys, counts = _merged(rows)
        shared.put(f"{folder}/pair-{b}.keys", keys.tobytes())
        shared.put(f"{folder}/pair-{b}.counts", np.minimum(counts, MANY).astype(np.uint32).tobytes())
        shared.put(f"{folder}/pair-{b}.many", np.stack([keys[counts >= MANY], counts[counts >= MANY]]).astype(np.uint64).tobytes())
        out = [{"range": -1, "kind": "n", "ids": b"", "data": np.array([*(np.sum(counts == k) for k in (1, 2, 3, 4)), len(keys)], np.float64).tobytes()}]
        left = keys >> np.uint64(32)
        at = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        sums = np.stack([np.add.reduceat(x.astype(np.float64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)])
        own = left[at]
        if own[-1] == START:
            out.append({"range": -1, "kind": "start", "ids": b"", "data": sums[:, -1].tobytes()})
            own, sums = own[:-1], sums[:, :-1]
        right, followed = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        for kind, ids, data in (("left", own, sums), ("right", right, followed.astype(np.uint32)[None])):
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] // span != ids[:-1] // span, [True]])) if len(ids) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                out.append({"range": int(ids[a]) // span, "kind": kind, "ids": bs.planes(ids[a:z].astype(np.uint32)), "data": bs.planes(np.ascontiguousarray(data[:, a:z]).reshape(-1))})
        return pd.DataFrame(out)

    done = texts.mapInArrow(shared.tidy(count), PACKED).groupBy("bucket").applyInPandas(store, "range int, kind string, ids binary, data binary")
    return shared.table(spark, done, "pair-totals")


def _word_totals(words: Vocabulary, totals: DataFrame, discounts: np.ndarray, span: int) -> np.ndarray:
    """Write each word's totals; count-of-counts of the words before a word, summed over words."""

    def store(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r, kind, ids, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                size = min(span, words.size - r * span)
                own = held.setdefault(r, [np.zeros((4, size)), np.zeros(size, np.uint32)])
                ids = bs.unplanes(ids, np.uint32).astype(np.int64) - r * span
                if kind == "left":
                    own[0][:, ids] += bs.unplanes(data, np.float64).reshape(4, -1)
                else:
                    own[1][ids] += bs.unplanes(data, np.uint32)
        for r, (sums, followed) in held.items():
            weight = np.divide(discounts[1:] @ sums[1:], sums[0], out=np.ones(len(followed)), where=sums[0] > 0).astype(np.float32)
            for kind, data in (("totals", sums[0]), ("weights", weight), ("followed", followed)):
                shared.put(f"{words.folder}/range-{r}.{kind}", data.tobytes())
            n = [int(np.sum(followed == k)) for k in (1, 2, 3, 4)] + [int(np.sum(followed >= 3))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], list("abcde"))

    got = totals.filter("range >= 0").repartition("range").mapInArrow(store, "a long, b long, c long, d long, e long").agg(*(F.sum(c).alias(c) for c in "abcde")).first()
    return np.array([x or 0 for x in got], float)


class _Ranges(Vocabulary):
    """A vocabulary whose totals lie in files of ``span`` words each."""

    span: int = 0

    def gather(self, what: str, dtype: type, ids: np.ndarray) -> np.ndarray:
        if what == "counts":
            return super().gather(what, dtype, ids)
        out = np.zeros(len(ids), dtype)
        at = (ids // np.uint64(self.span)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(ids) else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = _mapped(f"{self.folder}/range-{at[a]}.{what}", dtype)
            out[a:z] = own[(ids[a:z] - np.uint64(at[a] * self.span)).astype(np.int64)]
        return out


def train(texts: DataFrame, text: str = "text", file_bytes: int = 32 << 20, span: int = 1 << 21) -> Model:
    """Fit the model to every row of ``texts``.

    file_bytes: text for each file of words and of pairs. span: words whose totals one task holds.
    """
    spark = texts.sparkSession
    shared.small_batches(spark)
    texts = texts.select(F.col(text).alias("text"))
    size, n_rows = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(4, math.ceil(size / file_bytes))
    folder = shared.posix_folder(spark, "kneser-ney")
    found = _count_words(spark, texts, folder, n, max(1000.0, size / (25 * n)), n_rows)
    words = _Ranges(folder, found.offsets, found.tokens, found.often, found.ways)
    words.span = span
    totals = _count_pairs(spark, texts, words, n, span)
    few = totals.filter("range < 0").groupBy("kind").agg(F.collect_list("data").alias("data")).collect()
    few = {r.kind: np.sum([np.frombuffer(x, np.float64) for x in r.data], axis=0) for r in few}  # one short row for each file
    of_pairs, start = few.get("n", np.zeros(5)), few.get("start", np.zeros(4))
    for b in range(n):
        for kind in ("keys", "counts", "many"):
            if not os.path.exists(f"{folder}/pair-{b}.{kind}"):
                shared.put(f"{folder}/pair-{b}.{kind}", b"")
    d = _discounts(list(of_pairs[:4]))
    of_words = _word_totals(words, totals, d, span) if words.size else np.zeros(5)
    e = _discounts(list(of_words[:4]))
    pairs = int(of_pairs[4])
    left = float(e[1] * of_words[0] + e[2] * of_words[1] + e[3] * of_words[4]) / pairs if pairs else 1.0
    return Model(words, n, d, e, pairs, left, float(start[0]), float(d[1:] @ start[1:] / start[0]) if start[0] else 1.0)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the four figures of ``Model.score`` for every row."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(batch.num_columns - 1), bs.BLOCK):
                got = model.score(block)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(block.first, block.rows) for c in batch.columns[:-1]), *(pa.array(x) for x in got.values())], [*batch.schema.names[:-1], *got])

    return rows.mapInArrow(shared.tidy(run), f"{schema}, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds each row's perplexity: 10 to the mean negative log probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
