"""Mentions of a terminology's terms in texts, by a trie of word hashes that is walked for all words of a batch at once.

Words are runs of letters, marks, digits and underscores of any script, in lower case; what stands between the words of a term
doesn't matter. The trie is the set of the terms' beginnings, word by word, as sorted chained hashes with a flag for those that are terms.
They lie in files in the shared folder, each a range of hashes, which the tasks map into memory: the driver sees one row for each file, and one pass over the texts
does. Where the folder isn't mounted, the trie is sent to the tasks in slices by first words of about ``MOST_PREFIXES`` entries, one pass for
each. A place costs a look-up, and another one for each word that a term goes on with there. Mentions are joined with terms by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage

WORD = r"[\p{L}\p{M}\p{N}_]"
#: Entries of 9 bytes in a slice that is sent to every task.
MOST_PREFIXES = 4_000_000
#: Entries of 9 bytes in a file.
IN_FILE = 500_000
#: Words that a task matches at once; each takes about 150 bytes.
MOST_WORDS = 500_000
_CHAINS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_SPANS = "start int, n_words int, start_char int, end_char int"


def words(c: Column) -> Column:
    """The lower-cased words of a text; none of a null one."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"{WORD}+"), F.lit(0)), F.lower)


def _chained(h: np.ndarray, w: np.ndarray, by: np.uint64) -> np.ndarray:
    """A hash of what h stands for and one more word."""
    x = (h ^ w) * by
    x ^= x >> np.uint64(32)
    x = (x + w) * by
    return x ^ (x >> np.uint64(29))


def _lists(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists without nulls, and each list's first."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _walk(w: np.ndarray, first: np.ndarray, going=lambda h: np.ones(len(h), bool)) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: where they start, and their two hashes; only those go on for which ``going`` is true."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(w))
    one, two = np.zeros(len(w), np.uint64), np.full(len(w), 7, np.uint64)
    n = 0
    while len(at):
        one, two = _chained(one, w[at + n], _CHAINS[0]), _chained(two, w[at + n], _CHAINS[1])
        on = going(one)
        at, one, two = at[on], one[on], two[on]
        n += 1
        yield at, one, two
        more = at + n < ends[at]
        at, one, two = at[more], one[more], two[more]


def _terms(terms: DataFrame) -> DataFrame:
    """term, concept_id, h1, h2 and the hashed words of the terms that have any."""
    given = terms.select("term", "concept_id", F.transform(words(F.col("term")), lambda x: F.xxhash64(x)).alias("w")).filter(F.size("w") > 0)

    def run(batches):
        for batch in batches:
            w, first = _lists(batch.column(2), np.uint64)
            size, whole = np.diff(first), np.zeros((2, batch.num_rows), np.uint64)
            row = np.repeat(np.arange(batch.num_rows), size)
            for n, (at, one, two) in enumerate(_walk(w, first), 1):
                own = (at == first[:-1][row[at]]) & (size[row[at]] == n)
                whole[0, row[at[own]]], whole[1, row[at[own]]] = one[own], two[own]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(h.view(np.int64)) for h in whole)], [*batch.schema.names, "h1", "h2"])

    kind = terms.schema["concept_id"].dataType.simpleString()
    return given.mapInArrow(run, f"term string, concept_id {kind}, w array<bigint>, h1 long, h2 long")


def _prefixes(hashed: DataFrame) -> DataFrame:
    """h (of a beginning of a term), first (the hash of its first word) and whole (whether it is a term)."""

    def run(batches):
        for batch in batches:
            w, first = _lists(batch.column(0), np.uint64)
            size = np.diff(first)
            row = np.repeat(np.arange(batch.num_rows), size)
            for n, (at, one, _) in enumerate(_walk(w, first), 1):
                own = at == first[:-1][row[at]]
                yield pa.RecordBatch.from_arrays([pa.array(one[own].view(np.int64)), pa.array(w[at[own]].view(np.int64)), pa.array(size[row[at[own]]] == n)], ["h", "first", "whole"])

    return hashed.select("w").mapInArrow(run, "h long, first long, whole boolean").groupBy("h").agg(F.min("first").alias("first"), F.max("whole").alias("whole"))


def find(df: DataFrame, text: str, terms: DataFrame, keys: list[str], keep: str = "all") -> DataFrame:
    """All mentions, overlapping ones too: ``keys``, concept_id, term, start and n_words (in words), start_char and end_char (in characters).

    terms: term, concept_id. A term of several concepts is a mention of each; equal rows of terms count once; null texts
    and terms without a word have no mentions. keep: as for ``spans``.
    """
    hashed = terms_of(terms)
    return named(spans(df, text, hashed, keys, keep), hashed, keys)


def terms_of(terms: DataFrame) -> DataFrame:
    """The different rows (term, concept_id) with their hashes, made once."""
    return storage.table(terms.sparkSession, _terms(terms.select("term", "concept_id").distinct()), "terms")


def named(found: DataFrame, hashed: DataFrame, keys: list[str]) -> DataFrame:
    """Spans with the terms and concepts that they stand for."""
    return found.join(hashed.select("h1", "h2", "term", "concept_id"), ["h1", "h2"]).select(*keys, "concept_id", "term", "start", "n_words", "start_char", "end_char")


def spans(df: DataFrame, text: str, hashed: DataFrame, keys: list[str], keep: str = "all") -> DataFrame:
    """``keys``, h1 and h2 (of what is found), start, n_words, start_char and end_char of what stands for terms in texts, whatever their concepts.

    keep: 'all', 'longest' (of those that start at the same word) or 'apart' (of overlapping ones the one that starts first, of those the longest).
    """
    spark = df.sparkSession
    prefixes = storage.table(spark, _prefixes(hashed), "prefixes")
    n = prefixes.count()
    mounted = storage.mounted(spark)
    slices = 1 if mounted else max(1, -(-n // MOST_PREFIXES))
    # Runs of word characters and others take turns, so that lengths give the places of words.
    parts = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{WORD}+|[^{WORD[1:]}+"), F.lit(0))
    given = df.select(*keys, parts.alias("parts")).filter(F.size("parts") > 0).withColumn("odd", F.when(F.col("parts")[0].rlike(f"^{WORD}"), 0).otherwise(1))
    given = given.select(*keys, "odd", F.transform("parts", lambda x: F.char_length(x)).alias("sizes"), F.transform(F.filter("parts", lambda x, i: i % 2 == F.col("odd")), lambda x: F.xxhash64(F.lower(x))).alias("w"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)])
    # What starts at a word is in one slice; what lies beside it may be in another.
    own_keep = "longest" if keep == "apart" and slices > 1 else keep
    found = None
    for k in range(slices):
        trie = _filed(prefixes, n) if mounted else _sent(prefixes.filter(F.pmod("first", F.lit(slices)) == k))
        part = given.mapInArrow(_matcher(trie, len(keys), own_keep), f"{kinds}, h1 long, h2 long, {_SPANS}")
        found = part if found is None else found.unionByName(part)
    return leftmost_longest(found, keys) if own_keep != keep else found


def _packed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes and their flags."""
    h, whole = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
    order = np.argsort(h)
    return h[order], whole[order].astype(np.uint8)


def _kinds(keys: np.ndarray, whole: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each of h: 0 if no term begins so, 1 if one does, 2 if it is one."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, 1 + whole[at], 0).astype(np.uint8)


def _filed(prefixes: DataFrame, n: int) -> Callable[[], Callable | None]:
    """What gives a task its look-up in files that tasks of their own wrote; nothing if there are no terms."""
    spark = prefixes.sparkSession
    folder, files = storage.posix_folder(spark, "trie"), max(1, -(-n // IN_FILE))
    # Ranges of unsigned hashes, of about the same number of entries each.
    own = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(files), 32).cast("int")

    def write(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        at = np.concatenate([b.column(2).to_numpy() for b in held])
        given = pa.Table.from_batches(held).select(["h", "whole"]).combine_chunks()
        for k in np.unique(at):
            keys, whole = _packed(given.filter(pa.array(at == k)).combine_chunks().to_batches()[0])
            storage.put(f"{folder}/{k}", keys.tobytes() + whole.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(keys)], pa.int64())], ["k", "n"])

    sizes = np.zeros(files, np.int64)
    for r in prefixes.select("h", "whole", own.alias("k")).repartition(files, "k").mapInArrow(write, "k int, n long").collect():  # a row for each file
        sizes[r.k] = r.n

    def opened():
        if not sizes.any():
            return None
        raw = [np.memmap(f"{folder}/{k}", np.uint8, "r", shape=(9 * size,)) if size else None for k, size in enumerate(sizes.tolist())]
        maps = [(np.asarray(x[: -len(x) // 9]).view(np.uint64), np.asarray(x[-len(x) // 9 :])) if x is not None else None for x in raw]

        def look(h):
            distinct, back = np.unique(h, return_inverse=True)  # in order, so that a file is read from its start to its end
            kinds = np.zeros(len(distinct), np.uint8)
            cuts = np.searchsorted((distinct >> np.uint64(32)) * np.uint64(files) >> np.uint64(32), np.arange(files + 1).astype(np.uint64))
            for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
                if maps[k]:
                    kinds[cuts[k] : cuts[k + 1]] = _kinds(*maps[k], distinct[cuts[k] : cuts[k + 1]])
            return kinds[back]

        return look

    return opened


def _sent(prefixes: DataFrame) -> Callable[[], Callable | None]:
    """What gives a task its look-up in about ``MOST_PREFIXES`` entries, which go through the driver as 9 bytes each."""

    def pack(batches):
        for batch in batches:
            keys, whole = _packed(batch)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (keys, whole)], ["h", "whole"])

    rows = prefixes.select("h", "whole").mapInArrow(pack, "h binary, whole binary").collect()
    keys, whole = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("h", np.uint64), ("whole", np.uint8)))
    order = np.argsort(keys)
    trie = prefixes.sparkSession.sparkContext.broadcast((keys[order], whole[order]))

    def opened():
        keys, whole = trie.value
        return (lambda h: _kinds(keys, whole, h)) if len(keys) else None

    return opened


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists have about ``MOST_WORDS`` items, or one row if that has more."""
    ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_WORDS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _apart(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of some spans with ascending starts begin where none of those that were taken before is."""
    taken, end = np.zeros(len(starts), bool), 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if a >= end:
            taken[i], end = True, b
    return taken


def _matcher(trie: Callable[[], Callable | None], n_keys: int, keep: str):
    def run(batches):
        look = trie()
        for given in batches:
            if look:
                for batch in _pieces(given, n_keys + 2):
                    yield from matched(batch, look)

    def matched(batch, look):
        w, first = _lists(batch.column(n_keys + 2), np.uint64)
        sizes, part = _lists(batch.column(n_keys + 1), np.int64)
        ends = np.cumsum(sizes)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        before = (ends - sizes)[part[:-1]]
        piece = part[row] + 2 * (np.arange(len(w)) - first[row]) + batch.column(n_keys).to_numpy()[row]  # of each word
        kinds = np.zeros(0, np.uint8)  # of the runs that go on

        def going(h):
            nonlocal kinds
            own = look(h)
            kinds = own[own > 0]
            return own > 0

        def made(at, n, one, two):
            r, last = row[at], piece[at + n - 1]
            found = (at - first[r], n, (ends - sizes)[piece[at]] - before[r], ends[last] - before[r])
            return pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(r)) for i in range(n_keys)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in found)],
                [*batch.schema.names[:n_keys], "h1", "h2", "start", "n_words", "start_char", "end_char"])

        size, hashes = (np.zeros(len(w), np.int64), np.zeros((2, len(w)), np.uint64)) if keep != "all" else (None, None)
        for n, (at, one, two) in enumerate(_walk(w, first, going), 1):
            term = kinds > 1
            at, one, two = at[term], one[term], two[term]
            if keep == "all":
                if len(at):
                    yield made(at, np.full(len(at), n), one, two)
            else:
                size[at], hashes[0, at], hashes[1, at] = n, one, two  # longer ones come later
        if keep != "all":
            at = np.flatnonzero(size)
            at = at[_apart(at, at + size[at])] if keep == "apart" else at
            if len(at):
                yield made(at, size[at], hashes[0, at], hashes[1, at])

    return run


def leftmost_longest(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Of overlapping mentions of a text the one that starts first, of those the longest; all concepts of a span that stays."""
    ordered = mentions.repartition(*keys).sortWithinPartitions(*keys, "start", F.desc("n_words"))
    at = [mentions.columns.index(c) for c in keys]
    start_at, n_at = mentions.columns.index("start"), mentions.columns.index("n_words")

    def run(batches):
        text, span, end = None, None, 0
        for batch in batches:
            keep = []
            columns = [batch.column(i).to_pylist() for i in (*at, start_at, n_at)]
            for *key, start, n in zip(*columns, strict=True):
                if key != text:
                    text, span, end = key, None, 0
                if start >= end:
                    span, end = (start, n), start + n
                keep.append((start, n) == span)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(run, mentions.schema)
