"""Token ids of whole texts through a table of the corpus's distinct pieces.

A byte-level pre-tokenizer never joins what stands before and behind a blank that follows a
non-blank, nor a letter and punctuation. So texts are cut there; every distinct piece is encoded once
by the tokenizers library, and the ids of all pieces lie in files by sorted 64-bit hashes that workers
map into memory. Its length and three of its bytes tell a piece from others with the same hash: such a
piece, one that isn't in the table, and every text that ends in a blank, has one behind white space or
may have the text of an added token, is encoded directly. The ids are those of encoding each text in
one call.

Edge cases: a null or empty text has no ids; a table of no texts is empty; repeated rows cost
nothing; a very long text is a block of its own; extra columns are never read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared
from .lm import _bucket, _mapped
from .tokenize import encoder

_BARE = np.uint64(0x5DEECE66D1234567)
SEEN = 2_000_000


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _direct_rows(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...]) -> np.ndarray:
    """Rows that end in a blank, have one behind white space, or may have a text of an added token."""
    at = np.flatnonzero(data == 0x20)
    a = data[np.maximum(at - 1, 0)]
    before = np.zeros(256, bool)
    before[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    spaced = before[a]
    wide = np.flatnonzero(a >= 0x80)  # the last byte of a longer character
    if len(wide):
        back = lambda k: np.where(at[wide] >= k, data[np.maximum(at[wide] - k, 0)], 0)
        x, y, z = a[wide], back(2), back(3)
        two = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
        general = (z == 0xE2) & (((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))) | ((y == 0x81) & (x == 0x9F)))
        spaced[wide] = two | general | ((z == 0xE1) & (y == 0x9A) & (x == 0x80)) | ((z == 0xE3) & (y == 0x80) & (x == 0x80))
    bad = np.zeros(len(offsets) - 1, bool)
    some = at[spaced]
    row = np.searchsorted(offsets, some, "right") - 1
    bad[row[some > offsets[row]]] = True
    ends = offsets[1:][np.diff(offsets) > 0]
    bad[np.flatnonzero(np.diff(offsets) > 0)[data[ends - 1] == 0x20]] = True
    for text in {t[:2] for t in added}:
        here = np.flatnonzero(data == text[0])
        here = here[data[np.minimum(here + 1, len(data) - 1)] == text[-1]] if len(text) > 1 else here
        bad[np.searchsorted(offsets, here, "right") - 1] = True
    return bad


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ASCII_LETTER = bs.LETTERS & (np.arange(256) < 0x80)
_GRAPHIC = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, each row's first, and whether a piece follows no blank.

    Besides at blanks, texts are cut before punctuation behind an ASCII letter, and on both sides of a
    single line end between visible ASCII characters: the pre-tokenizer cuts there, too.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    inside = data != 0x20
    np.logical_and(np.take(_PUNCTUATION, data[1:]), np.take(_ASCII_LETTER, data[:-1]), out=cut[1:n])
    ends_of_line = np.flatnonzero(data == 0x0A)
    ends_of_line = ends_of_line[(ends_of_line > 0) & (ends_of_line < n - 1)]
    ends_of_line = ends_of_line[_GRAPHIC[data[ends_of_line - 1]] & _GRAPHIC[data[ends_of_line + 1]]]
    cut[ends_of_line] = True
    cut[ends_of_line + 1] = True
    cut[offsets] = True
    start, end = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        start[0], end[-1] = inside[0], inside[-1]
        np.logical_and(inside[1:], ~inside[:-1] | cut[1:n], out=start[1:])
        np.logical_and(inside[:-1], ~inside[1:] | cut[1:n], out=end[:-1])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    bare = (data[np.maximum(starts - 1, 0)] != 0x20) | first[starts]
    return starts, ends, np.searchsorted(starts, offsets), bare


@dataclass
class _Cut:
    """Pieces of a block: places, hashes and checks; ``first`` piece of each row; rows to encode directly."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    bare: np.ndarray
    direct: np.ndarray


def _cut(block: bs.Block, added: tuple[bytes, ...]) -> _Cut:
    data, offsets = block.raw, block.offsets
    starts, ends, first, bare = _spans(data, offsets)
    keys = bs.hashes(data, starts, ends)
    size = ends - starts
    checks = (np.minimum(size, 255) << 24 | data[starts].astype(np.int64) << 16 | data[starts + (size >> 1)].astype(np.int64) << 8 | data[ends - 1]).astype(np.uint32)
    return _Cut(starts, ends, first, np.where(bare, keys ^ _BARE, keys), checks, bare, _direct_rows(data, offsets, added))


@dataclass
class Table:
    folder: str
    files: int
    tokenizer: str
    dtype: str
    added: tuple[bytes, ...] = ()

    def _local(self, block: bs.Block, cut: _Cut, with_ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the block's distinct pieces, their starts and sizes, and the distinct piece at each place."""
        keys, index, back = bs.distinct(cut.keys)
        checks = cut.checks[index]
        sizes = np.full(len(keys), -1, np.int64)
        parts, starts, total = [], np.zeros(len(keys), np.int64), 0
        cuts = np.searchsorted(_bucket(keys, self.files), np.arange(self.files + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = _mapped(f"{self.folder}/piece-{b}.keys", np.uint64)
            if not len(own):
                continue
            part = keys[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(own, part), len(own) - 1)
            hit = np.flatnonzero((own[at] == part) & (_mapped(f"{self.folder}/piece-{b}.checks", np.uint32)[at] == checks[cuts[b] : cuts[b + 1]]))
            ends = _mapped(f"{self.folder}/piece-{b}.ends", np.uint32)
            lo, hi = ends[at[hit]].astype(np.int64), ends[at[hit] + 1].astype(np.int64)
            sizes[cuts[b] + hit] = hi - lo
            if not with_ids:
                continue
            starts[cuts[b] + hit] = total + np.cumsum(hi - lo) - (hi - lo)
            parts.append(_mapped(f"{self.folder}/piece-{b}.ids", np.dtype(self.dtype).type)[ragged(lo, hi - lo)])
            total += len(parts[-1])
        lost = np.flatnonzero(sizes < 0)
        if len(lost):
            raw = block.raw.tobytes()
            texts = [("" if cut.bare[i] else " ") + raw[cut.starts[i] : cut.ends[i]].decode() for i in index[lost]]
            for k, ids in zip(lost, encoder(self.tokenizer).encode_whole(texts), strict=True):
                starts[k], sizes[k] = total, len(ids)
                parts.append(ids)
                total += len(ids)
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32), starts, sizes, back

    def _direct(self, block: bs.Block, cut: _Cut) -> dict[int, np.ndarray]:
        rows = np.flatnonzero(cut.direct)
        texts = [block.raw[block.offsets[r] : block.offsets[r + 1]].tobytes().decode() for r in rows]
        return dict(zip(rows.tolist(), encoder(self.tokenizer).encode_whole(texts), strict=True)) if texts else {}

    def streams(self, block: bs.Block, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by ``end`` if given, and the place of each row's first."""
        cut = _cut(block, self.added)
        local, starts, sizes, back = self._local(block, cut)
        first = cut.first
        if end is not None:
            back = np.insert(back, first[1:], len(sizes))
            first = first + np.arange(len(first))
            local, starts, sizes = np.append(local, np.uint32(end)), np.append(starts, len(local)), np.append(sizes, 1)
        ids = local[ragged(starts[back], sizes[back])]
        at = np.concatenate([[0], np.cumsum(sizes[back])])[first]
        whole = self._direct(block, cut)
        if not whole:
            return ids, at
        tail = [] if end is None else [np.array([end], np.uint32)]
        rows = [np.concatenate([whole[r], *tail]) if r in whole else ids[at[r] : at[r + 1]] for r in range(block.rows)]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])

    def encode(self, block: bs.Block) -> list[np.ndarray]:
        """Ids of every row."""
        ids, at = self.streams(block)
        return [ids[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]

    def count(self, block: bs.Block) -> np.ndarray:
        """Number of ids of every row."""
        cut = _cut(block, self.added)
        _, _, sizes, back = self._local(block, cut, with_ids=False)
        out = bs.row_sums(sizes[back], cut.first)
        for r, own in self._direct(block, cut).items():
            out[r] = len(own)
        return out


def build(docs: DataFrame, tokenizer: str, text: str = "text") -> Table:
    """Encode the distinct pieces of every row, in half as many files as the rows have partitions."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    texts = docs.select(F.col(text).alias("text"))
    n = max(4, math.ceil(texts.rdd.getNumPartitions() / 2))
    folder = shared.posix_folder(spark, "pieces")
    added = tuple(sorted(t.content.encode() for t in encoder(tokenizer).tokenizer.get_added_tokens_decoder().values()))

    def collect(batches):
        seen = fresh = np.zeros(0, np.uint64)
        among = lambda keys, have: have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys if len(have) else np.zeros(len(keys), bool)
        for batch in batches:
            for block in bs.blocks(batch.column(0)):
                cut = _cut(block, added)
                keys, index, _ = bs.distinct(cut.keys)
                new = ~(among(keys, seen) | among(keys, fresh))
                keys, index = keys[new], index[new]
                if len(keys):
                    fresh = np.sort(np.concatenate([fresh, keys]))
                    yield _packed(block, cut, keys, index, n)
                if len(fresh) > 200_000:
                    seen = np.sort(np.concatenate([seen, fresh])) if len(seen) < SEEN else fresh
                    fresh = np.zeros(0, np.uint64)

    def store(rows):
        import pandas as pd

        b = int(rows["bucket"].iloc[0])
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["keys"]])
        checks = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["checks"]])
        bares = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["bares"]])
        pieces = b" ".join(rows["pieces"]).split(b" ")
        keys, index = np.unique(keys, return_index=True)
        ends, ids = [np.zeros(1, np.int64)], []
        for lo in range(0, len(index), 10_000):
            part = index[lo : lo + 10_000].tolist()
            got = encoder(tokenizer).tokenizer.encode_batch_fast([("" if bares[i] else " ") + pieces[i].decode() for i in part], add_special_tokens=False)
            lists = [e.ids for e in got]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ids.append(np.fromiter(itertools.chain.from_iterable(lists), dtype, int(sizes.sum())))
            ends.append(ends[-1][-1] + np.cumsum(sizes))
        for kind, data in (("keys", keys), ("checks", checks[index]), ("ends", np.concatenate(ends).astype(np.uint32)), ("ids", np.concatenate(ids) if ids else np.zeros(0, dtype))):
            shared.put(f"{folder}/piece-{b}.{kind}", data.tobytes())
        shared.give_back()
        return pd.DataFrame({"bucket": [b]})

    dtype = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 65536 else "<u4"
    made = texts.mapInArrow(shared.tidy(collect), "bucket int, keys binary, checks binary, bares binary, pieces binary").groupBy("bucket").applyInPandas(store, "bucket int")
    have = {r.bucket for r in made.collect()}  # a row for each file
    for b in {*range(n)} - have:
        for kind in ("keys", "checks", "ends", "ids"):
            shared.put(f"{folder}/piece-{b}.{kind}", b"")
    return Table(folder, n, tokenizer, dtype, added)


def _packed(block: bs.Block, cut: _Cut, keys: np.ndarray, index: np.ndarray, n: int) -> pa.RecordBatch:
    """A row for each file: hashes, checks, whether it follows no blank, and the pieces between blanks."""
    bucket = _bucket(keys, n)  # ascending, as keys are
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    starts, sizes = cut.starts[index], cut.ends[index] - cut.starts[index]
    padded = np.append(block.raw, np.uint8(0x20))
    rows = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        places = ragged(starts[a:z], sizes[a:z] + 1)
        blob = padded[np.minimum(places, len(block.raw))]
        blob[np.cumsum(sizes[a:z] + 1) - 1] = 0x20
        rows.append((int(bucket[a]), keys[a:z].tobytes(), cut.checks[index[a:z]].tobytes(), cut.bare[index[a:z]].astype(np.uint8).tobytes(), blob[:-1].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "checks", "bares", "pieces"])
