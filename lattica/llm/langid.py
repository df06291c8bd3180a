"""Language ID by mixture inference.

Byte trigrams of words are counted for each language over all labelled rows. A text is a mixture:
expectation-maximisation finds its languages' proportions with words as units, going on until no proportion
moves, and languages are dropped, the smallest proportion first, as long as the likelihood penalised by the
number of languages improves; each set of languages is fitted until it converges before it is compared.

The table has 256 kB for each language in every worker, so more than ``MOST_LANGUAGES`` are an error, never left
out. Edge cases: a null text or one without a letter is ``und`` with score 0; ties go to the language
first in code-point order; rows with a null language teach nothing; with no language to learn from, and so from
an empty table, every text is ``und``; repeated rows teach as often as they occur and get equal results; a very
long text is a block of its own; extra columns, whatever their names, are carried by ``accept`` and never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared

BITS = 16
MOST_LANGUAGES = 2000
#: A proportion that moves by less has converged; rounds after which the last proportions count, whether they have or not.
STILL, MOST_ROUNDS = 1e-3, 10_000


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram around each byte of lower-cased text, and whether that byte is of a letter."""
    letter = bs.LETTERS[data]
    low = np.where(letter, bs.LOWER[data], np.uint8(0x20)).astype(np.uint32)
    n = len(low)
    left, right = np.full(n, 0x20, np.uint32), np.full(n, 0x20, np.uint32)
    left[1:], right[:-1] = low[:-1], low[1:]
    left[offsets[:-1][offsets[:-1] < n]] = 0x20
    right[offsets[1:][offsets[1:] > 0] - 1] = 0x20
    return ((left << np.uint32(16) | low << np.uint32(8) | right) * np.uint32(2654435761)) >> np.uint32(32 - BITS), letter


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # language by hashed trigram
    penalty: float = 1.0

    def proportions(self, block: bs.Block) -> np.ndarray:
        """Row by language; zeros for rows without words."""
        grams, _ = _trigrams(block.raw, block.offsets)
        starts, ends, first = bs.spans(block.raw, block.offsets, bs.LETTERS)
        n, size = np.diff(first), len(self.languages)
        if not len(starts):
            return np.zeros((block.rows, size))
        like = np.empty((size, len(starts)))
        for k in range(size):
            sums = np.concatenate([[0.0], np.cumsum(self.logs[k][grams], dtype=np.float64)])
            like[k] = sums[ends] - sums[starts]
        like = np.exp(like - like.max(axis=0))

        best = np.zeros((block.rows, size))
        rows = np.flatnonzero(n)
        best[rows] = fit(like, n[rows], np.full((len(rows), size), 1.0 / size))
        allowed = (best >= 0.02) | (best == best.max(axis=1, keepdims=True))
        rows = rows[allowed[rows].sum(axis=1) > 1]
        # Rows of one language are settled; the others give up languages one by one.
        if len(rows):
            like, count, allowed = like[:, _ragged(first, rows)], n[rows], allowed[rows]
            share = fit(like, count, np.where(allowed, best[rows], 0))
            found, cost = share.copy(), self.cost(like, count, share, allowed)
            while (more := allowed.sum(axis=1) > 1).any():
                least = np.where(allowed, share, np.inf).argmin(axis=1)
                allowed[np.flatnonzero(more), least[more]] = False
                share = fit(like, count, np.where(allowed, np.maximum(share, 1e-3), 0))
                now = self.cost(like, count, share, allowed)
                better = more & (now < cost)
                found[better], cost[better] = share[better], now[better]
            best[rows] = found
        rest = np.flatnonzero(n)
        rest = rest[~np.isin(rest, rows)]
        best[rest] = best[rest] == best[rest].max(axis=1, keepdims=True)
        top = best.argmax(axis=1)  # of equal ones the first
        single = np.zeros_like(best)
        single[np.arange(len(best)), top] = 1.0
        best[rest] = single[rest]
        return best

    def cost(self, like: np.ndarray, n: np.ndarray, share: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Penalised likelihood of each row's words; the less the better."""
        first = np.concatenate([[0], np.cumsum(n)])
        whole = np.log(np.maximum((like * np.repeat(share.T, n, axis=1)).sum(axis=0), 1e-300))
        return -2 * bs.row_sums(whole, first) + self.penalty * allowed.sum(axis=1) * np.log(np.maximum(n, 2))


def _ragged(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the words of some rows."""
    n = np.diff(first)[rows]
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[rows] - (ends - n), n)


def fit(like: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Proportions, row by language, at which expectation-maximisation stands still. ``like``: language by word,
    the words of row after row, ``n`` of each; a language without a share at first gets none. Rows that still move
    after ``MOST_ROUNDS`` keep their last proportions: each round only raises the likelihood."""
    share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    out = share.copy()
    active = np.arange(len(n))
    for _ in range(MOST_ROUNDS):
        if not len(active):
            return out
        first = np.concatenate([[0], np.cumsum(n)])
        part = like * np.repeat(share.T, n, axis=1)
        part /= np.maximum(part.sum(axis=0), 1e-300)
        new = np.stack([bs.row_sums(p, first) for p in part], axis=1) / n[:, None]
        moves = np.abs(new - share).max(axis=1) >= STILL
        share = new
        out[active] = share
        if moves.sum() <= 0.8 * len(active):  # go on with those that move
            keep = np.flatnonzero(moves)
            like, n, share, active = like[:, _ragged(first, keep)], n[keep], share[keep], active[keep]
    return out


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Count the trigrams of every row with a language. The tables hold 2**16 counts a language."""
    shared.small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size = len(languages)

    def count(batches):
        total = np.zeros(size << BITS, np.int64)
        for batch in batches:
            code = np.searchsorted(languages, batch.column(0).to_pylist())
            for block in bs.blocks(batch.column(1)):
                grams, letter = _trigrams(block.raw, block.offsets)
                at = np.repeat(code[block.first : block.first + block.rows], np.diff(block.offsets))
                key = (at.astype(np.int64) << BITS | grams)[letter]
                total += np.bincount(key, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    counts = np.zeros(size << BITS)
    if size:
        for r in rows.mapInArrow(shared.tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().itertuples():
            counts[r.key] = r.n
    counts = counts.reshape(size, 1 << BITS) + 0.5
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score (the predicted language's share) and n_languages of every row."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for block in bs.blocks(column):
                share = np.column_stack([model.proportions(block), np.zeros(block.rows)]) if model.languages else np.zeros((block.rows, 1))
                top = np.where(share.max(axis=1) > 0, share.argmax(axis=1), share.shape[1] - 1)
                plain = bs.row_sums(bs.LETTERS[block.raw] & (block.raw < 0x80), block.offsets)
                for r in np.flatnonzero((plain == 0) & (top < share.shape[1] - 1)):
                    if not any(c.isalpha() for c in column[block.first + int(r)].as_py() or ""):
                        top[r] = share.shape[1] - 1
                best = np.where(top < share.shape[1] - 1, share[np.arange(block.rows), top], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(block.first, block.rows) for c in batch.columns[:-1]), pa.array(names[top], pa.string()), pa.array(np.minimum(best, 1.0)), pa.array((share >= 0.02).sum(axis=1))],
                    [*batch.schema.names[:-1], "lang_pred", "score", "n_languages"])

    return rows.mapInArrow(shared.tidy(run), f"{schema}, lang_pred string, score double, n_languages long")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose language is known and makes up at least ``least`` of the text, with all their columns.

    Rows go through the workers whole, so no join is needed and repeated ids do no harm.
    """
    plain = shared.renamed(docs)
    got = predict(plain, model, plain.columns, plain.columns[docs.columns.index("text")])
    return got.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*plain.columns).toDF(*docs.columns)
