"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts are drawn by hash up to a documented bound; every text is
described by counts of its bytes, words and word pairs. A first model tells positives from
unlabelled texts; from its scores the class prior is estimated (the least ratio of unlabelled to
positive mass above a score, with a margin for chance). The second model minimises the
non-negative unbiased risk under that prior. Labels of bad quality are not used at all.

Edge cases: a null or empty text has zero counts and gets a score like any other; a label row
without a text, or with a null quality, is not used; several labels of one id count as positive if
any is 1; without positives, and so with an empty table, the score is 0.5 for every row; repeated rows
get equal scores; a very long text is a block of its own; extra columns, whatever their names, are carried
by ``accept`` and never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from . import shared


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_HIGH = np.arange(256) >= 0x80
_OTHER = ~(bs.LETTERS | _DIGIT | ~bs.SPACED | _table(".,;:!?'\"-()"))
CLASSES = [_UPPER, _DIGIT, _HIGH, _OTHER, _table("!"), _table(".,;:?"), _table("\n"), _table("'\"-()")]
NAMES = ["upper", "digit", "high", "other", "shout", "stops", "lines", "marks", "length", "word_length", "words_new", "pairs_new", "again"]


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    _, at = np.unique(keys ^ bs.mix(row.astype(np.uint64)), return_index=True)
    return np.bincount(row[at], minlength=rows)


def describe(block: bs.Block) -> np.ndarray:
    """Row by feature."""
    h, first = bs.words(block)
    n = np.diff(first)
    row = np.repeat(np.arange(block.rows), n)
    per = 1.0 / np.maximum(n, 1)
    out = [bs.row_sums(t[block.raw], block.offsets) * per for t in CLASSES]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = h.copy()
    pair[1:] ^= bs.mix(h[:-1] + np.uint64(1))
    new = np.maximum(_distinct(h, row, block.rows), 1)
    out += [np.log1p(n), np.diff(block.offsets) * per, new * per, _distinct(pair, row, block.rows) * per, bs.row_sums(same, first) * per]
    return np.sqrt(np.maximum(np.stack(out, axis=1), 0)).astype(np.float32)


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the array ``x`` for every row."""
    shared.small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for block in bs.blocks(batch.column(batch.num_columns - 1)):
                x = describe(block)
                at = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.slice(block.first, block.rows) for c in batch.columns[:-1]), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], [*batch.schema.names[:-1], "x"])

    return rows.mapInArrow(shared.tidy(run), f"{schema}, x array<float>")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """One hidden layer of tanh units over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    ready: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        a, b, c, d = self.layers
        return np.tanh(z @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x)).astype(float) if self.ready else np.full(len(x), 0.5)


def _descend(model: Model, x: np.ndarray, slope, steps: int, rate: float, decay: float = 1e-4) -> None:
    """Adam on the whole sample; slope(margins) gives the risk's derivative by each margin."""
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    first, second = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers]
    for step in range(1, steps + 1):
        a, b, c, d = model.layers
        hidden = np.tanh(z @ a + b)
        g = slope(hidden @ c + d[0])
        back = np.outer(g, c) * (1 - hidden**2)
        for k, grad in enumerate((z.T @ back + decay * a, back.sum(axis=0), hidden.T @ g + decay * c, np.array([g.sum()]))):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad**2
            model.layers[k] = model.layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.05) -> float:
    """Share of positives among unlabelled scores: the least bounded ratio of their upper tails."""
    at = np.quantile(positive, np.linspace(0, 0.99, 200))
    p = np.array([(positive >= t).mean() for t in at])
    u = np.array([(unlabelled >= t).mean() for t in at])
    chance = np.sqrt(np.log(4 / doubt) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = np.argmin((u + chance) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def risk(z: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part and the negative part of the unbiased risk with the sigmoid loss l(z) = sigmoid(-z): the
    non-negative risk is the first and what the second is above 0."""
    s = _sigmoid(z)
    return prior * float((1 - s[is_p]).mean()), float(s[~is_p].mean() - prior * s[is_p].mean())


def risk_slope(z: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """By each margin, what to descend along: the slope of both parts; where the negative part is below 0 (an overfit), it alone is climbed."""
    s = _sigmoid(z)
    d = s * (1 - s)
    n, m = int(is_p.sum()), int((~is_p).sum())
    of_negative = np.where(is_p, -prior * d / n, d / m)
    if risk(z, is_p, prior)[1] < 0:
        return -of_negative
    return of_negative + np.where(is_p, -prior * d / n, 0)


def fit(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 12, steps: int = 400, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]) if len(positive) else unlabelled
    mean, scale = (both.mean(axis=0), both.std(axis=0) + 1e-3) if len(both) else (np.zeros(len(NAMES)), np.ones(len(NAMES)))
    fresh = lambda: [rng.normal(0, 0.3, (len(NAMES), hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    model = Model(mean, scale, fresh(), 0.5, bool(len(positive) and len(unlabelled)))
    if not model.ready:
        return model
    n, m = len(positive), len(unlabelled)
    is_p = np.arange(n + m) < n
    weight = np.where(is_p, 0.5 / n, 0.5 / m)

    # The prior comes from scores of rows that their scorer has not seen; a text's rows are of one fold.
    fold = np.array([zlib.crc32(row.tobytes()) & 1 for row in both], bool)
    margin = np.zeros(n + m)
    for k in (False, True):
        other = Model(mean, scale, fresh(), 0.5)
        w = np.where(fold != k, weight, 0)
        _descend(other, both, lambda z, w=w: w * (_sigmoid(z) - is_p), steps // 2, 0.03, 1e-3)
        margin[fold == k] = other.margin(both[fold == k])
    prior = class_prior(margin[is_p], margin[~is_p])

    model.layers = fresh()
    model.prior = prior
    _descend(model, both, lambda z: weight * (_sigmoid(z) - is_p), 60, 0.03)
    shift = np.log(max(prior, 1e-3) / (1 - prior + 1e-3))
    model.layers[3] = model.layers[3] + shift
    _descend(model, both, lambda z: risk_slope(z, is_p, prior), steps, 0.02)
    return model


def train(described: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", most: int = 20_000) -> Model:
    """Fit on at most ``most`` positives and ``most`` unlabelled rows, those with the least hashes of their ids.

    described: rows of ``features`` that may be learnt from. labels: rows that may be learnt from.
    """
    good = labels.filter(F.col(quality) == 1).select(F.col(key).alias("__key")).distinct()

    def draw(df: DataFrame) -> np.ndarray:
        """The rows with the least hashes; others are left out where they are, so that little more than them moves."""
        share = 1.2 * most / max(df.count(), 1)
        near = df if share >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
        return np.array([r.x for r in near.orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key).limit(most).select("x").collect()], float).reshape(-1, len(NAMES))

    return fit(draw(described.join(good, described[key] == good["__key"], "left_semi")), draw(described))


def predict(described: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, score and predicted of every described row, in Spark's own expressions."""
    z = [F.least(F.greatest((F.col("x")[i].cast("double") - float(model.mean[i])) / float(model.scale[i]), F.lit(-6.0)), F.lit(6.0)) for i in range(len(NAMES))]
    rows = described.select(*keep, F.array(*z).alias("__z"))
    a, b, c, d = model.layers
    margin = F.lit(float(d[0]))
    for j in range(len(b)):
        inner = F.lit(float(b[j]))
        for i in range(len(NAMES)):
            inner = inner + F.col("__z")[i] * float(a[i, j])
        margin = margin + F.tanh(inner) * float(c[j])
    score = 1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0)))) if model.ready else F.lit(0.5)
    return rows.select(*keep, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model finds good, with all their columns; rows pass the workers whole."""
    n = len(docs.columns)
    plain = docs.toDF(*(f"__{i}" for i in range(n)))
    text = f"__{docs.columns.index('text')}"
    scored = predict(features(plain, plain.columns, text), model, plain.columns)
    return scored.filter("predicted = 1").select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))
