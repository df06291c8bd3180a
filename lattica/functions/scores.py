"""Overlap of texts: bigrams in Spark expressions, ROUGE and BLEU in Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
#: Words of all columns that are scored at once.
MOST_WORDS = 500_000
# The suffix rules of Porter's algorithm (1980) by step, longest first where they share an end.
_STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
           ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"))
_STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Words with a stem of their own.
_IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _kinds(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel behind a consonant."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(root: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _kinds(root).count("vc")


def _short_end(root: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y; or a word of vowel and consonant."""
    kinds = _kinds(root)
    return (kinds[-3:] == "cvc" and root[-1] not in "wxy") or kinds == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + put
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-3] + ("ie" if len(word) == 4 else "i")
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        root = word[: len(word) - len(suffix)]
        if word.endswith(suffix):
            if "v" not in _kinds(root):
                return word
            if root.endswith(("at", "bl", "iz")):
                return root + "e"
            if len(root) > 1 and root[-1] == root[-2] and _kinds(root)[-1] == "c":
                return root if root[-1] in "lsz" else root[:-1]
            return root + "e" if _measure(root) == 1 and _short_end(root) else root
    return word


def _mapped(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first rule whose suffix fits decides; its root needs a measure above 0."""
    for suffix, put in rules:
        if word.endswith(suffix):
            root = word[: len(word) - len(suffix)]
            if suffix == "logi":
                return root + "log" if _measure(root + "l") > 0 else word
            return root + put if _measure(root) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """Porter's stem with the usual amendments (irregular words, y after a consonant, -ies and -ied of four letters)."""
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and len(word) > 2 and _kinds(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = word[:-2]
    word = _mapped(_mapped(word, _STEP_2), _STEP_3)
    for suffix in sorted((*_STEP_4, "ion"), key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: len(word) - len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root[-1:] in ("s", "t")):
                word = root
            break
    if word.endswith("e"):
        root = word[:-1]
        if _measure(root) > 1 or (_measure(root) == 1 and not _short_end(root)):
            word = root
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def _grams(text: str, n: int, stemmed: bool) -> Counter:
    words = _TOKEN.findall(text.lower())
    words = [stem(w) if len(w) > 3 else w for w in words] if stemmed else words
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def rouge_of(reference: str | None, made: str | None, n: int, stemmed: bool = True) -> tuple[float, float, float] | None:
    """Precision, recall and F of shared n-grams; None if a text is missing."""
    if reference is None or made is None:
        return None
    a, b = _grams(reference, n, stemmed), _grams(made, n, stemmed)
    both = sum((a & b).values())
    p, r = both / max(1, sum(b.values())), both / max(1, sum(a.values()))
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def bleu_of(reference: str | None, made: str | None) -> float | None:
    """BLEU-4 of one pair on white-space tokens; 0 if an order has no match."""
    if reference is None or made is None:
        return None
    ref, hyp = reference.split(), made.split()
    if not hyp:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (ref, hyp))
        both = sum((a & b).values())
        if not both:
            return 0.0
        total += math.log(both / max(1, sum(b.values()))) / 4
    return math.exp(total) * (1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp)))


def ascii_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def spaced_words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _coded(reference: pa.Array, made: pa.Array, stemmed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all references and then of all made texts of a batch, and each text's first word. Only different words are stemmed."""
    flat = pa.chunked_array([x.flatten().cast(pa.string()) for x in (reference, made)]).combine_chunks().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if stemmed:
        _, back = np.unique(np.array([stem(w) if len(w) > 3 else w for w in flat.dictionary.to_pylist()], object).astype(str), return_inverse=True)
        codes = back.astype(np.int64)[codes] if len(codes) else codes
    sizes = np.concatenate([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in (reference, made)])
    return codes, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _in_pieces(score: Callable[..., pa.Array], *given: pa.Array) -> pa.Array:
    """``score`` of columns of lists, of runs of rows that have about ``MOST_WORDS`` words or of one row at a time, so that a batch of long texts takes no more memory."""
    ends = np.cumsum(np.sum([pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in given], axis=0))
    out, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_WORDS, side="right")))
        out.append(score(*(x.slice(at, to - at) for x in given)))
        at = to
    return pa.concat_arrays(out) if out else score(*given)


def shared_grams(codes: np.ndarray, first: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For runs of 1 to ``most`` words, by row of ``_coded`` texts: how many both texts share, repeats counted, and how many there are in each text.

    Runs are numbered exactly, and counted and compared as sorted numbers of all rows at once.
    """
    rows = (len(first) - 1) // 2
    text = np.repeat(np.arange(2 * rows), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
    shared, sizes, grams = np.zeros((most, rows), np.int64), np.zeros((most, 2 * rows), np.int64), codes
    width = int(codes.max()) + 1 if len(codes) else 1
    for n in range(1, most + 1):
        if n > 1:
            _, grams = np.unique(grams[: max(len(codes) - n + 1, 0)] * width + codes[n - 1 :], return_inverse=True)
        own = np.flatnonzero(left[: len(grams)] >= n)
        sizes[n - 1] = np.bincount(text[own], minlength=2 * rows)
        kinds = int(grams.max()) + 1 if len(grams) else 1
        (a, n_a), (b, n_b) = (np.unique(text[part] % max(rows, 1) * kinds + grams[part], return_counts=True) for part in (own[text[own] < rows], own[text[own] >= rows]))
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared[n - 1] = np.bincount(both // kinds, np.minimum(n_a[i], n_b[j]), rows).astype(np.int64)
    return shared, sizes.reshape(most, 2, rows)


def _f_scores(shared: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r, p = (shared / np.maximum(1, n) for n in sizes)
    return p, r, np.divide(2 * p * r, p + r, out=np.zeros(len(p)), where=p + r > 0)


def _bleu(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ref, hyp = sizes[0]
    some = (shared > 0).all(axis=0)
    logs = np.log(np.where(shared > 0, shared, 1) / np.maximum(1, sizes[:, 1])).sum(axis=0) / 4
    return np.where(some, np.exp(logs) * np.where(hyp > ref, 1.0, np.exp(1 - ref / np.maximum(1, hyp))), 0.0)


def _doubles(values: dict[str, np.ndarray], *given: pa.Array) -> pa.Array:
    """A struct of doubles, null where a text is missing."""
    missing = np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in given])
    return pa.StructArray.from_arrays([pa.array(v.astype(np.float64), mask=missing) for v in values.values()], list(values))


def rouge(reference: Column, made: Column, n: int, stemmed: bool = True) -> Column:
    """Struct (precision, recall, f) of shared runs of n words; of nulls if a text is missing."""

    @F.arrow_udf("struct<precision:double,recall:double,f:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        shared, sizes = shared_grams(*_coded(a, b, stemmed), n)
        return _doubles(dict(zip(("precision", "recall", "f"), _f_scores(shared[-1], sizes[-1]), strict=True)), a, b)

    return run(ascii_words(reference), ascii_words(made))


def bleu(reference: Column, made: Column) -> Column:
    """BLEU-4 on white-space tokens; 0 if an order has no match."""

    @F.arrow_udf("struct<bleu:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _doubles({"bleu": _bleu(*shared_grams(*_coded(a, b, False), 4))}, a, b)

    return run(spaced_words(reference), spaced_words(made))["bleu"]


def text_scores(reference: Column, made: Column, stemmed: bool = True) -> Column:
    """Struct (rouge1, rouge2, bleu): ROUGE-1 F, ROUGE-2 F and BLEU of a pair, in one pass over it."""

    @F.arrow_udf("struct<rouge1:double,rouge2:double,bleu:double>")
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        return _in_pieces(score, a, b, c, d)

    def score(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        shared, sizes = shared_grams(*_coded(a, b, stemmed), 2)
        f = {f"rouge{n + 1}": _f_scores(shared[n], sizes[n])[2] for n in range(2)}
        return _doubles(f | {"bleu": _bleu(*shared_grams(*_coded(c, d, False), 4))}, a, b)

    return run(ascii_words(reference), ascii_words(made), spaced_words(reference), spaced_words(made))


def bigrams(c: Column) -> Column:
    """Array of 'a b' of the lower-cased ASCII words of a text."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))
    pair = F.transform(F.array(words), lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    return pair[0]


def bigram_share(reference: Column, made: Column) -> Column:
    """Of the bigrams of a text, repeats included, the share that the reference has as often; null if it has none or a text is missing."""

    @F.arrow_udf("struct<both:double,n:double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        shared, sizes = shared_grams(*_coded(a, b, False), 2)
        return _doubles({"both": shared[1], "n": sizes[1, 1]}, a, b)

    got = run(ascii_words(reference), ascii_words(made))
    return F.try_divide(got["both"], got["n"])


def bigram_overlap(reference: Column, made: Column) -> Column:
    """Shared distinct bigrams over the distinct bigrams of the reference; null if it has none."""
    a, b = bigrams(reference), bigrams(made)
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_distinct(a)).cast("double"))
