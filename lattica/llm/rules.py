"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Edge cases: a null text has no words and fails the base rule; a text without lines or windows has
none repeated; rows with equal texts get equal verdicts; a value at a threshold keeps its row; a very long text is
read whole; an empty table gives no rows; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by are this not or "
    "de la le et les des un une du en que qui pour dans est par pas sur au "
    "der die und das den von zu mit sich dem nicht ein eine als auf ist im "
    "el los del se las por con no su para al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Fails rows whose ``metric`` lies outside the bounds."""

    metric: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. Ratios are by word, line ratios by line with a word.
TABLE = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", most=0.1),
    Rule("shout_ratio", most=0.3),
    Rule("stop_word_ratio", least=0.06),
    Rule("dup_line_ratio", most=0.3),
    Rule("upper_ratio", most=0.4),
)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more, the first occurrence included."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(windows, of_windows)

    def of_windows(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, covered))

    def covered(s: Column) -> Column:
        same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
        again = F.filter(s, lambda e, j: same(e, j + 1) | same(e, j - 1))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashed, of_hashes)).cast("long")


def metrics(text: Column) -> Column:
    """All counts and ratios of a text as one struct."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("stop_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    words = let(F.array_remove(F.split(t, SPACE + "+"), ""), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    count = lambda pattern: (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))).cast("long")
    shouts = (F.char_length(t) - F.char_length(F.replace(t, F.lit("!"), F.lit("")))).cast("long")
    parts = F.struct(words.alias("w"), lines.alias("l"), count(SYMBOLS).alias("s"), count("[A-Z]").alias("u"), shouts.alias("e"))

    def ratios(p: Column) -> Column:
        n, chars = F.greatest(p["w"]["n_words"], F.lit(1)), F.greatest(p["w"]["word_chars"], F.lit(1))
        return F.struct(
            p["w"]["n_words"].alias("n_words"), p["w"]["word_chars"].alias("word_chars"), p["s"].alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"), p["w"]["n_repeat_words"].alias("n_repeat_words"), p["w"]["stop_words"].alias("stop_words"),
            (p["w"]["word_chars"] / n).alias("mean_word_chars"), (p["s"] / n).alias("symbol_ratio"), (p["e"] / n).alias("shout_ratio"),
            (p["w"]["stop_words"] / n).alias("stop_word_ratio"), (p["l"]["n_dup_lines"] / F.greatest(p["l"]["n_lines"], F.lit(1))).alias("dup_line_ratio"), (p["u"] / chars).alias("upper_ratio"),
        )

    return let(parts, ratios)


def verdict(m: Column, table: tuple[Rule, ...] = TABLE) -> Column:
    """True where a metrics struct keeps within every rule."""
    out = F.lit(True)
    for rule in table:
        if rule.least is not None:
            out = out & (m[rule.metric] >= rule.least)
        if rule.most is not None:
            out = out & (m[rule.metric] <= rule.most)
    return out


def assess(docs: DataFrame, keep: list[str], table: tuple[Rule, ...] = TABLE, text: str = "text") -> DataFrame:
    """``keep`` columns, the counts, base_failed and kept for every row."""

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*(m[c].alias(c) for c in names), failed.alias("base_failed"), (~failed & verdict(m, table)).alias("kept"))

    return docs.select(*keep, let(metrics(F.col(text)), judged).alias("__m")).select(*keep, "__m.*")
