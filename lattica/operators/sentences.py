"""Sentence boundaries learnt without labels, language by language.

Kiss and Strunk's method: a word is an abbreviation if its occurrences with a final period are so many more than chance that the likelihood ratio, scaled by the word's
length, its inner periods and its occurrences without a final one, passes a threshold; words that follow sure boundaries more often than chance start sentences; and
words that stand together across a period more often than chance don't part there. Everything is counted by Spark over all texts,
combined where it is read; the model is a small table, and splitting is one expression over a text's tokens.

A null language is a language of its own, named by the empty text. Null texts teach nothing and have no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage

# The published thresholds, and the patterns of tokens.
ABBREVIATION, STARTER, COLLOCATION, RATIO = 0.3, 30.0, 7.88, 0.99
TOKEN = r"[^\x09-\x0D\x20]+"
FORM = r"(?s)^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}.!?]*$"
NUMBER = r"^[0-9]+(?:[.,:-][0-9]+)*$"
END = r"""[.!?]["')\]]*$"""
POSSIBLE = r"""([.!?]["')\]]*[\x09-\x0D\x20]+)"""
LAST, FIRST = r"(?<![^\x09-\x0D\x20])([^\x09-\x0D\x20]+)[\x09-\x0D\x20]*$", r"^[^\x09-\x0D\x20]+"
#: Marks between pieces and between sentences: code points that are no characters.
PIECE, SENTENCE = "\ufdd0", "\ufdd1"
LOWER, UPPER = r"^[^\p{L}\p{N}]*\p{Ll}", r"^[^\p{L}\p{N}]*\p{Lu}"
#: Rows of a model that are sent to every executor; a larger one is joined by language.
MOST_ROWS = 200_000


def form(token: Column) -> Column:
    """A token in lower case without what encloses it; a final period or mark stays."""
    return F.lower(F.regexp_extract(token, FORM, 1))


def kind(form_: Column) -> Column:
    """A form without its final period; all numbers are one."""
    bare = F.regexp_replace(form_, r"\.$", "")
    return F.when(bare.rlike(NUMBER), F.lit("##")).otherwise(bare)


def _log_term(n: Column, p: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p))


def period_ratio(n: Column, with_period: Column, total: Column, periods: Column) -> Column:
    """How much likelier a word's periods are if it nearly always has one than by chance."""
    p, other = periods / total, n - with_period
    by_chance = _log_term(with_period, p) + _log_term(other, 1 - p)
    return -2 * (by_chance - (with_period * F.log(F.lit(RATIO)) + other * F.log(F.lit(1 - RATIO))))


def pair_ratio(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's likelihood ratio of two events that occur together."""
    p, p1, p2 = b / total, both / a, (b - both) / F.nullif(total - a, F.lit(0))
    together = lambda p, n, m: F.when((p <= 0) | (p >= 1) | p.isNull(), F.lit(0.0)).otherwise(_log_term(n, p) + _log_term(m, 1 - p))
    apart = (b - both, total - a - b + both)
    return -2 * (together(p, both, a - both) + together(p, *apart) - together(p1, both, a - both) - together(p2, *apart))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, kind ('abbreviation', 'starter' or 'collocation'), item, n and score, from every row of ``docs``.

    Texts are read twice: for the counts of words, and for those of what follows a possible end. Tokens are counted as they are first,
    so that the patterns of forms are matched once for each different token.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)).alias("w"))
    pairs = given.select("lang", "w", F.posexplode_outer("w").alias("i", "token")).select("lang", "token", F.get("w", F.col("i") + 1).alias("following"))
    once = lambda c: F.when(F.col("c") > 0, c)  # noqa: E731  a filter by it can't move below the count, to every token
    of = once(form(F.col("token")))
    counted = lambda rows, *by: rows.groupBy("lang", "token", *by).agg(F.count(F.lit(1)).alias("c"))
    formed = lambda rows, *more: rows.select("*", of.alias("f")).filter("f <> ''").select("lang", kind(F.col("f")).alias("word"), F.col("f").endswith(".").alias("period"), "c", *more)
    read = formed(counted(pairs.filter("token is not null")))
    counts = storage.table(spark, read.groupBy("lang", "word").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("period"), F.col("c")).otherwise(0)).alias("with_period")), "words")
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("with_period").alias("periods")))  # a row for each language
    scored = counts.filter((F.col("with_period") > 0) & F.col("word").rlike(r"\p{L}")).join(total, "lang").filter("periods < total")
    solid = F.length(F.replace("word", F.lit("."))).cast("double")
    score = period_ratio(*map(F.col, ("n", "with_period", "total", "periods"))) * F.exp(-solid) * (F.length("word") - solid + 1) * F.pow(solid, -(F.col("n") - F.col("with_period")).cast("double"))
    short = scored.select("lang", "word", F.col("with_period").alias("n"), score.alias("score")).filter(F.col("score") >= ABBREVIATION)

    ended = formed(counted(pairs.filter(F.col("token").rlike(END) & F.col("following").isNotNull()), "following"), "following").withColumn("next", once(kind(form(F.col("following"))))).filter("next <> ''")
    follows = ended.groupBy("lang", "word", "period", "next").agg(F.sum("c").alias("both"))
    follows = storage.table(spark, follows, "followers").join(short.select("lang", "word", F.lit(True).alias("short")), ["lang", "word"], "left").withColumn("short", F.coalesce("short", F.lit(False)) & F.col("period"))
    sure = follows.filter("not short").groupBy("lang", "next").agg(F.sum("both").alias("both"))
    breaks = F.broadcast(sure.groupBy("lang").agg(F.sum("both").alias("a")))
    known = counts.select("lang", F.col("word").alias("next"), F.col("n").alias("b"))

    def likely(rows: DataFrame, least: float) -> DataFrame:
        ratio = rows.join(total, "lang").withColumn("score", pair_ratio(F.col("a"), F.col("b"), F.col("both"), F.col("total")))
        return ratio.filter((F.col("score") >= least) & (F.col("total") / F.col("a") > F.col("b") / F.col("both")))

    starters = likely(sure.filter(F.col("next").rlike(r"^\p{L}")).join(breaks, "lang").join(known, ["lang", "next"]), STARTER)
    doubtful = F.col("period") & (F.col("short") | (F.col("word") == "##") | (F.length("word") == 1))
    tied = follows.filter(doubtful & (F.col("both") > 1)).join(counts.select("lang", "word", F.col("with_period").alias("a")), ["lang", "word"]).join(known, ["lang", "next"])
    tied = likely(tied, COLLOCATION)
    as_ = lambda df, name, item, n: df.select("lang", F.lit(name).alias("kind"), item.alias("item"), F.col(n).cast("long").alias("n"), "score")
    return as_(short, "abbreviation", F.col("word"), "n").unionByName(as_(starters, "starter", F.col("next"), "both")).unionByName(as_(tied, "collocation", F.concat_ws(" ", "word", "next"), "both"))


def breaks(token: Column, following: Column, short: Column, starters: Column, tied: Column) -> Column:
    """Whether a sentence ends between a token with an end mark and the one that follows, given arrays of a language's abbreviations, starters and collocations."""
    word, after = kind(form(token)), kind(form(following))
    number = word == "##"
    special = F.array_contains(short, word) | number | (F.length(word) == 1)
    open_ = F.when(number, ~following.rlike(LOWER)).otherwise(following.rlike(UPPER) & F.array_contains(starters, after))
    at_period = F.when(~special, F.lit(True)).when(F.array_contains(tied, F.concat_ws(" ", word, after)), F.lit(False)).otherwise(open_)
    return (following != "") & F.when(form(token).endswith("."), at_period).otherwise(F.lit(True))


def split(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", into: str = "sentences") -> DataFrame:
    """``docs`` with an array of each text's sentences; null for a null text. ``model``: as ``learn`` returns it, a table by now."""
    pick = lambda name: F.sort_array(F.collect_list(F.when(F.col("kind") == name, F.col("item"))))
    lists = model.groupBy(F.col("lang").alias("__lang")).agg(*(pick(k).alias(f"__{k}") for k in ("abbreviation", "starter", "collocation")))
    lists = F.broadcast(lists) if model.limit(MOST_ROWS + 1).count() <= MOST_ROWS else lists
    none = F.array().cast("array<string>")
    own = [F.coalesce(F.col(f"__{k}"), none) for k in ("abbreviation", "starter", "collocation")]
    rows = docs.withColumn("__own", F.coalesce(F.col(lang).cast("string"), F.lit(""))).join(lists, F.col("__own") == F.col("__lang"), "left")
    # Pieces end where a sentence may; only there tokens are looked at.
    rows = rows.withColumn("__parts", F.split(F.regexp_replace(F.col(text), POSSIBLE, f"$1{PIECE}"), PIECE))
    following = lambda i: F.coalesce(F.regexp_extract(F.get("__parts", i + 1), FIRST, 0), F.lit(""))
    marked = F.transform("__parts", lambda x, i: F.when(breaks(F.regexp_extract(x, LAST, 1), following(i), *own), F.concat(x, F.lit(SENTENCE))).otherwise(x))
    trimmed = F.transform(F.split(F.array_join(marked, ""), SENTENCE), lambda s: F.regexp_replace(s, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))
    return rows.select(*docs.columns, F.filter(trimmed, lambda s: s != "").alias(into))
