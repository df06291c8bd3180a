"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index holds a posting for every word of every training text: the word's hash, the row's number and the
word's place. Each segment (a partition of the texts, one file) is sorted by word, so building it shuffles
nothing; any number of test sets are answered from one index, without reading the texts again.

A search counts how often each test word occurs. Every window of test words is looked up by its rarest
word: each posting of it, less the word's offset in the item, is an alignment of the item with the text.
Alignments are intersected with the lists of the next rarest words at their offsets first, those left with
the lists of all words around the anchor. Runs of a whole window at equal offsets are exact phrase
matches; where at least ``near`` of the different item words around the anchor stand around it in the
text, in any order, the match is one of proximity.

Edge cases: a null text has no words; an item without words matches nothing; an item of fewer words than
a window is one window; a null item id counts as the empty text; repeated items give the same hits under each
id; repeated documents are rows of their own; very long texts are postings like any others; ties between
equally rare words go to the first place; empty tables give clean documents or no rows; kept columns may
have any name that the result's columns don't have, and other columns are never read. Words are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW, NEAR = 10, 0.8
#: Test words up to which they are literals, and places of test items and rows of texts up to which they are broadcast; beyond, they are joined by shuffle.
MOST_TERMS, MOST_PLACES, MOST_TEXTS = 20_000, 200_000, 1_000_000
#: Parts of a hot word's postings where they are joined by shuffle.
PARTS = 16

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = " end "  # has blanks, so no word equals it


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased; other capitals stay, so lower() serves only where there are none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(t.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(low, _SEPARATORS), "")


@dataclass(frozen=True)
class Index:
    """Stored postings: h (hash of a word), nr (number of a row) and pos; after a row's last word comes one of its end,
    with the row's kept columns."""

    folder: str

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder)

    def rows(self, spark: SparkSession) -> DataFrame:
        """nr, n_words and the kept columns of every text."""
        ends = self.postings(spark).filter(F.col("h") == F.xxhash64(F.lit(_END)))
        return ends.select("nr", F.col("pos").cast("long").alias("n_words"), "kept.*")


def build(docs: DataFrame, keep: list[str], text: str = "text", folder: str | None = None) -> Index:
    """Store the index of all words of all texts, with the ``keep`` columns of each row."""
    spark = docs.sparkSession
    folder = folder or f"{shared.root(spark)}/postings-{uuid.uuid4().hex}"
    rows = docs.select(F.monotonically_increasing_id().alias("nr"), F.struct(*keep).alias("kept"), F.array_append(words(F.col(text)), F.lit(_END)).alias("w"))
    placed = rows.select("nr", "kept", F.posexplode("w").alias("pos", "word"))
    placed = placed.select(F.xxhash64("word").alias("h"), "nr", "pos", F.when(F.col("word") == _END, F.col("kept")).alias("kept"))
    placed.sortWithinPartitions("h").write.parquet(folder)
    return Index(folder)


def _of_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the words in ``terms`` (h): a literal set of a bounded number, else a join."""
    few = [r.h for r in terms.select("h").distinct().limit(MOST_TERMS + 1).collect()]
    if len(few) <= MOST_TERMS:
        return postings.filter(F.col("h").isin(few)) if few else postings.limit(0)
    return postings.join(terms.select("h").distinct(), "h", "left_semi")


def _items(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_nr, item and the hashes of its words, of every item with words."""
    of = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    of = of.select("item", F.transform("w", lambda x: F.xxhash64(x)).alias("w")).withColumn("item_nr", F.monotonically_increasing_id())
    return shared.table(items.sparkSession, of, "items")


def _places(of: DataFrame, counts: DataFrame, window: int, near: float) -> DataFrame:
    """One row for each place of an item whose word is the rarest of some window.

    h (the word), place (a number), item, off, lo and hi (first and last start of its windows), size (words of a
    window), around (offset from the place and hash of the words up to ``window - 1`` away), different (how many different
    words these are), checks (of which one at least stands near the place in the text of any match; empty if all alignments match).
    """
    placed = of.select("item_nr", F.posexplode("w").alias("off", "h")).join(counts, "h", "left")
    ranked = placed.groupBy("item_nr").agg(F.sort_array(F.collect_list(F.struct("off", F.coalesce("n", F.lit(0)).alias("n"), "h"))).alias("t"))
    rows = of.join(ranked, "item_nr").withColumn("size", F.least(F.lit(window), F.size("w")))
    starts = rows.select("item_nr", "item", "t", "size", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("start"))
    rarest = F.sort_array(F.transform(F.slice("t", F.col("start") + 1, F.col("size")), lambda x: F.struct(x["n"].alias("n"), x["off"].alias("off"), x["h"].alias("h"))))
    starts = starts.withColumn("r", rarest)
    places = starts.groupBy("item_nr", "item", "t", "size", F.col("r")[0]["off"].alias("off"), F.col("r")[0]["h"].alias("h")).agg(
        F.min("start").alias("lo"), F.max("start").alias("hi"), F.collect_set(F.get("r", F.lit(1))["h"]).alias("seconds"))
    left = F.greatest(F.col("off") - (window - 1), F.lit(0))
    around = F.transform(F.slice("t", left + 1, F.col("off") - left + window), lambda x: F.struct((x["off"] - F.col("off")).alias("k"), x["h"].alias("h"), x["n"].alias("n")))
    places = places.withColumn("around", around).withColumn("different", F.size(F.array_distinct(F.transform("around", lambda x: x["h"]))))
    # With at most ``missing`` of the different words missing, one of any ``missing + 1`` others stands there.
    missing = F.col("different") - F.ceil(F.col("different") * F.lit(near) - 1e-9).cast("int")
    others = F.array_distinct(F.transform(F.sort_array(F.transform(F.filter("around", lambda x: x["h"] != F.col("h")), lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h")))), lambda x: x["h"]))
    free = (F.col("size") == 1) | (F.col("different") - missing <= 1)
    checks = F.when(free, F.array().cast("array<bigint>")).otherwise(F.array_union("seconds", F.slice(others, 1, missing + 1)))
    return places.select("h", F.monotonically_increasing_id().alias("place"), "item", "off", "lo", "hi", "size", F.transform("around", lambda x: F.struct(x["k"].alias("k"), x["h"].alias("h"))).alias("around"), "different", checks.alias("checks"))


def _parts(pos: Column, window: int) -> Column:
    """The stretches of positions within reach of one."""
    width, reach = 4 * window, window - 1
    return F.explode(F.sequence(F.floor((pos - reach) / width), F.floor((pos + reach) / width)))


def _near(aligned: DataFrame, wanted: DataFrame, postings: DataFrame, window: int) -> DataFrame:
    """Alignments (nr, pos, place) with each posting of a word in ``wanted`` (place, h, k) that is in reach: k and d, the offset wanted and found."""
    asked = aligned.join(wanted, "place").select("nr", "pos", "place", "h", "k", _parts(F.col("pos"), window).alias("part"))
    there = postings.select("nr", "h", F.col("pos").alias("at"), F.floor(F.col("pos") / (4 * window)).alias("part"))
    met = asked.join(there, ["nr", "h", "part"]).filter(F.abs(F.col("at") - F.col("pos")) < window)
    return met.select("nr", "pos", "place", "h", "k", (F.col("at") - F.col("pos")).alias("d"))


def search(spark: SparkSession, index: Index, items: DataFrame, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, near: float = NEAR) -> DataFrame:
    """Matches: nr, item, exact, and first and last place of the words hit (null unless exact)."""
    postings = index.postings(spark).select("h", "nr", "pos")
    of = _items(items, item_key, item_text)
    terms = of.select(F.explode("w").alias("h")).distinct()
    counts = shared.table(spark, _of_terms(postings, terms).groupBy("h").agg(F.count(F.lit(1)).alias("n")), "counts")
    places = shared.table(spark, _places(of, counts, window, near), "places")
    few = places.limit(MOST_PLACES + 1).count() <= MOST_PLACES
    small = F.broadcast if few else (lambda df: df)

    anchors = _of_terms(postings, places)
    at = places.select("h", "place", (F.size("checks") == 0).alias("free"))
    if few:
        aligned = anchors.join(F.broadcast(at), "h")
    else:
        aligned = anchors.withColumn("part", F.pmod("nr", F.lit(PARTS))).join(at.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>"))), ["h", "part"])
    aligned = shared.table(spark, aligned.select("nr", "pos", "place", "free"), "aligned")

    checks = places.select("place", F.explode("checks").alias("h"), F.lit(0).alias("k"))
    met = _near(aligned.filter("not free"), small(checks), _of_terms(postings, checks), window).select("nr", "pos", "place").distinct()
    left = shared.table(spark, met.unionByName(aligned.filter("free").select("nr", "pos", "place")), "left")

    texts = left.select("nr").distinct()
    texts = F.broadcast(texts) if texts.limit(MOST_TEXTS + 1).count() <= MOST_TEXTS else texts
    around = places.select("place", F.explode("around").alias("a")).select("place", "a.h", "a.k")
    met = _near(left, small(around), _of_terms(postings, terms).join(texts, "nr", "left_semi"), window)
    stands = met.groupBy("nr", "pos", "place").agg(F.collect_set(F.when(F.col("k") == F.col("d"), F.col("k"))).alias("ks"), F.count_distinct("h").alias("n_near"))

    run = lambda step: F.aggregate(F.sequence(F.lit(1), F.lit(window - 1)), F.lit(0), lambda acc, k: F.when((acc == k - 1) & F.array_contains("ks", (k * step).cast("int")), k).otherwise(acc))
    found = stands.join(small(places.drop("h", "around", "checks")), "place").withColumns({"l": run(-1), "r": run(1)})
    found = found.withColumns({"s": F.greatest("lo", F.col("off") - F.col("l")), "e": F.least("hi", F.col("off") + F.col("r") - F.col("size") + 1)})
    exact, shift = F.col("s") <= F.col("e"), F.col("pos") - F.col("off")
    return found.filter(exact | (F.col("n_near") >= F.ceil(F.col("different") * F.lit(near) - 1e-9))).select(
        "nr", "item", exact.alias("exact"), F.when(exact, F.col("s") + shift).alias("first"), F.when(exact, F.col("e") + shift + F.col("size") - 1).alias("last"))


def answer(spark: SparkSession, index: Index, items: DataFrame, **names) -> DataFrame:
    """Per document: the kept columns, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items (items with an exact or a proximity match)."""
    spans = search(spark, index, items, **names).groupBy("nr").agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.struct("first", "last")))).alias("spans"),
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"),
        F.count_distinct("item").alias("n_near_items"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    covered = F.aggregate("spans", zero, lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["end"], x["first"] - 1))).alias("n"), F.greatest(acc["end"], x["last"]).alias("end")), lambda acc: acc["n"])
    got = spans.select("nr", covered.cast("long").alias("n_hit"), "items", F.col("n_near_items").cast("long").alias("n_near_items"))
    none = F.array().cast("array<string>")
    joined = index.rows(spark).join(got, "nr", "left").withColumns({"items": F.coalesce("items", none), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long"))})
    return joined.withColumns({
        "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0,
        "n_near_items": F.coalesce("n_near_items", F.lit(0).cast("long"))}).drop("nr", "items")


def report(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", **names) -> DataFrame:
    """``answer`` from an index made for it alone."""
    return answer(docs.sparkSession, build(docs, keep, text), items, **names)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """The documents, with all columns, that have no exact match; rows count by themselves, whatever their ids.

    Proximity matches aren't asked for, so that only places with all words of a neighbourhood are looked for besides exact ones.
    """
    rows = shared.located(shared.renamed(docs))
    index = build(rows.select(*shared.PLACE, F.col(f"__{docs.columns.index(text)}").alias("text")), shared.PLACE)
    found = search(docs.sparkSession, index, items, **({"near": 1.0} | names)).filter("exact").select("nr").distinct()
    return shared.without(rows, index.rows(docs.sparkSession).join(found, "nr", "left_semi")).toDF(*docs.columns)
