"""Domain class frequencies: how often concepts and what lies above them are mentioned in a domain."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from .. import storage
from .corpus import first_k, sections
from .ontology import branch_filter, labels, spread_join

# Roots of the branches that are left out.
EXCLUDED_ROOTS = ("362981000", "444677008", "419891008", "276339004", "106237007", "900000000000441003")
OWN, ABOVE = 0.75, 0.25


def _first(pos: Column, kind: DataType, place: Column) -> Column:
    """What orders pairs of a position and a place as a struct does; one number for numbers, since Spark sorts all rows for the least struct, and hashes for the least number."""
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return F.struct(pos, place)
    return F.coalesce(pos.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)") + place.cast("decimal(10,0)")


def _counted(mentions: DataFrame, by: list[str]) -> DataFrame:
    return mentions.groupBy(*by, "concept_id").agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("p"))


def ancestor_counts(mentions: DataFrame, up: DataFrame, by: list[str]) -> DataFrame:
    """by, concept_id, freq, first_pos: mentions of the ancestors of mentioned concepts, themselves left out.

    Mentions (by, concept_id, _pos) are counted before they meet their ancestors, so the join grows
    with the number of distinct concepts, not of mentions. first_pos orders ties: the first mention
    that brings the ancestor, and there the ancestor's place.
    """
    joined = _counted(mentions, by).join(up, F.col("concept_id") == F.col("id"))
    first = _first(F.col("p"), mentions.schema["_pos"].dataType, F.col("bfs_pos"))
    return joined.groupBy(*by, F.col("ancestor").alias("concept_id")).agg(F.sum("n").cast("double").alias("freq"), F.min(first).alias("first_pos"))


def adjusted(freqs: DataFrame, up: DataFrame) -> DataFrame:
    """Frequencies that favour general concepts: 0.75 of the count less 0.25 for each ancestor, one at least."""
    n = up.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    return freqs.join(n, F.col("concept_id") == F.col("__id"), "left").withColumn("freq", OWN * F.col("freq") - ABOVE * F.greatest(F.coalesce("__n", F.lit(0)), F.lit(1))).drop("__id", "__n")


def top(freqs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent of every group; ties go to the first seen."""
    w = Window.partitionBy(*by).orderBy(F.desc("freq"), "first_pos", "concept_id")
    return freqs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def domain_frequencies(mentions: DataFrame, up: DataFrame, k: int, roots: list[str], by: str = "domain") -> DataFrame:
    """Counts outside the excluded branches, cut to the top, then adjusted."""
    kept = branch_filter(ancestor_counts(mentions, up, [by]), "concept_id", up, roots)
    return adjusted(top(kept, [by], k).drop("rank"), up)


def note_concepts(mentions: DataFrame, up: DataFrame, k: int, roots: list[str], by: str = "note_id") -> DataFrame:
    """Counts outside the excluded branches, adjusted, then cut to the top.

    Which ancestors are outside is told before mentions meet them, and all that a note's mention brings moves to the note as one row.
    """
    spark = up.sparkSession
    good = branch_filter(up.select(F.col("ancestor").alias("id")).distinct(), "id", up, roots)
    n = up.join(good, "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("__n"))  # what is outside has an ancestor
    above = spread_join(up, "ancestor", storage.table(spark, n, "outside"), F.col("id"), "inner")
    above = above.groupBy("id").agg(F.collect_list(F.struct("ancestor", "bfs_pos", "__n")).alias("__above"))
    met = _counted(mentions, [by]).join(above, F.col("concept_id") == F.col("id")).repartition(by).select(by, "n", "p", F.inline("__above"))
    first = _first(F.col("p"), mentions.schema["_pos"].dataType, F.col("bfs_pos"))
    freqs = met.groupBy(by, F.col("ancestor").alias("concept_id")).agg(F.sum("n").cast("double").alias("freq"), F.min(first).alias("first_pos"), F.max("__n").alias("__n"))
    return top(freqs.withColumn("freq", OWN * F.col("freq") - ABOVE * F.col("__n")).drop("__n"), [by], k)


def normalise(freqs: DataFrame, n_domains: int, by: str = "domain") -> DataFrame:
    """Less the mean over all domains, where a domain without the concept counts as 0."""
    mean = freqs.groupBy("concept_id").agg((F.sum("freq") / F.lit(float(n_domains))).alias("__mean"))
    return freqs.join(mean, "concept_id").withColumn("freq", F.col("freq") - F.col("__mean")).drop("__mean")


def concepts(freqs: DataFrame) -> DataFrame:
    """The concepts of all domains."""
    return freqs.select("concept_id").distinct()


def domain_concepts(mentions: DataFrame, up: DataFrame, roots: list[str], allowed: DataFrame, by: str = "note_id") -> DataFrame:
    """by, concept_id: the ancestors of what a text mentions that are outside the excluded branches and in a set; each once."""
    pairs = mentions.select(by, "concept_id").distinct().join(up, F.col("concept_id") == F.col("id")).select(by, F.col("ancestor").alias("concept_id")).distinct()
    kept = branch_filter(pairs, "concept_id", up, roots)
    return kept.join(allowed.select(F.col("id").alias("concept_id")).distinct(), "concept_id", "left_semi").select(by, "concept_id")


def capped_frequencies(notes: DataFrame, mentions: DataFrame, up: DataFrame, note: str, order: list[str], notes_each: int, k: int, roots: list[str], by: str = "domain") -> DataFrame:
    """Frequencies of every domain from its first notes, less their mean over the domains. notes: (by, note, order columns); mentions: (note, concept_id, _pos)."""
    first = first_k(notes, by, order, notes_each)
    own = mentions.join(first.select(note, by), note)
    n = notes.select(by).distinct().count()
    return normalise(domain_frequencies(own, up, k, roots, by), n, by)


def section_frequencies(notes: DataFrame, text: str, annotate: Callable[[DataFrame, str], DataFrame], up: DataFrame, key: str, order: list[str], limit: int, k: int, roots: list[str], domain: str = "BHC") -> DataFrame:
    """Frequencies in the sections of the first notes, as one domain; notes without a section count for nothing. annotate: gives
    mentions (key, concept_id, start) of (key, text)."""
    first = sections(notes.orderBy(*order).limit(limit), text, F.lit(True), "__section").filter(F.col("__section").isNotNull())
    found = annotate(first.select(key, F.col("__section").alias("text")), "text")
    mentions = found.select(F.lit(domain).alias("domain"), "concept_id", F.struct(key, "start").alias("_pos"))
    return domain_frequencies(mentions, up, k, roots)


def rings(freqs: DataFrame, concepts: DataFrame, k: int, by: str = "domain") -> DataFrame:
    """The top concepts of each domain for a nested chart: id 'domain-concept', label, and the share of its ring."""
    best = labels(top(freqs, [by], k), concepts, "concept_id", "label")
    n = best.agg(F.count(F.lit(1)).alias("__n"), F.count_distinct(by).alias("__d"))  # one row
    return best.join(F.broadcast(n)).select(by, "rank", F.concat_ws("-", by, "concept_id").alias("id"), "label", (1 / (F.col("__n") * F.col("__d"))).alias("share"))


def replace_domain(freqs: DataFrame, new: DataFrame, domain: str, by: str = "domain") -> DataFrame:
    return freqs.filter(F.col(by) != domain).unionByName(new)
