"""Corpus curation: null filters, groups of notes, caps, sections and splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import choice, section

#: A condition on a group, from its aggregates; ``filter_groups`` takes any number of them.
GroupFilter = Callable[[], Column]


def exactly_one(df: DataFrame, group: str, cond: Column) -> DataFrame:
    """Rows of groups in which exactly one row meets the condition."""
    good = df.groupBy(group).agg(F.count_if(cond).alias("__n")).filter("__n = 1").select(group)
    return df.join(good, group, "left_semi")


def format_notes(df: DataFrame, group: str, order: list[Column], required: list[str], anchor: Column) -> DataFrame:
    """Drops rows with nulls in ``required``, keeps groups with one anchor row, adds NOTE_ORDER from 0."""
    kept = exactly_one(df.dropna(subset=required), group, anchor)
    return kept.withColumn("NOTE_ORDER", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def filter_groups(df: DataFrame, group: str, predicates: list[Column]) -> DataFrame:
    """Rows of groups that meet every predicate; predicates are expressions of aggregates."""
    named = [p.alias(f"__p{i}") for i, p in enumerate(predicates)]
    good = df.groupBy(group).agg(*named).filter(reduce(lambda a, b: a & b, (F.col(f"__p{i}") for i in range(len(named))), F.lit(True))).select(group)
    return df.join(good, group, "left_semi")


def note_count(most: int) -> Column:
    return F.count(F.lit(1)) <= most


def longest(length: Column, most: int) -> Column:
    return F.max(length) <= most


def cap_groups(df: DataFrame, group: str, order: list[str], first: int) -> DataFrame:
    """All rows of the groups that are seen among the first rows of an order."""
    return df.join(df.orderBy(*order).limit(first).select(group).distinct(), group, "left_semi")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def sections(df: DataFrame, text: str, where: Column, into: str = "BHC") -> DataFrame:
    """Adds the section of the rows that meet the condition; null for others and without a heading."""
    return df.withColumn(into, F.when(where, section(F.col(text))))


def first_k(df: DataFrame, by: str, order: list[str | Column], k: int) -> DataFrame:
    """The first k rows of every category in an order."""
    return df.withColumn("__nr", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__nr") <= k).drop("__nr")


def within_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows up to a length; no limit if it isn't positive."""
    return df.filter(length <= most) if most > 0 else df


def split(df: DataFrame, key: str, shares: tuple[tuple[str, int], ...] = (("train", 90), ("val", 5), ("test", 5)), salt: str = "") -> DataFrame:
    """Adds ``split`` by a stable hash of the key, in percent."""
    b, edge, out = choice(F.col(key), 100, salt), 0, None
    for name, share in shares:
        edge += share
        out = F.when(b < edge, F.lit(name)) if out is None else out.when(b < edge, F.lit(name))
    return df.withColumn("split", out)


def shuffled(df: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """Adds ``shuffle_key``, by which the rows are in a seeded random order."""
    return df.withColumn("shuffle_key", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key), F.lit(str(seed)))))


def mix(df: DataFrame, source: str, order: list[str], fractions: dict[str, float]) -> DataFrame:
    """The first floor(fraction * n) rows of every source named; a negative fraction is an error."""
    if any(f < 0 for f in fractions.values()):
        raise ValueError("fractions must not be negative")
    if not fractions:
        return df.limit(0)
    share = F.create_map(*(F.lit(x) for kv in fractions.items() for x in kv))
    return first_by(df.filter(F.col(source).isin(*fractions)), source, order, lambda sizes: sizes.withColumn("__take", F.floor(F.element_at(share, F.col("__category")) * F.col("__n"))))


def mixed(train: DataFrame, val: DataFrame, source: str, order: list[str], fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """A mix of the training rows by fractions and all validation rows of the same sources, under ``split``, with the place of each in
    a seeded order of its split."""
    both = mix(train, source, order, fractions).withColumn("split", F.lit("train")).unionByName(val.filter(F.col(source).isin(*fractions)).withColumn("split", F.lit("val")))
    ranked = numbered_by(shuffled(both, ["split", *order], seed), "split", ["shuffle_key", *order])
    return ranked.withColumn("place", F.col("__nr")).drop("__n", "__nr", "shuffle_key")


def numbered_by(df: DataFrame, by: str, order: list[str | Column], parts: int = 64) -> DataFrame:
    """Adds ``__nr``, the place from 0 of a row among those of its category in an order, and ``__n``, their number.

    Each category is cut into ranges of the order and these are numbered apart, so that a hot category isn't one task's.
    """
    key = F.struct(by, *order)
    cuts = storage.table(df.sparkSession, df.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = cuts.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(by)
    starts = sizes.select(F.col(by).alias("__by"), F.col("__part").alias("__p"), (F.sum("__c").over(w.orderBy("__part")) - F.col("__c")).alias("__start"), F.sum("__c").over(w).alias("__n"))
    placed = cuts.withColumn("__in", F.row_number().over(Window.partitionBy(by, "__part").orderBy(key)) - 1)
    joined = placed.join(starts, placed[by].eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__p")))
    return joined.withColumn("__nr", F.col("__start") + F.col("__in")).drop("__part", "__by", "__p", "__start", "__in")


def first_by(df: DataFrame, by: str, order: list[str | Column], take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first rows of every category in an order, as many as ``take`` says: it adds ``__take`` to the sizes of categories (``__category``, ``__n``).

    Places are found on the category and the order alone; then each category has a cut, and one filter keeps what is before it where it
    lies. Only rows that are equal to a cut in the order, where some but not all of them are wanted, are moved. The rows are read three
    times, so they must be the same each time. Null is a category.
    """
    key = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"k{i}") for i, o in enumerate(order)))
    ranked = numbered_by(df.select(F.col(by).alias("__category"), key.alias("__key")), "__category", ["__key"])
    sizes = storage.table(df.sparkSession, take(ranked.groupBy("__category").agg(F.count(F.lit(1)).alias("__n"))), "sizes")
    wanted = sizes.filter("__take > 0").select(F.col("__category").alias("__of"), F.least("__take", "__n").alias("__take"))
    at = ranked.join(wanted, ranked["__category"].eqNullSafe(F.col("__of")) & (F.col("__nr") == F.col("__take") - 1)).select("__of", "__take", F.col("__key").alias("__cut"))
    same = ranked.join(at, ranked["__category"].eqNullSafe(F.col("__of")) & (F.col("__key") == F.col("__cut"))).groupBy("__of", "__take", "__cut")
    cuts = storage.table(df.sparkSession, same.agg((F.col("__take") - F.min("__nr")).alias("__ties"), F.count(F.lit(1)).alias("__same")), "cuts")
    joined = df.join(cuts, df[by].eqNullSafe(F.col("__of")))
    out = joined.filter((key < F.col("__cut")) | (key == F.col("__cut")) & (F.col("__ties") == F.col("__same"))).select(*df.columns)
    if cuts.filter("__ties < __same").isEmpty():
        return out
    tied = joined.filter((key == F.col("__cut")) & (F.col("__ties") < F.col("__same"))).select(*df.columns, "__ties")
    return out.unionByName(numbered_by(tied, by, order).filter("__nr < __ties").select(*df.columns))


def balanced(df: DataFrame, task: str, order: list[str | Column]) -> DataFrame:
    """As many rows of every task as the rarest one has, the first in an order."""
    return first_by(df, task, order, lambda sizes: sizes.join(F.broadcast(sizes.agg(F.min("__n").alias("__take")))))


def sliced(df: DataFrame, start: int, end: int, pos: str = "_pos") -> DataFrame:
    """Rows by place from ``start`` up to ``end``."""
    return df.filter((F.col(pos) >= start) & (F.col(pos) < end))


def counted(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and one row with how many were given, kept and dropped; null doesn't meet it."""
    said = F.coalesce(where, F.lit(False))
    return df.filter(said), df.agg(F.count(F.lit(1)).alias("given"), F.count_if(said).alias("kept"), F.count_if(~said).alias("dropped"))


def updated(df: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Columns merged into rows: new ones are added, ones that are there are replaced; all see the row as it was."""
    return df.withColumns(more)


def random_row(df: DataFrame, key: str, where: Column | None = None, seed: str = "42") -> DataFrame:
    """One row, chosen by a seeded hash of the key."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(1)
