"""Statistics by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import word_count
from ..sources import with_pos


def shares(df: DataFrame, category: str) -> DataFrame:
    """n and share of every category."""
    got = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    total = got.agg(F.sum("n").alias("__total"))  # one row
    return got.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")


def at_least(df: DataFrame, category: str, k: int) -> DataFrame:
    """Rows of categories with at least k rows."""
    return df.join(df.groupBy(category).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= k).select(category), category, "left_semi")


def coded_rare(df: DataFrame, category: str, k: int, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Categories with fewer than k rows under one label that is stored once, apart from the rows.

    ``columns``: all columns in which values that are rare categories count; the category alone by default. Null is no category. Each column
    ``c`` gets ``c_label``: 0, the number of the label, where its value is rare, else null. The label is a table of its own (label_id, nr, name): the rare
    names in order. Rows grow by a number and the label by its names, however many there are; nothing is broadcast.
    """
    rare = df.filter(F.col(category).isNotNull()).groupBy(category).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") < k).select(F.col(category).alias("name"))
    names = storage.table(df.sparkSession, with_pos(rare, ["name"]).select(F.lit(0).alias("label_id"), F.col("_pos").alias("nr"), "name"), "rare")
    for c in columns or [category]:
        df = df.join(names.select(F.col("name").alias("__r")), df[c] == F.col("__r"), "left").withColumn(f"{c}_label", F.when(F.col("__r").isNotNull(), 0)).drop("__r")
    return df, names


def collapse_rare(df: DataFrame, category: str, k: int, columns: list[str] | None = None, between: str = ", ") -> DataFrame:
    """As ``coded_rare``, with the label written out in every row that has it, as one text that lists its names: for few rare names."""
    given = df.columns
    coded, names = coded_rare(df, category, k, columns)
    text = F.concat(F.lit("Others ("), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nr", "name"))), lambda x: x["name"]), between), F.lit(")"))
    label = storage.table(df.sparkSession, names.groupBy("label_id").agg(text.alias("__others")), "label")  # one row, or none
    for c in columns or [category]:
        coded = coded.join(label, coded[f"{c}_label"] == F.col("label_id"), "left").withColumn(c, F.coalesce("__others", c)).drop("label_id", "__others")
    return coded.select(*given)


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Rows in every bin of equal width; 0 below and bins + 1 above the range, as width_bucket numbers them."""
    return df.groupBy(*(by or []), F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def diversity(df: DataFrame, category: str, text: str, concepts: Column) -> DataFrame:
    """Mean over texts of concepts per word, and the number of texts, by category."""
    ratio = F.try_divide(concepts.cast("double"), word_count(F.col(text)).cast("double"))
    return df.groupBy(category).agg(F.round(F.avg(ratio), 4).alias("diversity"), F.count(F.lit(1)).alias("n"))
