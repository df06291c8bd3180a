"""Statement pairs: choices, dedupe, both labels, pivots, shards of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import choice, let


def valid_choice_question(df: DataFrame, question: str = "question", options: tuple[str, ...] = ("opa", "opb", "opc", "opd")) -> DataFrame:
    """Drops questions about exceptions, ones whose last option refers to others, and true-or-false ones."""
    low = [F.lower(F.col(c)) for c in options]
    bad = low[-1].contains("the above") | F.col(question).contains("except")
    for o in low:
        bad = bad | o.contains("true") | o.contains("false")
    return df.filter(~bad)


def two_answers(df: DataFrame, options: Column, right: Column, key: Column) -> DataFrame:
    """Two rows for each: the right answer, and a wrong one chosen by a stable hash; options are a map."""
    wrong = F.array_sort(F.map_keys(F.map_filter(options, lambda k, v: k != right)))
    pick = F.get(wrong, choice(key, F.greatest(F.size(wrong), F.lit(1))).cast("int"))
    both = F.array(
        F.struct(F.lit(True).alias("is_correct"), F.try_element_at(options, right).alias("answer")),
        F.struct(F.lit(False).alias("is_correct"), F.try_element_at(options, pick).alias("answer")))
    return df.select("*", F.explode(both).alias("__a")).select("*", "__a.*").drop("__a")


def both_ways(df: DataFrame, label: str = "factual") -> DataFrame:
    """Every row as True and as False."""
    return df.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias(label))


def first_seen(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("__nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nr = 1").drop("__nr")


def having_both(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows of keys that have both labels."""
    good = df.groupBy(*keys).agg(F.count_distinct(label).alias("__n")).filter("__n = 2").select(*keys)
    return df.join(good, keys, "left_semi")


def pivot_pairs(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """One row a key with the values of its true and its false row."""
    pick = lambda want: F.max(F.when(F.col(label) == want, F.col(value)))
    return df.groupBy(*keys).agg(pick(True).alias("factual"), pick(False).alias("hallucinated"))


def projections(df: DataFrame, keep: list[str], pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Several (name, text column, summary column) of one table as rows, in one scan; empty texts are left out."""
    each = F.array(*(F.struct(F.lit(n).alias("pair"), F.col(a).alias("text"), F.col(b).alias("summary")) for n, a, b in pairs))
    rows = df.select(*keep, F.explode(each).alias("e")).select(*keep, "e.*")
    return rows.filter((F.length("text") > 0) & (F.length("summary") > 0))


def swapped_value(df: DataFrame, concept: str, value: str, order: list[str | Column], key: Column) -> DataFrame:
    """Adds ``other_value``: a value of the same concept chosen by a stable hash, by how often it occurs; null where
    the concept has no other row. Rows are numbered by concept in parts, so no concept is collected."""
    parts = 64
    spread = df.withColumn("__part", choice(F.concat_ws("|", *order), parts))
    sizes = spread.groupBy(concept, "__part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select(concept, "__part", (F.sum("n").over(Window.partitionBy(concept).orderBy("__part")) - F.col("n")).alias("__start"), F.sum("n").over(Window.partitionBy(concept)).alias("__n"))
    placed = spread.join(starts, [concept, "__part"]).withColumn("__at", F.col("__start") + F.row_number().over(Window.partitionBy(concept, "__part").orderBy(*order)) - 1)
    step = F.when(F.col("__n") > 1, choice(key, F.greatest(F.col("__n") - 1, F.lit(1))) + 1)
    wanted = placed.withColumn("__want", F.pmod(F.col("__at") + step, F.col("__n")))
    values = placed.select(F.col(concept).alias("__c"), F.col("__at").alias("__a"), F.col(value).alias("other_value"))
    got = wanted.join(values, (wanted[concept] == values["__c"]) & (wanted["__want"] == values["__a"]), "left")
    return got.drop("__part", "__start", "__n", "__at", "__want", "__c", "__a")


def with_corrupted(df: DataFrame, concept: str, value: str, order: list[str], key: Column) -> DataFrame:
    """Every row as true, and once more as false with another value of its concept in ``corrupted_value`` (null for true rows, and where
    the concept has no other value)."""
    swapped = swapped_value(df, concept, value, order, key)
    true = df.withColumns({"factual": F.lit(True), "corrupted_value": F.lit(None).cast("string")})
    return true.unionByName(swapped.withColumn("factual", F.lit(False)).withColumnRenamed("other_value", "corrupted_value"))


def scatter(leaves: DataFrame, group: str, concepts: list[str], lists: list[str]) -> DataFrame:
    """Leaves (group, pos, path, value) of JSON trees as concept rows: category, concept, value and concept_reference.

    The first step of a path is the category, the last the concept; unknown concepts and 'None' are left out. In a category that is a list, an
    element is named by the first value kept of it in a run of rows of that element; other categories have the reference 'None'.
    """
    rows = leaves.select("*", F.lower(F.get("path", F.lit(0))).alias("category"), F.lower(F.element_at("path", -1)).alias("concept"))
    rows = rows.filter(F.col("concept").isin(*concepts) & F.col("value").isNotNull() & (F.col("value") != "None"))
    rows = rows.withColumn("__list", F.col("category").isin(*lists)).withColumn("__index", F.when(F.col("__list"), F.get("path", F.lit(1))))
    named = run_first(rows, group, "pos", "category", "__index", "value", "__name")
    return named.withColumn("concept_reference", F.when(F.col("__list"), F.col("__name")).otherwise("None")).drop("__list", "__index", "__name")


def rows_of_maps(df: DataFrame, keys: list[str], methods: dict[str, str]) -> DataFrame:
    """Maps from concept to value in columns as rows (keys, concept_id, value, method); ``methods`` names the method of each column."""
    each = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("map")) for c, m in methods.items()))
    rows = df.select(*keys, F.explode(each).alias("e")).select(*keys, "e.method", F.explode("e.map").alias("concept_id", "value"))
    return rows.select(*keys, "concept_id", "value", "method")


def maps_of_rows(df: DataFrame, note: str, concept: str, value: str, order: str) -> DataFrame:
    """A map from concept to value for each note; of a concept's values the last in order counts."""
    last = df.groupBy(note, concept).agg(F.max_by(value, order).alias("__v"))
    return last.groupBy(note).agg(F.map_from_entries(F.collect_list(F.struct(concept, "__v"))).alias("extraction"))


def run_first(df: DataFrame, group: str, order: str, category: str, index: str, value: str, into: str) -> DataFrame:
    """The first value of every run of rows with equal category and index."""
    w = Window.partitionBy(group).orderBy(order)
    change = ~(F.col(category).eqNullSafe(F.lag(category).over(w)) & F.col(index).eqNullSafe(F.lag(index).over(w)))
    numbered = df.withColumn("__new", F.coalesce(change, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return numbered.withColumn(into, F.first(value).over(Window.partitionBy(group, "__run").orderBy(order))).drop("__new", "__run")


def split_sentence(sentences: Column, key: Column) -> Column:
    """Struct (sentence, before, after, n_sentences) around a sentence chosen by a stable hash, never the last; empty for fewer than two."""

    def around(s: Column) -> Column:
        n = F.size(s)
        at = choice(key, F.greatest(n - 1, F.lit(1))).cast("int")
        part = lambda c: F.when(n < 2, F.lit("")).otherwise(c)
        return F.struct(
            part(F.get(s, at)).alias("sentence"), part(F.array_join(F.slice(s, 1, at), " ")).alias("before"),
            part(F.array_join(F.slice(s, at + 2, F.greatest(n - at - 1, F.lit(0))), " ")).alias("after"), n.alias("n_sentences"))

    return let(sentences, around)


def long_sentence(sentences: Column, key: Column, least: int = 100) -> Column:
    """A sentence of more than ``least`` characters chosen by a stable hash; null if there is none."""
    pick = lambda some: F.get(some, choice(key, F.greatest(F.size(some), F.lit(1))).cast("int"))
    return let(F.filter(sentences, lambda s: F.length(s) > least), pick)
