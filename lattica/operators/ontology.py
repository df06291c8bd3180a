"""Ontology algebra over edges (child, parent, parent_pos): closure, filters, pruning, descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.scores import bigram_share


def closure(edges: DataFrame, levels: int | None = None) -> DataFrame:
    """id, ancestor, depth, bfs_pos of every ancestor.

    depth is the least number of steps; bfs_pos (from 1) is the place at which a breadth-first walk
    that takes parents in order meets the ancestor. Only new pairs go on to the next level, so shared
    parents do not multiply and cycles end; a node is its own ancestor only on a cycle. The loop ends when a
    level brings nothing new, and the finished pairs are written once, so that any use of them is one scan. With ``levels``
    it ends after so many; the first ``levels`` places are right then, since every level before the last one fills one.
    Only edges of concepts that have children lead on. They are written, so that Spark knows if they are few enough to be sent to all
    tasks: most concepts lie below the same few, and all those would meet in one task.
    """
    spark = edges.sparkSession
    inner = edges.select(F.col("parent").alias("__c")).distinct()
    step = edges.select(F.col("child").alias("__c"), F.col("parent").alias("__p"), F.col("parent_pos").cast("int").alias("__o")).join(inner, "__c", "left_semi")
    step = storage.table(spark, step, "inner-edges")
    level = edges.groupBy(F.col("child").alias("id"), F.col("parent").alias("ancestor")).agg(F.min(F.array(F.col("parent_pos").cast("int"))).alias("path"))
    level = storage.table(spark, level.withColumn("depth", F.lit(1)), "closure")
    found, depth = [level], 1
    while (levels is None or depth < levels) and not level.isEmpty():
        depth += 1
        seen = found[0]
        for other in found[1:]:
            seen = seen.unionByName(other)
        reached = level.join(step, level["ancestor"] == step["__c"]).groupBy("id", F.col("__p").alias("ancestor")).agg(F.min(F.concat("path", F.array("__o"))).alias("path"))
        level = storage.table(spark, reached.join(seen.select("id", "ancestor"), ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        found.append(level)
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    place = F.row_number().over(Window.partitionBy("id").orderBy("depth", "path"))
    return storage.table(spark, whole.select("id", "ancestor", "depth", place.alias("bfs_pos")), "closure")


def parents(edges: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("child") == of).orderBy("parent_pos").select("parent")


def children(edges: DataFrame, of: str) -> DataFrame:
    return edges.filter(F.col("parent") == of).select("child").distinct()


def children_count(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("id")).agg(F.count_distinct("child").alias("n_children"))


def paths(edges: DataFrame, of: str) -> DataFrame:
    """Every path from a node to a node without parents, as an array of ids; a path ends where a cycle would begin again."""
    spark = edges.sparkSession
    step = edges.select(F.col("child").alias("__c"), F.col("parent").alias("__p"))
    now = spark.createDataFrame([([of],)], "path array<string>")
    done = []
    while not now.isEmpty():
        last = F.element_at("path", -1)
        joined = storage.table(spark, now.join(step, (last == F.col("__c")) & ~F.array_contains("path", F.col("__p")), "left"), "paths")
        done.append(joined.filter("__p is null").select("path"))
        now = joined.filter("__p is not null").select(F.concat("path", F.array("__p")).alias("path"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def labels(df: DataFrame, concepts: DataFrame, key: str, into: str) -> DataFrame:
    """Adds the label of a concept; null if it is unknown."""
    return df.join(concepts.select(F.col("id").alias("__id"), F.col("label").alias(into)), df[key] == F.col("__id"), "left").drop("__id")


def branch_filter(df: DataFrame, key: str, up: DataFrame, bases: list[str]) -> DataFrame:
    """Without the bases, what lies below them, and concepts that have no ancestor."""
    below = up.filter(F.col("ancestor").isin(bases)).select(F.col("id").alias("__id")).distinct()
    known = up.select(F.col("id").alias("__id")).distinct()
    kept = df.filter(~F.col(key).isin(bases))
    return kept.join(known, kept[key] == known["__id"], "left_semi").join(below, F.col(key) == below["__id"], "left_anti")


def set_filter(df: DataFrame, key: str, allowed: DataFrame) -> DataFrame:
    """Distinct keys that are in a set of ids."""
    return df.select(key).distinct().join(allowed.select(F.col("id").alias(key)).distinct(), key, "left_semi")


#: Tasks that the rows of one concept are dealt to.
SPREAD = 16


def spread_join(df: DataFrame, key: str, ids: DataFrame, by: Column, how: str = "left_semi") -> DataFrame:
    """``df`` joined with ``ids`` by its key (their ``id``, named __id). A key that most rows have is dealt to ``SPREAD`` tasks by another column, and every id to each of these."""
    parts = F.broadcast(df.sparkSession.range(SPREAD).select(F.col("id").cast("int").alias("__part")))
    copies = ids.withColumnRenamed("id", "__id").crossJoin(parts)  # a product, so that Spark doesn't take the copies for as few as the ids
    joined = df.join(copies, (F.col(key) == F.col("__id")) & (F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int") == F.col("__part")), how)
    return joined.drop("__part")


def prunable(up: DataFrame, allowed: DataFrame, alpha: int = 2) -> DataFrame:
    """The ids of the concepts that are allowed or have an allowed one among their first ``alpha`` ancestors."""
    ok = storage.table(up.sparkSession, allowed.select("id").filter("id is not null").distinct(), "allowed")
    near = up.filter(F.col("bfs_pos") <= alpha).join(ok.withColumnRenamed("id", "__ok"), F.col("ancestor") == F.col("__ok"), "left_semi").select("id")
    return ok.unionByName(near).distinct()


def prune(extractions: DataFrame, up: DataFrame, allowed: DataFrame, edges: DataFrame | None = None, alpha: int = 2) -> DataFrame:
    """Extractions (row_id, concept_id, value) whose concept, or one of its first ``alpha`` ancestors, is allowed.

    With ``edges`` (smart pruning), an ancestor goes if a kept concept below it that has children of
    its own has the same value. Which concepts can make which go is told before any extraction is looked at: both are kept ones, and both have children.
    """
    ids = prunable(up, allowed, alpha)
    if edges is None:
        return spread_join(extractions, "concept_id", ids, F.col("row_id"))
    spark = up.sparkSession
    ids = storage.table(spark, ids, "kept-ids")
    kept = spread_join(extractions, "concept_id", ids, F.col("row_id"))
    inner = storage.table(spark, ids.join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_semi"), "kept-parents")
    named = lambda c: inner.select(F.col("id").alias(c))
    above = up.filter(F.col("ancestor") != F.col("id")).join(named("__low"), F.col("id") == F.col("__low"), "left_semi").join(named("__high"), F.col("ancestor") == F.col("__high"), "left_semi")
    above = storage.table(spark, above.select("id", "ancestor"), "kept-above")
    if above.isEmpty():
        return kept
    gone = spread_join(kept, "concept_id", above, F.col("row_id"), "inner").select(F.col("row_id").alias("__r"), F.col("ancestor").alias("__a"), F.col("value").alias("__v")).distinct()
    return kept.join(gone, (F.col("row_id") == F.col("__r")) & (F.col("concept_id") == F.col("__a")) & F.col("value").eqNullSafe(F.col("__v")), "left_anti")


def hierarchy_score(df: DataFrame, up: DataFrame, base: str, other: str, known: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``h``: 0 for a concept that isn't among the ``known`` ids, 1 for the base itself, 0 below an excluded branch,
    else 1 if the concept lies below the base and 0 if not; null concepts get 0."""
    ids = known.select(F.col("id").alias("__k")).distinct().withColumn("__known", F.lit(True))
    pairs = up.select(F.col("id").alias("__i"), F.col("ancestor").alias("__a")).withColumn("__hit", F.lit(True))
    out = up.filter(F.col("ancestor").isin(*excluded)).select(F.col("id").alias("__o")).distinct().withColumn("__out", F.lit(True))
    joined = df.join(ids, df[other] == F.col("__k"), "left").join(pairs, (df[other] == F.col("__i")) & (df[base] == F.col("__a")), "left").join(out, df[other] == F.col("__o"), "left")
    h = F.when(F.col("__known").isNull(), 0).when(F.col(other) == F.col(base), 1).when(F.col("__out"), 0).otherwise(F.when(F.col("__hit"), 1).otherwise(0))
    return joined.withColumn("h", h).drop("__k", "__known", "__i", "__a", "__hit", "__o", "__out")


def members(df: DataFrame, key: str, concepts: DataFrame) -> DataFrame:
    """Adds ``known``: whether the ontology has the concept."""
    ids = concepts.select(F.col("id").alias("__id")).distinct()
    return df.join(ids, df[key] == F.col("__id"), "left").withColumn("known", F.col("__id").isNotNull()).drop("__id")


def composed(df: DataFrame, key: str, filters: list[Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Filters of concepts (frame, key) one after the other."""
    for f in filters:
        df = f(df, key)
    return df


def property_value(prop_type: Column, values: Column) -> Column:
    """Labels of a property joined by ' or ' for alternatives, by blanks otherwise."""
    items = F.map_values(values)
    return F.when(prop_type == "or", F.array_join(items, " or ")).otherwise(F.array_join(items, " "))


def property_scores(df: DataFrame, properties: DataFrame, up: DataFrame, keys: list[str], base: str, other: str, context: str | None = None) -> DataFrame:
    """keys and ``p``: how far the properties of the base concept speak of another concept.

    Each entry of a property adds 1 / entries if one of its ends is the concept, and again if its value lies above the
    concept. With a ``context``, the share of the properties' bigrams that the context has is added, and the
    sum halved. A base without properties gets 0.
    """
    entry = F.explode(F.map_entries("ids")).alias("e")
    entries = properties.select(F.col("concept_id").alias("__b"), F.size("ids").alias("__n"), entry).select("__b", "__n", F.col("e.key").alias("__k"), F.col("e.value").alias("__v"))
    above = up.select(F.col("id").alias("__i"), F.col("ancestor").alias("__a")).distinct().withColumn("__up", F.lit(1))
    pairs = df.select(*keys, F.col(base).alias("__base"), F.col(other).alias("__other")).join(entries, F.col("__base") == F.col("__b"))
    pairs = pairs.join(above, (F.col("__i") == F.col("__other")) & (F.col("__a") == F.col("__v")), "left")
    direct = ((F.col("__k") == F.col("__other")) | (F.col("__v") == F.col("__other"))).cast("int")
    sums = pairs.groupBy(*keys).agg(F.sum((direct + F.coalesce("__up", F.lit(0))) / F.col("__n")).alias("__s"))
    scored = df.join(sums, keys, "left").withColumn("__s", F.coalesce("__s", F.lit(0.0)))
    if context is None:
        return scored.select(*keys, F.col("__s").alias("p"))
    said = property_texts(properties).select(F.col("id").alias("__b"), F.array_join("texts", " ").alias("__t"))
    scored = scored.join(said, F.col(base) == F.col("__b"), "left")
    return scored.select(*keys, F.when(F.col("__t").isNull(), 0.0).otherwise((F.col("__s") + F.coalesce(bigram_share(F.col(context), F.col("__t")), F.lit(0.0))) / 2).alias("p"))


def property_texts(properties: DataFrame) -> DataFrame:
    """id and the values of a concept's properties in order."""
    value = F.struct("prop_pos", property_value(F.col("property_type"), F.col("labels")).alias("v"))
    return properties.groupBy(F.col("concept_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: x["v"]).alias("texts"))


def describe(concepts: DataFrame, up: DataFrame, properties: DataFrame) -> DataFrame:
    """id, description: name, definitions, synonyms but the first, the chain of ancestors but the last, properties."""
    chain = labels(up, concepts, "ancestor", "__label").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bfs_pos", "__label"))), lambda x: x["__label"]).alias("__chain"))
    props = property_texts(properties).withColumnRenamed("texts", "__props")
    df = concepts.join(chain, "id", "left").join(props, "id", "left")
    more = F.when(F.size("__chain") > 2, F.concat(F.lit(", which is a type of "), F.array_join(F.slice("__chain", 2, F.greatest(F.size("__chain") - 2, F.lit(0))), ", which is a type of "))).otherwise("")
    # The words that join the parts.
    text = F.concat(
        F.lit("Medical concept: "), "label", F.lit(".\n"),
        F.when(F.size("definition") > 0, F.concat(F.lit("Definitions: "), F.array_join("definition", ". "), F.lit(".\n"))).otherwise(""),
        F.when(F.size("alt_label") > 1, F.concat(F.lit("Synonyms: "), F.array_join(F.slice("alt_label", 2, F.greatest(F.size("alt_label"), F.lit(1))), ", "), F.lit(".\n"))).otherwise(""),
        F.when(F.size("__chain") > 1, F.concat("label", F.lit(" is a "), F.get("__chain", F.lit(0)), more, F.lit(".\n"))).otherwise(""),
        F.when(F.size("__props") > 0, F.concat(F.lit("Properties: "), F.array_join("__props", ", "))).otherwise(""))
    return df.select("id", text.alias("description"))


def summary(concepts: DataFrame, edges: DataFrame, properties: DataFrame) -> DataFrame:
    """One row with the numbers of concepts, edges and properties."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(concepts, "n_concepts").join(count(edges, "n_edges")).join(count(properties, "n_properties"))
