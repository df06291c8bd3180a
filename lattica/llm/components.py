"""Connected components by contraction, with every round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """v, label for every vertex of ``edges`` (u, v): the label is the least vertex of its component.

    Each round points every vertex at its least neighbour, replaces vertices by where they point and
    drops loops and repeats, so that edges vanish within a few rounds. Null ends are ignored; no edges
    give no rows; loops give their vertex.
    """
    spark = edges.sparkSession
    both = edges.select("u", "v").filter("u is not null and v is not null")
    edges = shared.table(spark, both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    vertices = edges.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    labels = vertices.withColumn("label", F.col("v"))
    edges = edges.filter("u < v")
    while not edges.isEmpty():
        # A vertex points at its least neighbour below itself, or stays.
        point = shared.table(spark, edges.groupBy("v").agg(F.min("u").alias("to")), "pointers")
        for _ in range(2):  # shorten chains
            on = point.select(F.col("v").alias("to"), F.col("to").alias("next"))
            point = shared.table(spark, point.join(on, "to", "left").select("v", F.coalesce("next", "to").alias("to")), "pointers")
        of = lambda name: point.select(F.col("v").alias(name), F.col("to").alias(f"{name}_to"))
        labels = shared.table(spark, labels.join(of("label"), "label", "left").select("v", F.coalesce("label_to", "label").alias("label")), "labels")
        moved = edges.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_to", "u").alias("a"), F.coalesce("v_to", "v").alias("b"))
        edges = shared.table(spark, moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    return labels
