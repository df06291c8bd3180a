"""The prefix trie of conversations as a table of its nodes.

A node is a sequence of turns that some conversation starts with. It is told by its depth and by two polynomial hashes of the
turns' digests, which are running sums along each conversation, so that no conversation has to fit in a task. Every partition of the
ordered turns combines its own nodes; these partial tables are merged by node in rounds, ``FAN`` of them at a time, and their lists of
conversations that end at a node in ascending runs, one for each partition. Members of a node whose least member is c are on the
path of c down to its end: sums over subtrees are rolled up along these paths from the ends, and then over the members of each node.

Edge cases: rows without a conversation's id are left out; a null role or text is empty; turns come in ascending order, null first, equal ones in
the order of their digests (a repeated turn is a turn of its own); texts of any length are only ever digested; no rows give no
nodes; extra columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs, shared

#: Partial tables that one round merges into one.
FAN = 32
#: Bases of the two polynomials.
BASES = (1_146_523_903_827_465_121, 907_334_512_873_562_377)
NODE = ["depth", "h1", "h2"]


def steps(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, d (1, 2, ... in the order of turns), the digest (t1, t2) of role and text, and the text's bytes (size)."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    given = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("turn"), F.octet_length(said).cast("long").alias("size"), digest.alias("digest")).filter("c is not null")
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    given = given.select("c", "turn", "size", part(1).alias("t1"), part(17).alias("t2"), F.lit(1).cast("long").alias("d"), F.monotonically_increasing_id().alias("nr"))  # nr: repeated rows can lie in several partitions
    return runs.running(given, "c", [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2"), F.col("nr")], ["d"]).drop("turn", "part", "nr")


def graft(numbered: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Conversations rebuilt: the first ``heads`` turns (at most ``most``) of the conversation ``base``, then the own turns after as many.

    Both are expressions of c. Absent bases have no turns. c, d, t1, t2, size and last, with a row of d = 0 for each conversation.
    """
    spark = numbered.sparkSession
    lengths = numbered.groupBy("c").agg(F.max("d").alias("n"))
    about = lengths.select("c", "n", base.alias("base"), heads.cast("long").alias("heads"))
    about = about.join(lengths.select(F.col("c").alias("base"), F.col("n").alias("of_base")), "base", "left").withColumn("taken", F.least("heads", F.coalesce("of_base", F.lit(0))))
    about = shared.table(spark, about.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))), "grafts")
    own = numbered.join(about, "c").filter("d > heads").withColumn("d", F.col("taken") + F.col("d") - F.col("heads"))
    first = numbered.filter(F.col("d") <= most).withColumnRenamed("c", "base").join(about, "base").filter("d <= heads")
    none = F.lit(0).cast("long")
    bare = about.select("c", none.alias("d"), none.alias("t1"), none.alias("t2"), none.alias("size"), "total")
    out = own.select(bare.columns).unionByName(first.select(bare.columns)).unionByName(bare)
    return out.select("c", "d", "t1", "t2", "size", (F.col("d") == F.col("total")).alias("last"))


def whole(numbered: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``graft``."""
    return graft(numbered, F.col("c"), F.lit(0), 0)


def _term(base: int):
    @F.pandas_udf("long")
    def term(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(runs.times(t.to_numpy().astype(np.uint64), runs.power(base, d.to_numpy())).astype(np.int64))

    return term


def paths(given: DataFrame) -> DataFrame:
    """c, depth, h1, h2, up1, up2 (the node above), size, last and part for each place in each conversation."""
    terms = [_term(b)(F.col(f"t{k}"), F.col("d")) for k, b in enumerate(BASES, 1)]
    given = given.select("c", F.col("d").alias("depth"), "size", "last", *(t.alias(f"h{k}") for k, t in enumerate(terms, 1)), *(t.alias(f"own{k}") for k, t in enumerate(terms, 1)))
    at = runs.running(given, "c", [F.col("depth")], ["h1", "h2"], modulus=True)
    up = [F.pmod(F.col(f"h{k}") - F.col(f"own{k}"), F.lit(runs.P)).alias(f"up{k}") for k in (1, 2)]
    return at.select("c", *NODE, *up, "size", "last", "part")


def merged(partials: DataFrame, **sums: Column) -> DataFrame:
    """One row for each node with ``sums`` (aggregates that combine by themselves, by name), from rows with ``part``.

    Rows are combined where they are, then by node in rounds: each merges up to ``FAN`` partial tables, so that no node, however
    frequent, brings more than ``FAN`` rows to a task.
    """
    parts = int(partials.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        partials = partials.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*NODE, "part").agg(*(c.alias(name) for name, c in sums.items()))
        parts = -(-parts // FAN)
        if parts <= 1:
            return partials.drop("part")


def _ends(at: DataFrame) -> DataFrame:
    """The digest of each node's ids of conversations that end there, in ascending order."""
    lists = at.filter("last").groupBy(*NODE, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == key:
                    state.update(b"," + ids.encode())
                else:
                    out += [(*key, state.hexdigest())] if key else []
                    key, state = own, hashlib.sha256(ids.encode())
            if out:
                yield made(out)
        if key:
            yield made([(*key, state.hexdigest())])

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*NODE, "ends_sha256"])

    runs_of = lists.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return runs_of.mapInArrow(run, "depth long, h1 long, h2 long, ends_sha256 string")


def nodes(given: DataFrame) -> DataFrame:
    """The trie of conversations (c, d, t1, t2, size, last as of ``graft``), one row for each node.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed over the subtree: members
    but one, times the bytes of the last text) and ends_sha256.
    """
    spark = given.sparkSession
    at = paths(given)
    one = F.lit(1).cast("long")
    of_node = {"c": F.min("c"), "n": F.sum("n"), "size": F.min("size"), "up1": F.min("up1"), "up2": F.min("up2")}
    stored = shared.table(spark, merged(at.select("c", *NODE, "up1", "up2", "size", "part", one.alias("n")), **of_node), "nodes")
    below = stored.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("h1"), F.col("up2").alias("h2")).agg(F.count(one).alias("n_children"))
    found = stored.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # Of the nodes whose least member is c, each with all below it on the path of c.
    chain = found.select("c", *NODE, "up1", "up2", "n", "n_children", ((F.col("n") - 1) * F.col("size")).alias("saved"), F.when(F.col("n_children") == 0, one).otherwise(F.lit(0)).alias("leaves"))
    chain = runs.running(chain, "c", [F.col("depth").desc()], ["saved", "leaves"]).drop("part")
    total = chain.groupBy("c").agg(F.max("saved").alias("saved"), F.max("leaves").alias("leaves"))
    # What the paths of all members bring to a node.
    brought = at.select("c", *NODE, "part").join(total.filter("saved > 0 or leaves > 0"), "c")
    brought = merged(brought.select(*NODE, "part", "saved", "leaves"), saved=F.sum("saved"), leaves=F.sum("leaves"))
    own = total.select("c", F.col("saved").alias("of_c"))
    rolled = chain.drop("leaves").withColumnRenamed("saved", "tail").join(own, "c").join(brought, NODE)
    above = stored.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("up1"), F.col("h2").alias("up2"), F.col("c").alias("parent"))
    deep = rolled.filter("depth > 1").join(above.filter("depth > 1"), ["depth", "up1", "up2"])
    top = stored.filter("depth = 0").select("c").first()
    shallow = rolled.filter("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top.c if top else None).cast(rolled.schema["c"].dataType)))
    out = deep.unionByName(shallow).join(_ends(at), NODE, "left")
    return out.select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("tail") + F.col("saved") - F.col("of_c")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
