"""Ancestry by labels: who lies above whom, told from a pair of rows, without a table of all ancestors.

A spanning forest of the ontology is numbered so that what lies below a node in it has the numbers ``lo`` to ``hi``. Edges outside
the forest leave hops: of every node, the least set of nodes that it gets to by such an edge and from which only the forest leads on.
v is above u if v's numbers hold those of u, or of one of u's hops. Labels are rows of id, lo, hi, depth (in the forest), above
(the forest parent's lo; null at a root) and hops (array of lo and hi, ascending); their size is that of the edges outside the forest,
carried down, where a closure holds every ancestor of every node.

Edges are (child, parent, parent_pos). Rows with a null end count for nothing, repeated ones once. Nodes that no root is above (on or
below a cycle only) are roots of their own, so that cycles are right too: a node is its own ancestor only on one.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..sources import with_pos
from .ontology import closure, prunable, spread_join

_HOPS = "array<struct<lo:bigint,hi:bigint>>"
_RANGES = "array<struct<lo:bigint,hi:bigint,base:bigint,depth:int>>"


def _once(edges: DataFrame) -> DataFrame:
    return edges.filter("child is not null and parent is not null").groupBy("child", "parent").agg(F.min(F.col("parent_pos").cast("int")).alias("parent_pos"))


def _forest(edges: DataFrame) -> DataFrame:
    """id, depth and path (from the root) of every node; a node hangs on the first parent of those nearest to a root."""
    spark = edges.sparkSession
    nodes = storage.table(spark, edges.select(F.col("child").alias("id")).union(edges.select("parent")).distinct(), "nodes")
    roots = nodes.join(edges.select(F.col("child").alias("id")), "id", "left_anti")
    level = storage.table(spark, roots.select("id", F.array("id").alias("path")), "forest")
    known, left = level, edges
    while not level.isEmpty():
        # Only edges whose child has no place yet go on.
        left = storage.table(spark, left.join(level.select(F.col("id").alias("child")), "child", "left_anti"), "left")
        best = left.join(level.select(F.col("id").alias("parent"), "path"), "parent").groupBy("child").agg(F.min(F.struct("parent_pos", "parent", "path")).alias("b"))
        level = storage.table(spark, best.select(F.col("child").alias("id"), F.concat("b.path", F.array("child")).alias("path")), "forest")
        known = known.unionByName(level)
    alone = nodes.join(known.select("id"), "id", "left_anti").select("id", F.array("id").alias("path"))
    return storage.table(spark, known.unionByName(alone), "forest")


def _below(lo: Column, hops: Column, above_lo: Column, above_hi: Column) -> Column:
    return ((lo > above_lo) & (lo <= above_hi)) | F.exists(hops, lambda h: (h["lo"] >= above_lo) & (h["lo"] <= above_hi))


def _with_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels with the hops of the rows whose ``hops`` are null; those of the others are known."""
    spark = nodes.sparkSession
    place = nodes.select(F.col("id").alias("child"), F.col("lo").alias("c"), "above", F.col("hops").isNull().alias("__open"))
    ends = nodes.select(F.col("id").alias("parent"), F.col("lo").alias("p"), F.col("hi").alias("p_hi"), F.col("hops").alias("p_hops"))
    step = storage.table(spark, edges.join(place.filter("__open"), "child").join(ends, "parent").select("c", "p", "p_hi", "p_hops", F.coalesce(F.col("above") != F.col("p"), F.lit(True)).alias("extra")), "steps")
    #: A hop above its node in the forest tells nothing new.
    told = (F.col("h") < F.col("n")) & (F.col("n") <= F.col("h_hi"))
    own = step.filter("extra").select(F.col("c").alias("n"), F.col("p").alias("h"), F.col("p_hi").alias("h_hi"))
    lent = step.filter("p_hops is not null").select(F.col("c").alias("n"), F.explode("p_hops").alias("x")).select("n", F.col("x.lo").alias("h"), F.col("x.hi").alias("h_hi"))
    level = storage.table(spark, own.unionByName(lent).filter(~told).distinct(), "hops")
    inner = step.filter("p_hops is null").select("c", "p")
    known = level
    while not level.isEmpty():
        reached = level.join(inner, F.col("n") == F.col("p")).select(F.col("c").alias("n"), "h", "h_hi").filter(~told).distinct()
        level = storage.table(spark, reached.join(known.select("n", "h"), ["n", "h"], "left_anti"), "hops")
        known = known.unionByName(level)
    sets = known.groupBy("n").agg(F.array_sort(F.collect_set(F.struct(F.col("h").alias("lo"), F.col("h_hi").alias("hi")))).alias("s"))
    # Numbers nest, so a hop with another one below it has the next one below it.
    least = sets.select("n", F.filter("s", lambda x, i: F.coalesce(F.get("s", i + 1)["lo"] > x["hi"], F.lit(True))).alias("__made"))
    return nodes.join(least, nodes["lo"] == least["n"], "left").select("id", "lo", "hi", "depth", "above", F.coalesce("hops", "__made", F.array().cast(_HOPS)).alias("hops"))


def labels(edges: DataFrame) -> DataFrame:
    """Labels of every node of the edges. Rounds: as many as the longest way up has steps."""
    spark, edges = edges.sparkSession, storage.table(edges.sparkSession, _once(edges), "edges")
    placed = storage.table(spark, with_pos(_forest(edges), ["path"]), "places")
    last = placed.select(F.explode("path").alias("id"), "_pos").groupBy("id").agg(F.max("_pos").alias("hi"))
    over = placed.select(F.col("id").alias("__up"), F.col("_pos").alias("above"))
    nodes = placed.join(last, "id").withColumn("__parent", F.try_element_at("path", F.lit(-2))).join(over, F.col("__parent") == F.col("__up"), "left")
    nodes = nodes.select("id", F.col("_pos").alias("lo"), "hi", (F.size("path") - 1).alias("depth"), "above", F.lit(None).cast(_HOPS).alias("hops"))
    return storage.table(spark, _with_hops(storage.table(spark, nodes, "places"), edges), "labels")


def _ranges(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The outermost of nested ranges."""
    out = []
    for lo, hi in sorted(set(found), key=lambda r: (r[0], -r[1])):
        if not out or lo > out[-1][1]:
            out.append((lo, hi))
    return out


def _innermost(cuts: list[tuple[int, int, int]], top: int) -> list[dict]:
    """Ranges without overlaps that say to which of the nested cuts (lo, hi, depth) numbers belong, and where the cut's numbers begin anew."""
    out, stack, at = [], [], None

    def put(to):
        if stack and at <= to:
            out.append({"lo": at, "hi": to, **stack[-1][1]})

    for lo, hi, depth in sorted(set(cuts)):
        while stack and stack[-1][0] < lo:
            put(stack[-1][0])
            at = stack.pop()[0] + 1
        put(lo - 1)
        stack.append((hi, {"base": top - lo, "depth": depth}))
        top, at = top + hi - lo + 1, lo
    while stack:
        put(stack[-1][0])
        at = stack.pop()[0] + 1
    return out


def _within(ranges: list[tuple[int, int]], lo: Column, hops: Column) -> Column:
    """At or below one of some nodes, which are told by their numbers."""
    table = F.from_json(F.lit(json.dumps([{"lo": a, "hi": b} for a, b in ranges])), _HOPS)
    return F.exists(table, lambda r: ((lo >= r["lo"]) & (lo <= r["hi"])) | F.exists(hops, lambda h: (h["lo"] >= r["lo"]) & (h["lo"] <= r["hi"])))


def change(known: DataFrame, edges: DataFrame, inserted: DataFrame, deleted: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Labels and edges after some edges (child, parent) went and others (child, parent, parent_pos) came; an edge of both stays.

    Numbers move only where an edge of the forest goes: what hung on it becomes a tree of its own behind all others, by one addition a
    row. Hops are found again for what lies at or below a changed child; all other rows stay as they are. With more than
    ``most`` changed edges the labels are made anew, with the same answers.
    """
    spark = known.sparkSession
    before = _once(edges)
    kept = before.join(deleted.select("child", "parent").distinct(), ["child", "parent"], "left_anti")
    after = storage.table(spark, _once(kept.unionByName(inserted.select("child", "parent", F.col("parent_pos").cast("int").alias("parent_pos")))), "edges")
    pair = ["child", "parent"]
    went, came = before.join(after, pair, "left_anti").select(*pair, F.lit(True).alias("gone")), after.join(before, pair, "left_anti").select(*pair, F.lit(False).alias("gone"))
    changed = storage.table(spark, went.unionByName(came), "changes")
    if changed.limit(most + 1).count() > most:
        return labels(after), after
    new = changed.filter("not gone").select(F.col("child").alias("id")).union(changed.filter("not gone").select("parent")).distinct().join(known.select("id"), "id", "left_anti")
    new = storage.table(spark, with_pos(new, ["id"]), "new")
    top = known.agg(F.max("hi")).first()[0]
    first = -1 if top is None else top
    c = known.select(F.col("id").alias("child"), "lo", "hi", "depth", "above")
    p = known.select(F.col("id").alias("parent"), F.col("lo").alias("p"))
    rows = changed.join(c, "child").join(p, "parent", "left").select("lo", "hi", "depth", (F.col("gone") & F.coalesce(F.col("above") == F.col("p"), F.lit(False))).alias("cut")).collect()  # at most ``most``
    cuts = [(r.lo, r.hi, r.depth) for r in rows if r.cut]
    moves = F.from_json(F.lit(json.dumps(_innermost(cuts, first + 1 + new.count()))), _RANGES)
    open_ = _within(_ranges([(r.lo, r.hi) for r in rows]), F.col("lo"), F.col("hops"))
    # A column of its own: inside a lambda, Spark takes a name for the new column of the same select.
    moved = known.withColumn("__open", open_).withColumn("__m", F.get(F.filter(moves, lambda r: (r["lo"] <= F.col("lo")) & (F.col("lo") <= r["hi"])), F.lit(0)))
    shift, rise, root = F.coalesce("__m.base", F.lit(0)), F.coalesce("__m.depth", F.lit(0)), F.col("lo").isin([lo for lo, _, _ in cuts])
    old = moved.select("id", (F.col("lo") + shift).alias("lo"), (F.col("hi") + shift).alias("hi"), (F.col("depth") - rise).cast("int").alias("depth"),
                       F.when(~root, F.col("above") + shift).alias("above"), F.when(~F.col("__open"), F.col("hops")).alias("hops"))
    at = F.col("_pos") + F.lit(first + 1)
    fresh = new.select("id", at.alias("lo"), at.alias("hi"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("above"), F.lit(None).cast(_HOPS).alias("hops"))
    return storage.table(spark, _with_hops(storage.table(spark, old.unionByName(fresh), "places"), after), "labels"), after


def ancestry(df: DataFrame, known: DataFrame, low: str, high: str, into: str) -> DataFrame:
    """Adds whether the concept of one column lies below that of another; false for unknown and null ones."""
    a = known.select(F.col("id").alias("__a"), F.col("lo").alias("__alo"), F.col("hops").alias("__ahops"))
    b = known.select(F.col("id").alias("__b"), F.col("lo").alias("__blo"), F.col("hi").alias("__bhi"))
    joined = df.join(a, df[low] == F.col("__a"), "left").join(b, df[high] == F.col("__b"), "left")
    return joined.withColumn(into, F.coalesce(_below(F.col("__alo"), F.col("__ahops"), F.col("__blo"), F.col("__bhi")), F.lit(False))).drop("__a", "__alo", "__ahops", "__b", "__blo", "__bhi")


def branch_filter(df: DataFrame, key: str, known: DataFrame, bases: list[str]) -> DataFrame:
    """Without the bases, what lies below them, and concepts that have no ancestor."""
    found = [(r.lo, r.hi) for r in known.filter(F.col("id").isin(bases)).select("lo", "hi").collect()]  # one for each base
    good = known.filter((F.col("above").isNotNull() | (F.size("hops") > 0)) & ~_within(_ranges(found), F.col("lo"), F.col("hops"))).select(F.col("id").alias("__id"))
    return df.filter(~F.col(key).isin(bases)).join(good, F.col(key) == F.col("__id"), "left_semi")


def prune(extractions: DataFrame, known: DataFrame, allowed: DataFrame, edges: DataFrame, alpha: int = 2, blocks: int = 64) -> DataFrame:
    """Smart pruning, as ``ontology.prune`` does it: the first ``alpha`` ancestors come from a walk of ``alpha`` levels, and an ancestor goes
    if the next number that a concept with children brings into its row and value lies within its own. The same is asked of all kept concepts
    at once first: rows count only for those that are above another kept one with children, and have children themselves.

    Numbers of one row and value are told apart in ``blocks``, so that no task has all of a hot one. An ontology with a cycle is an error.
    """
    if not known.filter(F.exists("hops", lambda h: (h["lo"] >= F.col("lo")) & (h["lo"] <= F.col("hi")))).isEmpty():
        raise ValueError("the ontology has a cycle")
    spark, top = known.sparkSession, known.agg(F.max("hi")).first()[0] or 0
    ids = storage.table(spark, prunable(closure(edges, alpha), allowed, alpha), "kept-ids")
    kept = spread_join(extractions, "concept_id", ids, F.col("row_id"))
    inner = edges.select(F.col("parent").alias("id")).distinct()
    placed = storage.table(spark, ids.join(inner, "id", "left_semi").join(known.select("id", "lo", "hi", "hops"), "id"), "kept-parents")
    high = _covering(placed.select(F.lit(0).alias("__r"), F.lit(0).alias("__v"), F.col("id").alias("__c"), "lo", "hi", "hops", F.lit(True).alias("__asked")), top, blocks)
    placed = storage.table(spark, placed.join(high.select(F.col("__c").alias("id"), F.lit(True).alias("__asked")), "id", "left"), "kept-parents")
    if placed.filter("__asked").isEmpty():  # no kept concept is above another one with children
        return kept
    named = spread_join(kept.filter("row_id is not null"), "concept_id", placed, F.col("row_id"), "inner")
    gone = _covering(named.select(F.col("row_id").alias("__r"), F.col("value").alias("__v"), F.col("concept_id").alias("__c"), "lo", "hi", "hops", "__asked").distinct(), top, blocks)
    return kept.join(gone, (F.col("row_id") == F.col("__r")) & F.col("value").eqNullSafe(F.col("__v")) & (F.col("concept_id") == F.col("__c")), "left_anti")


def _covering(placed: DataFrame, top: int, blocks: int) -> DataFrame:
    """__r, __v and __c of the concepts with ``__asked`` that are above another one of the same __r and __v. placed: these and lo, hi and hops; numbers go up to ``top``."""
    # Twice the number for the concept itself, one more for a hop: an ancestor looks from one more than its own on, and so not at itself.
    points = placed.select("__r", "__v", F.explode(F.concat(F.array(2 * F.col("lo")), F.transform("hops", lambda h: 2 * h["lo"] + 1))).alias("__at")).distinct()
    asked = placed.filter("__asked").select("__r", "__v", "__c", (2 * F.col("lo") + 1).alias("__at"), (2 * F.col("hi") + 1).alias("__to"))
    rows = points.select("__r", "__v", F.lit(None).cast(placed.schema["__c"].dataType).alias("__c"), "__at", F.lit(None).cast("long").alias("__to"), F.col("__at").alias("__p")).unionByName(asked.withColumn("__p", F.lit(None).cast("long")))
    rows = rows.withColumn("__block", F.floor(F.col("__at") / F.lit((2 * top + 2) // blocks + 1)))
    near = Window.partitionBy("__r", "__v", "__block").orderBy(F.desc("__at"), F.col("__p").isNull())
    here = rows.withColumn("__next", F.last("__p", True).over(near.rowsBetween(Window.unboundedPreceding, 0)))
    firsts = rows.groupBy("__r", "__v", "__block").agg(F.min("__p").alias("__first"))
    later = firsts.withColumn("__later", F.last("__first", True).over(Window.partitionBy("__r", "__v").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)))
    later = later.select(F.col("__r").alias("__lr"), F.col("__v").alias("__lv"), F.col("__block").alias("__lb"), "__later")
    met = here.filter("__to is not null").join(later, (F.col("__r") == F.col("__lr")) & F.col("__v").eqNullSafe(F.col("__lv")) & (F.col("__block") == F.col("__lb")), "left")
    return met.filter(F.coalesce("__next", "__later") <= F.col("__to")).select("__r", "__v", "__c")


def _meetings(pairs: DataFrame, forest: DataFrame) -> DataFrame:
    """a, b and m of pairs of numbers, a < b: the lowest node of the forest that has both; pairs in two trees have none."""
    spark = pairs.sparkSession
    at, done = storage.table(spark, pairs.withColumn("m", F.col("a")), "meetings"), []
    while not at.isEmpty():
        seen = storage.table(spark, at.join(forest, F.col("m") == F.col("lo")).select("a", "b", "m", "above", (F.col("hi") >= F.col("b")).alias("met")), "meetings")
        done.append(seen.filter("met").select("a", "b", "m"))
        at = seen.filter("not met and above is not null").select("a", "b", F.col("above").alias("m"))
    whole = at.select("a", "b", "m").limit(0)
    for more in done:
        whole = whole.unionByName(more)
    return whole


def ancestor_counts(mentions: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """by, concept_id, freq: how often concepts below a concept are mentioned, as ``dcf.ancestor_counts`` counts them.

    What lies above a concept are the ways up from its forest parent and its hops. Counts are put at the beginnings of these ways and taken
    off where two neighbouring ones meet; then they move up the forest, a level a round, and are summed at each node.
    So the rows that move are those of the result, not one for each mentioned concept and ancestor.
    """
    spark = known.sparkSession
    counted = mentions.groupBy(*by, "concept_id").agg(F.count(F.lit(1)).alias("__n"))
    own = F.when(F.col("above").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("above"))
    ways = counted.join(known, F.col("concept_id") == F.col("id")).select(*by, "__n", F.array_sort(F.array_distinct(F.concat(own, F.transform("hops", lambda h: h["lo"])))).alias("__w"))
    ways = storage.table(spark, ways.groupBy(*by, "__w").agg(F.sum("__n").alias("__n")), "ways")
    starts = ways.select(*by, F.explode("__w").alias("__at"), "__n")
    pairs = ways.filter(F.size("__w") > 1).select(*by, "__n", F.explode(F.arrays_zip(F.slice("__w", F.lit(1), F.size("__w") - 1).alias("a"), F.slice("__w", F.lit(2), F.size("__w") - 1).alias("b"))).alias("x")).select(*by, "__n", "x.a", "x.b")
    forest = known.select("lo", "hi", "above")
    meet = _meetings(pairs.select("a", "b").distinct(), forest)
    off = pairs.join(meet, ["a", "b"]).select(*by, F.col("m").alias("__at"), (-F.col("__n")).alias("__n"))
    place = known.select(F.col("lo").alias("__lo"), F.col("depth").alias("__depth"), F.col("above").alias("__above"))
    moving = starts.unionByName(off).groupBy(*by, "__at").agg(F.sum("__n").alias("__n")).join(place, F.col("__at") == F.col("__lo")).drop("__lo")
    moving = storage.table(spark, moving.sortWithinPartitions("__depth"), "moving")  # a round skips the groups of rows of other levels
    carried, done = moving.limit(0), []
    for depth in range(moving.agg(F.max("__depth")).first()[0] or 0, -1, -1):
        level = moving.filter(F.col("__depth") == depth).unionByName(carried).groupBy(*by, "__at", "__above").agg(F.sum("__n").alias("__n"))
        level = storage.table(spark, level, "counts")
        done.append(level.select(*by, "__at", "__n"))
        up = level.filter("__above is not null").groupBy(*by, F.col("__above").alias("__at")).agg(F.sum("__n").alias("__n"))
        carried = up.join(place, F.col("__at") == F.col("__lo")).select(moving.columns)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.join(known.select(F.col("id").alias("concept_id"), F.col("lo").alias("__lo")), F.col("__at") == F.col("__lo")).select(*by, "concept_id", F.col("__n").cast("double").alias("freq"))
