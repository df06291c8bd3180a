"""Ancestry by labels against walks over the edges."""

import random

import pytest

from lattica.operators import dcf as D
from lattica.operators import ontology as O
from lattica.operators import reach as R

EDGES = "child string, parent string, parent_pos int"


def graph(rng, n, cycles):
    edges = {(f"n{i}", f"n{p}"): k for i in range(1, n) if rng.random() < 0.9 for k, p in enumerate(rng.sample(range(i), min(i, rng.randint(1, 3))))}
    for _ in range(cycles):
        c, p = rng.choice(sorted(edges))
        edges[p, c] = 5
    return edges


def walks(edges):
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).add(p)
    up = {}
    for u in {x for e in edges for x in e}:
        seen, queue = set(), list(parents.get(u, ()))
        while queue:
            p = queue.pop()
            if p not in seen:
                seen.add(p)
                queue += parents.get(p, ())
        up[u] = seen
    return up


def frame(spark, edges):
    return spark.createDataFrame([(c, p, k) for (c, p), k in edges.items()], EDGES)


def told(labels, ids):
    rows = {r.id: r for r in labels.collect()}

    def above(u, v):
        if u not in rows or v not in rows:
            return False
        a, b = rows[u], rows[v]
        return b.lo < a.lo <= b.hi or any(b.lo <= h.lo <= b.hi for h in a.hops)

    assert len({r.lo for r in rows.values()}) == len(rows)
    return {u: {v for v in ids if above(u, v)} for u in ids}


@pytest.mark.parametrize("seed,cycles", [(1, 0), (2, 4)])
def test_labels_and_changes(spark, seed, cycles):
    rng = random.Random(seed)
    edges = graph(rng, 30, cycles)
    e = frame(spark, edges)
    labels = R.labels(e.unionByName(e).unionByName(spark.createDataFrame([(None, "n1", 0), ("n1", None, 0)], EDGES)))
    up = walks(edges)
    ids = set(up)
    assert told(labels, ids) == up
    for _ in range(2):
        gone = rng.sample(sorted(edges), 8)
        came = {(f"n{rng.randrange(16, 33)}", f"n{rng.randrange(16)}"): 7 for _ in range(6)} | {("m1", "m2"): 0, ("m2", gone[0][0]): 0}
        edges = {k: v for k, v in edges.items() if k not in gone} | came
        labels, e = R.change(labels, e, frame(spark, came), spark.createDataFrame(gone, "child string, parent string"))
        up = walks(edges)
        ids |= set(up)
        assert told(labels, ids) == {u: up.get(u, set()) for u in ids}
        assert {(r.child, r.parent) for r in e.collect()} == set(edges)
    few, _ = R.change(labels, e, frame(spark, {("k1", "k2"): 0, ("k2", "k3"): 0}), spark.createDataFrame([], "child string, parent string"), most=1)
    assert told(few, {"k1", "k2", "k3"}) == {"k1": {"k2", "k3"}, "k2": {"k3"}, "k3": set()}


@pytest.mark.parametrize("cycles", [0, 3])
def test_uses_of_labels(spark, cycles, compared):
    rng = random.Random(9)
    edges = frame(spark, graph(rng, 30, cycles))
    labels, up = R.labels(edges), O.closure(edges)
    rows = [(f"g{rng.randrange(3)}", rng.randrange(3), f"n{rng.randrange(34)}", rng.choice(["a", "b", None]), i) for i in range(120)]
    x = spark.createDataFrame(rows, "domain string, row_id int, concept_id string, value string, _pos long")
    same = lambda a, b: compared(a.toPandas()) == compared(b.toPandas())
    assert same(R.branch_filter(x, "concept_id", labels, ["n3", "n7", "none"]), O.branch_filter(x, "concept_id", up, ["n3", "n7", "none"]))
    assert same(R.ancestor_counts(x, labels, ["domain", "row_id"]), D.ancestor_counts(x, up, ["domain", "row_id"]).drop("first_pos"))
    pairs = spark.createDataFrame([(f"n{rng.randrange(32)}", f"n{rng.randrange(32)}") for _ in range(200)] + [(None, "n1")], "a string, b string")
    known = {(r.id, r.ancestor) for r in up.collect()}
    assert all(r.x == ((r.a, r.b) in known) for r in R.ancestry(pairs, labels, "a", "b", "x").collect())
    allowed = spark.createDataFrame([(f"n{i}",) for i in range(0, 30, 2)], "id string")
    if cycles:
        with pytest.raises(ValueError):
            R.prune(x, labels, allowed, edges)
    else:
        for blocks in (1, 64):
            assert same(R.prune(x, labels, allowed, edges, 2, blocks), O.prune(x, up, allowed, edges, 2))


def test_labels_of_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    labels = R.labels(none)
    x = spark.createDataFrame([("g", 1, "n1", None, 0)], "domain string, row_id int, concept_id string, value string, _pos long")
    assert labels.count() == 0 and R.branch_filter(x, "concept_id", labels, ["n1"]).count() == 0 and R.ancestor_counts(x, labels, ["domain"]).count() == 0
    made, _ = R.change(labels, none, spark.createDataFrame([("a", "b", 0)], EDGES), none.select("child", "parent"))
    assert told(made, {"a", "b"}) == {"a": {"b"}, "b": set()}
