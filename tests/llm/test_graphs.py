"""Prefix tries, centroid clustering and substring removal against brute force, with their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import debruijn, kmeans, queries, runs, trie

CLASH = ["c", "d", "h1", "n", "part", "nth", "salt", "id", "v", "cluster", "was", "e", "r", "__file", "__row", "start", "size", "a.b", "first"]


def clashing(df):
    return df.select("*", *(F.lit(f"x{i}").alias(name) for i, name in enumerate(CLASH) if name not in df.columns))


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_centroid_clustering", "op13_substring_dedup"])
def test_oracle(name, spark, small, duck, compared):
    assert compared(queries.queries()[name](spark, small).toPandas()) == compared(duck.sql(queries.oracle_sql()[name]).df())


def test_products_and_powers():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, runs.P, 2000, dtype=np.uint64) for _ in range(2))
    a[:2], b[:2] = runs.P - 1, runs.P - 1
    assert runs.times(a, b).tolist() == [x * y % runs.P for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    e = rng.integers(0, 10**6, 50)
    assert runs.power(trie.BASES[0], e).tolist() == [pow(trie.BASES[0], int(x), runs.P) for x in e]


@pytest.mark.parametrize("modulus", [False, True])
def test_running_sums(spark, modulus):
    """A key with most rows lies in several partitions, and so does one that fills some of them whole."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("abz"), i, rng.randrange(runs.P) if modulus else rng.randrange(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, x long")
    got = {(r.k, r.o): r.x for r in runs.running(df, "k", [F.col("o").desc()], ["x"], modulus).collect()}
    want, total = {}, defaultdict(int)
    for k, o, x in sorted(rows, key=lambda r: -r[1]):
        total[k] = (total[k] + x) % runs.P if modulus else total[k] + x
        want[k, o] = total[k]
    assert got == want
    assert runs.running(df.limit(0), "k", [F.col("o")], ["x"]).count() == 0


def brute_trie(made):
    """Of {conversation: list of (role, text)}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(x[:-1] for x in members if x)
    leaves, saved = Counter(), Counter()
    for x, own in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += not children[x]
            saved[x[:d]] += (len(own) - 1) * (len(x[-1][1].encode()) if x else 0)
    return sorted(
        (min(own), len(x), min(members[x[:-1]]) if x else None, len(own), children[x], leaves[x], saved[x], hashlib.sha256(",".join(map(str, sorted(ends[x]))).encode()).hexdigest())
        for x, own in members.items())


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out[c].append((turn is not None, turn or 0, g, role, text))
    return {c: [(role, text) for *_, role, text in sorted(own)] for c, own in out.items()}


def odd_conversations():
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["", "é", "aa", None])) for c in range(-12, 40) for t in range(rng.randint(1, 12)) if c % 7]
    rows += [(c, t, "user", f"same {t}") for c in (100, 101, 103, 117, 1000) for t in range(60)]  # long and shared
    rows += [(50, t, "user", "again") for t in range(400)]
    rows += [(61, None, "user", "first"), (61, None, "bot", "first too"), (61, 3, "user", "tie"), (61, 3, "user", "tie"), (61, 3, "bot", "tie")]
    return [*rows, (None, 0, "user", "no conversation"), (71, 0, "user", "long " * 50_000)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_by_brute_force(spark):
    rows = odd_conversations()
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    own = ordered(rows)
    as_rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert as_rows(trie.nodes(trie.whole(trie.steps(df)))) == brute_trie(own)
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    c = F.col("c")
    assert any(not t for t in rebuilt.values())
    assert as_rows(trie.nodes(trie.graft(trie.steps(df), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8))) == brute_trie(rebuilt)


def test_trie_of_many_partial_tables(spark, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    rows = [r for r in odd_conversations() if r[0] is not None and r[0] < 60]
    text = [(f"c{r[0]:+05}", *r[1:]) for r in rows]
    got = trie.nodes(trie.whole(trie.steps(spark.createDataFrame(text, SCHEMA.replace("conv_id long", "conv_id string")))))
    assert sorted(tuple(r) for r in got.collect()) == brute_trie(ordered(text))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    for df in (none, none.limit(0)):
        got = trie.nodes(trie.whole(trie.steps(df)))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and got.count() == 0


def brute_clusters(rows, k, rounds, scale):
    import math

    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes().hex().upper())
    cs = [x for _, x in sorted(v, key=rank)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x: min(range(len(cs)), key=lambda j: (far(x, cs[j]), j))
    for _ in range(rounds):
        own = [nearest(x) for _, x in v]
        for j in range(len(cs)):
            part = [x for (_, x), o in zip(v, own, strict=True) if o == j]
            if part:
                cs[j] = [sum(c) // len(part) for c in zip(*part, strict=True)]
    own = [nearest(x) for _, x in v]
    dist = [far(x, cs[j]) for (_, x), j in zip(v, own, strict=True)]
    sums = Counter()
    for j, d in zip(own, dist, strict=True):
        sums[j] += d
    return Counter((i, j, d, sums[j], sum(dist), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for (i, _), j, d in zip(v, own, dist, strict=True))


def clustered(df, k, rounds, **more):
    rank = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    got, centroids = kmeans.cluster(df, k, rounds, rank, **more)
    out = kmeans.report(got, centroids).select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") if len(centroids) else got
    return Counter(tuple(r) for r in out.collect()), got


@pytest.mark.parametrize("several", [0, 1, 3, 9])
@pytest.mark.parametrize("spread", [3, 40, 2_000_000])
def test_clusters_by_brute_force(spark, several, spread):
    """Small whole numbers give many ties; large ones leave the exact range of floating point products."""
    rng = random.Random(spread)
    rows = [(i if i % 9 else None, [float(rng.randrange(-spread, spread) + 20 * (i % 4)) for _ in range(5)]) for i in range(160)] + [(7, [1.0] * 5)] * 3
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got, _ = clustered(df, 7, 6, width=5, scale=1, several=several)
    assert got == brute_clusters(rows, 7, 6, 1)


def test_bounds_spare_distances(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    _, got = clustered(df, 8, 10)
    n, spent = got.agg(F.count(F.lit(1)), F.sum("spent")).first()
    assert spent < 0.8 * n * 8 * 11


def test_vectors_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, None), (3, [0.5]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-0.1, 0.9]), (8, []), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    f32 = [(i, [float(np.float32(x)) for x in e]) for i, e in rows if i in (1, 7)]
    assert clustered(df, 8, 10, width=2)[0] == brute_clusters(f32, 8, 10, 1024)
    assert clustered(df.limit(0), 8, 10, width=2)[0] == Counter()
    assert clustered(df.filter("vec_id = 2"), 8, 10, width=2)[0] == Counter()
    with pytest.raises(Exception, match="after scaling"):
        clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 2, 2, width=2)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removed(rows, window):
    seen = Counter()
    for _, t in rows:
        ws = WORD.findall(t or "")
        seen.update(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    out = Counter()
    for i, t in rows:
        ws = WORD.findall(t or "")
        gone = {j for i in range(len(ws) - window + 1) if seen[tuple(ws[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out[i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def odd_texts():
    rng = random.Random(2)
    free = lambda n: " ".join(rng.choice("ab é A zz yy x".split(" ")) for _ in range(n))
    passage = [free(rng.randint(3, 30)) for _ in range(8)]
    rows = [(i, "\n ".join(rng.choice([*passage, free(9), free(2)]) for _ in range(rng.randint(0, 7)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a"), (None, passage[0]), (None, passage[0]), (7, rows[7][1])]
    return [*rows, (300, "x y " * 3000), (301, "lone " + " ".join(f"w{i}" for i in range(50))), (302, "other  " + "\t".join(f"w{i}" for i in range(50)) + " end")]


@pytest.mark.parametrize(("window", "seed", "bits"), [(5, 2, 64), (5, 2, 9), (5, 2, 2), (8, 3, 64), (8, 8, 64), (1, 1, 64), (35, 11, 64), (35, 11, 8)])
def test_substrings_by_brute_force(spark, window, seed, bits):
    """With few bits different windows have equal hashes everywhere, and results stay exact."""
    rows = odd_texts()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = debruijn.remove(df, window=window, seed=seed, with_text=True, bits=bits)
    assert Counter(tuple(r) for r in got.collect()) == brute_removed(rows, window)


def test_substrings_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in debruijn.remove(df).collect()] == [(1, 0, 0)]
    assert debruijn.remove(df.limit(0)).count() == 0


def test_paths_have_sources(spark):
    """One path for each passage; a path ends where its occurrences part."""
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(["p", *words, "q"])), (2, " ".join(["r", *words, "s"])), (3, " ".join(words[10:20]))]
    from lattica.llm import shared

    df = shared.located(spark.createDataFrame(rows, "doc_id long, text string"))
    found = debruijn.occurrences(df, debruijn.build(df.select("text"), 5, 2)).join(df, shared.PLACE).select("doc_id", "start", "size").collect()
    assert sorted(tuple(r) for r in found) == sorted([(1, 1, 10), (1, 11, 6), (1, 17, 10), (2, 1, 10), (2, 11, 6), (2, 17, 10), (3, 0, 6)])
