"""The ten operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import bytescan as bs
from lattica.llm import decontam, jaccard, langid, license, lm, packing, pieces, quality, queries, rollup, rules, shared, store
from lattica.llm.tokenize import encoder

TOKENIZER = queries.tokenizer_path()
LONG = "ab cd. " * 60_000
EDGE = [(1, None), (2, ""), (3, "   \n"), (4, "!!! 123 —"), (5, "a"), (6, "Zwei drei Vier.\nfünf"), (6, "Zwei drei Vier.\nfünf"), (7, LONG), (None, "no id here at all")]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return docs.select("doc_id", "text", "lang").toPandas().sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string")
    return df.withColumns({"lang": F.when(F.col("doc_id") > 4, "x"), "score": F.lit("s"), "n_words": F.lit(1), "bucket": F.lit("b"), "id": F.lit("i"), "v": F.lit(0), "quality": F.lit("q"), "source": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    import re

    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_words_of_bytes():
    rng = random.Random(5)
    made = ["".join(rng.choice("aB é\n\t.中9 ") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    for table, pattern in ((bs.SPACED, r"[^\x20\x09-\x0D]+"), (bs.ALNUM, ALNUM)):
        for block in bs.blocks(pa.array([None, *made])):
            h, first = bs.words(block, table)
            for r in range(block.rows):
                text = [None, *made][block.first + r]
                assert h[first[r] : first[r + 1]].tolist() == [bs.word_hash(w) for w in words(text, pattern)]


@pytest.fixture(scope="module")
def kneser(spark):
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a b", "B c c", None, "d a b"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, lm.train(df, file_bytes=8)


def test_language_model_sums_to_one(kneser):
    _, model = kneser
    for left in ("a", "b", "c", "unseen"):
        total = 0.0
        for w in ["a", "b", "c", "d", "other"]:
            got = model.score(next(bs.blocks(pa.array([f"{left} {w}", left]))))["score"]
            single = {}
            single["pair"], single["left"] = got
            # p(w | left) * p(end | w) against p(end | w), with scores of texts that share the start
            end = model.score(next(bs.blocks(pa.array([w]))))["score"][0] - _start(model, w)
            total += 10 ** (single["pair"] - _start(model, left) - end)
        total += 10 ** (model.score(next(bs.blocks(pa.array([left]))))["score"][0] - _start(model, left))
        assert total == pytest.approx(1.0, abs=1e-6)


def _start(model, w):
    """log10 p(w | start)."""
    block = next(bs.blocks(pa.array([w])))
    before, here, _ = model.words.sequence(block)
    c = model.pair_counts(before[:1] << np.uint64(32) | here[:1])[0]
    known = here[:1][here[:1] < np.uint64(lm.START)]
    p_word = model.word_probability(np.pad(model.words.gather("followed", np.uint32, known).astype(float), (0, 1 - len(known))))[0]
    return math.log10(max(c - model.pair_discounts[int(min(c, 3))], 0) / model.start_total + model.start_weight * p_word)


def test_language_model_by_brute_force(kneser):
    """Interpolated modified Kneser-Ney with dictionaries, token by token."""
    df, model = kneser
    rows = [[*words(t), None] for t in df.toPandas().text]
    pair = Counter((a, b) for ws in rows for a, b in zip(["<s>", *ws[:-1]], ws, strict=True))
    left = defaultdict(list)
    for (a, _), c in pair.items():
        left[a].append(c)
    before = Counter(b for _, b in pair)
    v = len({w for ws in rows for w in ws})

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0.0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), k) for k in (1, 2, 3))]

    d, e = discounts(pair.values()), discounts(before.values())
    spare = sum(e[min(c, 3)] for c in before.values()) / len(pair)

    def p(a, b):
        low = max(before[b] - e[min(before[b], 3)], 0) / len(pair) + spare / (v + 1)
        if not left[a]:
            return low
        return max(pair[a, b] - d[min(pair[a, b], 3)], 0) / sum(left[a]) + sum(d[min(c, 3)] for c in left[a]) / sum(left[a]) * low

    for text in ["a b a b c", "b", "", "never seen a", "d a b c c never", None]:
        ws = [*words(text), None]
        want = sum(math.log10(p(a, b)) for a, b in zip(["<s>", *ws[:-1]], ws, strict=True))
        assert model.score(next(bs.blocks(pa.array([text], pa.string()))))["score"][0] == pytest.approx(want, abs=1e-6)


def test_language_model_counts_of_any_size(spark, monkeypatch):
    """Counts beyond those that fit their array are kept in full; here the array is taken to hold up to 4."""
    monkeypatch.setattr(lm, "MANY", 4)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b c", "b c"] * 4)], "doc_id long, text string")
    counts = sorted(lm.train(df, file_bytes=8).pair_counts(np.unique(np.concatenate([(x << np.uint64(32) | y) for x, y, _ in [lm.train(df, file_bytes=8).words.sequence(b) for b in bs.blocks(pa.array(["a b", "a b c", "b c"]))]]))).tolist())
    assert counts == [4.0, 4.0, 8.0, 8.0, 8.0, 8.0]


def test_language_model_base(spark, docs, texts, small):
    got = queries.op1_lm_scoring(spark, small).toPandas().set_index("doc_id")
    fold = [zlib.crc32(str(i).encode()) % 5 for i in texts.doc_id]
    tokens = [[*words(t), None] for t in texts.text]
    counts = Counter(w for f, ws in zip(fold, tokens, strict=True) if f != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, f, ws in zip(texts.doc_id, fold, tokens, strict=True):
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (f == 1, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and np.isfinite(got.score).all()


def test_language_model_edges(edge, empty):
    got = lm.score(edge, lm.train(edge), ["doc_id"]).toPandas()
    assert len(got) == 9 and got[got.doc_id == 2].n_tokens.tolist() == [1] and np.isfinite(got.score).all()
    none = lm.train(empty)
    assert none.words.tokens == 0 and lm.score(empty, none, ["doc_id"]).count() == 0
    assert lm.score(edge, none, ["doc_id"]).agg(F.sum("n_known")).first()[0] == 0


def test_quality(spark, small):
    d = small.replace("0.001", "0.01")
    got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.predicted == got.quality).mean() > 0.9


def plain_features(text):
    """The features by their names, character by character and word by word."""
    raw = (text or "").encode()
    ws = words(text)
    n = max(len(ws), 1)
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, None, "!", ".,;:?", "\n", "'\"-()"]
    counts = [sum(chr(b) in k for b in raw) if k else 0 for k in kinds]
    counts[2] = sum(b >= 0x80 for b in raw)
    counts[3] = sum(b < 0x80 and not chr(b).isalnum() and chr(b) not in " \t\n\v\f\r.,;:!?'\"-()" for b in raw)
    pairs = [ws[0:1]] * bool(ws) + [[a, b] for a, b in zip(ws, ws[1:])]
    rest = [math.log1p(len(ws)), len(raw) / n, max(len(set(ws)), 1) / n, len(set(map(tuple, pairs))) / n, sum(a == b for a, b in zip(ws, ws[1:])) / n]
    return [math.sqrt(x) for x in [*(c / n for c in counts), *rest]]


def test_quality_by_brute_force(spark, docs, texts):
    """Features against plain loops, and the network in Spark's expressions against matrix products."""
    small = docs.filter(F.coalesce(F.length("text"), F.lit(0)) < 3000)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\n"), (-4, "Ä!ß… x x X \u00a0~{}\x7f"), (-5, "one"), (-6, "a a a b a a")], "doc_id long, text string")
    described = quality.features(small.select("doc_id", "text").unionByName(odd), ["doc_id"])
    text = {r.doc_id: r.text for r in small.select("doc_id", "text").unionByName(odd).collect()}
    got = described.collect()
    assert len(got) == len(text)
    for r in got:
        assert r.x == pytest.approx(plain_features(text[r.doc_id]), rel=1e-5, abs=1e-6), text[r.doc_id]
    rng = np.random.default_rng(4)
    k = len(quality.NAMES)
    for ready in (True, False):
        model = quality.Model(rng.normal(0, 1, k), rng.uniform(0.1, 2, k), [rng.normal(0, 1, (k, 12)), rng.normal(0, 1, 12), rng.normal(0, 1, 12), rng.normal(0, 1, 1)], 0.5, ready)
        scored = {r.doc_id: (r.score, r.predicted) for r in quality.predict(described, model, ["doc_id"]).collect()}
        want = model.score(np.array([r.x for r in got], float))
        for r, w in zip(got, want, strict=True):
            assert scored[r.doc_id][0] == pytest.approx(w, abs=1e-9) and scored[r.doc_id][1] == int(scored[r.doc_id][0] >= 0.5)


def test_quality_prior_and_edges(spark, edge, empty):
    rng = np.random.default_rng(1)
    p, u = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    assert quality.class_prior(p, u) == pytest.approx(0.6, abs=0.06)
    described = quality.features(edge, ["doc_id"])
    labels = spark.createDataFrame([(1, None), (5, 1), (5, 0), (99, 1)], "doc_id long, quality int")
    got = quality.predict(described, quality.train(described, labels), ["doc_id"]).toPandas()
    assert len(got) == 9 and got.score.between(0, 1).all()
    unsure = quality.train(described, labels.limit(0))
    assert set(quality.predict(described, unsure, ["doc_id"]).toPandas().score) == {0.5}
    assert quality.accept(empty, unsure).columns == empty.columns


def test_quality_risk_and_slope():
    """The non-negative risk by its definition, and its slope by differences of it."""
    rng = np.random.default_rng(2)
    l = lambda z: 1 / (1 + np.exp(z))  # noqa: E731, E741
    for shift in (0.0, 3.0, -3.0):
        is_p = np.arange(30) < 12
        z = rng.normal(0, 1, 30) + np.where(is_p, shift, 0)
        positive, negative = quality.risk(z, is_p, 0.4)
        assert positive == pytest.approx(0.4 * l(z[is_p]).mean())
        assert negative == pytest.approx(l(-z[~is_p]).mean() - 0.4 * l(-z[is_p]).mean())
        slope = quality.risk_slope(z, is_p, 0.4)
        for i in range(30):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            a, b = quality.risk(up, is_p, 0.4), quality.risk(down, is_p, 0.4)
            want = -(a[1] - b[1]) if negative < 0 else (sum(a) - sum(b))
            assert slope[i] == pytest.approx(want / 2e-5, abs=1e-6)


def test_quality_prior_is_recovered():
    """Positives are the right-hand cloud; the prior is the share of it among the unlabelled."""
    rng = np.random.default_rng(3)
    cloud = lambda at, n: rng.normal(at, 1, (n, len(quality.NAMES)))
    model = quality.fit(cloud(1, 3000), np.concatenate([cloud(1, 2100), cloud(-1, 900)]))
    assert model.prior == pytest.approx(0.7, abs=0.1)
    assert (model.score(cloud(1, 500)) > 0.5).mean() > 0.95 and (model.score(cloud(-1, 500)) < 0.5).mean() > 0.95


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(name, spark, small, duck, compared):
    assert compared(queries.queries()[name](spark, small).toPandas()) == compared(duck.sql(queries.oracle_sql()[name]).df())


def test_rules_edges(edge, empty, spark):
    got = rules.assess(edge, ["doc_id"]).toPandas().set_index("doc_id")
    assert got.loc[1, "n_words"] == 0 and got.loc[2, "base_failed"] and got.loc[7, "n_repeat_words"] == 120_000
    assert rules.assess(empty, ["doc_id"]).count() == 0
    good = " ".join(f"the word{i} of" for i in range(40))
    df = spark.createDataFrame([(1, good), (2, good + "\n" + good), (3, good.replace("word", "#"))], "doc_id long, text string")
    assert [r.kept for r in rules.assess(df, ["doc_id"]).orderBy("doc_id").collect()] == [True, False, False]


def hits(text, items):
    ws, out, found = words(text, ALNUM), set(), set()
    for key, t in items:
        iw = words(t, ALNUM)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1) if n else ():
            for at in range(len(ws) - n + 1):
                if ws[at : at + n] == iw[s : s + n]:
                    out.update(range(at, at + n))
                    found.add(str(key))
    return len(ws), len(out), len(found)


def test_decontamination_edges(spark, edge, empty):
    items = [(1, "alpha beta gamma"), (2, " ".join(f"w{i}" for i in range(25))), (3, None), (4, "..."), (5, "alpha beta gamma"), (6, "rep rep rep rep rep rep rep rep rep rep rep rep")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    made = ["x Alpha-beta GAMMA beta gamma", " ".join(f"W{i}" for i in range(3, 20)), " ".join(["rep"] * 30), "É alpha beta", " ".join(f"w{i}" for i in range(9)), "alpha beta gamma alpha beta gamma"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
    got = decontam.report(df, bench, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [hits(t, items) for t in made]
    assert decontam.report(edge, bench, ["doc_id"]).count() == 9
    assert decontam.report(empty, bench, ["doc_id"]).count() == 0
    assert {r.n_hit for r in decontam.report(df, bench.limit(0), ["doc_id"]).collect()} == {0}
    assert [r.doc_id for r in decontam.clean(df, bench).orderBy("doc_id").collect()] == [3, 4]


def test_decontamination_beyond_the_bounds(spark, small, monkeypatch):
    before = sorted(map(tuple, queries.op4_decontamination(spark, small).collect()))
    monkeypatch.setattr(decontam, "MOST_TERMS", 3)
    monkeypatch.setattr(decontam, "MOST_PLACES", 3)
    monkeypatch.setattr(decontam, "MOST_TEXTS", 3)
    monkeypatch.setattr(shared, "MOST_ROWS", 3)
    assert sorted(map(tuple, queries.op4_decontamination(spark, small).collect())) == before


def test_one_index_answers_two_benchmarks(spark):
    """Exact hits against brute force for each of two test sets, and no text is read for the second."""
    rng = random.Random(11)
    made = [[f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(0, 80))] for _ in range(60)]
    cut = lambda n: " ".join((t := rng.choice(made))[(a := rng.randint(0, max(0, len(t) - n))) : a + n])
    tests = [[(i, cut(rng.choice([1, 2, 9, 10, 11, 25]))) for i in range(12)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(made)], "doc_id long, text string")
    index = decontam.build(docs, ["doc_id"])
    assert index.postings(spark).count() == sum(map(len, made)) + len(made)
    for items in tests:
        bench = spark.createDataFrame([*items, (None, " ".join(made[0][:12]))], "item_id long, text string")
        got = decontam.answer(spark, decontam.Index(index.folder), bench).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [hits(" ".join(t), [*items, ("", " ".join(made[0][:12]))]) for t in made]


def test_proximity(spark):
    item = [f"t{i}" for i in range(12)]
    df = spark.createDataFrame([(1, " ".join([*item[:6], "x", *item[6:]]))], "doc_id long, text string")
    r = decontam.report(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), ["doc_id"]).first()
    assert (r.n_hit, r.n_near_items) == (0, 1)


def test_near_matches_are_returned(spark, tmp_path):
    item = [f"t{i}" for i in range(12)]
    rows = [(1, " ".join([*item[:6], "x", *item[6:]])), (2, "nothing of it"), (3, " ".join(item)), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.queries()["op4_decontamination"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_near_items, r.contaminated) for r in got] == [(1, 1, False), (2, 0, False), (3, 1, True), (4, 0, False)]


def test_language_id(spark, small, texts):
    d = small.replace("0.001", "0.01")
    got = queries.op5_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_mixture(docs, texts):
    model = langid.train(docs)
    pick = lambda lang: max((t for t in texts[texts.lang == lang].text if "#" not in t), key=len)[:3000]
    share = model.proportions(next(bs.blocks(pa.array([pick("en")[:2000] + " " + pick("fr")[:1000]]))))[0]
    at = dict(zip(model.languages, share, strict=True))
    assert at["en"] == pytest.approx(0.67, abs=0.12) and at["fr"] == pytest.approx(0.33, abs=0.12)


def test_language_mixture_by_brute_force(docs, texts):
    """Converged proportions and the best penalised set, against fits of one text at a time with all steps written out."""
    model = langid.train(docs)
    made = [t[:400] for t in texts.text[:40] if t] + [a[:120] + " " + b[:60] for a, b in zip(texts.text[:20], texts.text[20:40], strict=True) if a and b]
    for block in bs.blocks(pa.array(made)):
        got = model.proportions(block)
        grams, _ = langid._trigrams(block.raw, block.offsets)
        starts, ends, first = bs.spans(block.raw, block.offsets, bs.LETTERS)
        for r in range(block.rows):
            like = np.array([[sum(float(x) for x in model.logs[k][grams[a:z]]) for a, z in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)] for k in range(len(model.languages))])
            if not like.size:
                assert not got[r].any()
                continue
            like = np.exp(like - like.max(axis=0))

            def fitted(allowed, like=like):
                p = allowed / allowed.sum()
                for _ in range(3000):
                    q = like * p[:, None]
                    p = (q / q.sum(axis=0)).mean(axis=1)
                return p, -2 * np.log((like * p[:, None]).sum(axis=0)).sum() + allowed.sum() * math.log(max(like.shape[1], 2))

            p, _ = fitted(np.ones(len(like)))
            allowed = (p >= 0.02).astype(float)
            fits = []
            while allowed.any():
                p, cost = fitted(allowed)
                fits.append((cost, p))
                allowed[np.where(allowed > 0, p, np.inf).argmin()] = 0
            best = min(fits, key=lambda x: x[0])
            close = [x for x in fits if x[0] < best[0] + 1]
            assert any(np.abs(got[r] - p).max() < 0.05 for _, p in close), (r, got[r], fits)


def test_language_fit_stands_still(docs, texts):
    rng = np.random.default_rng(4)
    n = np.array([3, 50, 400, 1])
    like = rng.random((4, n.sum())) ** 4
    share = langid.fit(like, n, np.full((4, 4), 0.25))
    assert share.sum(axis=1) == pytest.approx(1)
    again = langid.fit(like, n, share)
    assert np.abs(again - share).max() < 2 * langid.STILL


def test_language_edges(edge, empty, docs):
    got = langid.predict(edge, langid.train(docs), ["doc_id"]).toPandas()
    assert set(got[got.doc_id.isin([1, 2, 3, 4])].lang_pred) == {"und"} and (got[got.lang_pred == "und"].score == 0).all()
    assert set(langid.predict(edge, langid.train(empty), ["doc_id"]).toPandas().lang_pred) == {"und"}
    assert langid.accept(edge, langid.train(docs)).columns == edge.columns


def shingled(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(sets):
    out = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                out[i].add(j)
                out[j].add(i)
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(2)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(60)] for _ in range(6)]
    made = []
    for k in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            t[rng.randrange(60)] = f"e{rng.randint(0, 9)}"
        made.append(" ".join(t))
    made += ["", None, "a b", "a  B", "only one", "x"]
    got = jaccard.join(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).toPandas().set_index("id")
    links = brute_links([shingled(t) for t in made])
    label = {}
    for i in range(len(made)):
        if i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = i
                    stack += links[x]
    assert got.n_links.to_dict() == {i: len(links[i]) for i in range(len(made))}
    assert got.class_id.to_dict() == label


def test_jaccard_bounds():
    least = jaccard.least_matches(0.8, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 13 and least[-1] < 103


def test_jaccard_edges(edge, empty):
    got = jaccard.join(edge).toPandas()
    assert len(got) == 9 and (got[got.id.isin([1, 2, 3])].n_links == 0).all()
    assert jaccard.join(empty).count() == 0
    assert jaccard.keep_one(edge).filter("doc_id = 6").count() == 1


def test_keep_one_counts_rows(spark):
    made = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    rows = [(1, made["a"]), (1, made["b"]), (1, made["b"]), (2, made["b"] + " x"), (None, made["c"]), (None, made["d"]), (None, made["d"]), (None, made["e"]), (7, made["e"] + " y"), (3, None), (3, None), (3, ""), (4, made["f"]), (5, made["f"]), (None, None), (None, None), (6, made["g"])]
    want = [(1, made["a"]), (1, made["b"]), (None, made["c"]), (None, made["d"]), (7, made["e"] + " y"), (3, None), (3, ""), (4, made["f"]), (None, None), (None, None), (6, made["g"])]
    df = spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "doc_id long, text string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and Counter(map(tuple, kept.collect())) == Counter(want)
    alone = [(None, made["a"]), (None, made["b"]), (1, made["c"])]
    assert Counter(map(tuple, jaccard.keep_one(spark.createDataFrame(alone, "doc_id long, text string")).collect())) == Counter(alone)


def test_join_tells_rows_apart_by_place(spark):
    """Ids that repeat with other texts, null ids and ids that are no numbers lose no link."""
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [("1", a), ("1", b), ("2", b + " x"), ("3", a + " x"), (None, a + " y"), (None, b), ("z", "alone"), (None, None), ("1", b)]
    got = [{**r.asDict()} for r in jaccard.join(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)).orderBy("row_nr").collect()]
    links = brute_links([shingled(t) for _, t in rows])
    assert [r["n_links"] for r in got] == [len(links[i]) for i in range(len(rows))]
    assert [{j for j, x in enumerate(got) if x["class_nr"] == r["class_nr"]} for r in got] == [{*_component(i, links)} for i in range(len(rows))]
    assert [r["class_id"] for r in got] == ["1", "1", "1", "1", "1", "1", "z", None, "1"]
    assert [r["id"] for r in got] == [k for k, _ in rows]
    kept = Counter(map(tuple, jaccard.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    assert kept == Counter([("1", a), ("1", b), ("z", "alone"), (None, None)])


def test_stripes_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "STRIPE", 3)
    test_jaccard_join(spark, monkeypatch, 16)


def test_clean_counts_rows(spark):
    rows = [(1, "x alpha beta gamma"), (1, "not so"), (None, "alpha beta gamma"), (None, "nor this")]
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "not so"), (None, "nor this")])


def test_pieces_match_the_library(tmp_path):
    for kind in ("keys", "checks", "ends", "ids"):
        (tmp_path / f"piece-0.{kind}").write_bytes(b"")
    table = pieces.Table(str(tmp_path), 1, TOKENIZER, "<u2", (b"<|endoftext|>",))
    rng = random.Random(1)
    parts = ["a", "b", "the", "é", "'s", "don't", "\n", "\n\n", " ", "  ", "\t", " ", "　", ".", "...", "!!", "—", "#", "1", "23", "<|endoftext|>", "中", "\r\n", "\u0085", "x.y", "-", " ", "_"]
    for _ in range(60):
        made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(40)]
        for block in bs.blocks(pa.array(made)):
            want = [encoder(TOKENIZER).tokenizer.encode(t, add_special_tokens=False).ids for t in made]
            assert [x.tolist() for x in table.encode(block)] == want and table.count(block).tolist() == [len(w) for w in want]


def test_merkle_roots():
    """The root of a run is that of the tree built level by level; what is kept of it is logarithmic."""

    def by_level(level):
        while len(level) > 1:
            level = [store._digest(b"\x01" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0] if level else store._digest(b"")

    for n in [*range(40), 127, 128, 1000]:
        leaves = [store._digest(str(k).encode()) for k in range(n)]
        run = store.Merkle()
        for leaf in leaves:
            run.add(leaf)
        assert run.root() == store.merkle(leaves) == by_level(leaves) and len(run.whole) <= n.bit_length()


def test_chunks_are_stored_once(spark, tmp_path):
    """Copies of long texts in many partitions leave one chunk for each digest, and one of a single chunk keeps its recipe."""
    long = " ".join(f"word{k % 977} and{k % 31}" for k in range(3000))
    rows = [(k, long if k % 3 else "a short text") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    store.write(df, f"{tmp_path}/s", TOKENIZER)
    encoded = spark.read.parquet(f"{tmp_path}/s/encoded")
    chunks = encoded.filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("digests").distinct().count() > 3 and encoded.filter("kind = 'recipe'").count() == 60
    assert store.verify(spark, f"{tmp_path}/s") and store.digests(spark, f"{tmp_path}/s").select("ids_crc32").distinct().count() == 2


def test_token_store(spark, small, texts, tmp_path):
    got = queries.op7_token_store(spark, small).toPandas().sort_values("doc_id")
    at = 0
    for (i, t, _), r in zip(texts.itertuples(index=False), got.itertuples(), strict=True):
        ids = np.array([*encoder(TOKENIZER).tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_store_round_trip(spark, edge, empty, tmp_path):
    folder = f"{tmp_path}/store"
    store.write(edge, folder, TOKENIZER)
    assert store.verify(spark, folder)
    got = {r.doc_id: r.ids for r in store.read_ids(spark, folder).collect()}
    assert got[1] == got[2] == [0] and encoder(TOKENIZER).tokenizer.decode(got[7][:-1]) == LONG
    assert store.digests(spark, folder).count() == 9
    store.write(edge.withColumn("doc_id", F.concat(F.lit("k"), "doc_id")), f"{tmp_path}/named", TOKENIZER)
    assert [r.doc_id for r in store.digests(spark, f"{tmp_path}/named").orderBy("start").collect()] == [None, "k1", "k2", "k3", "k4", "k5", "k6", "k6", "k7"]
    chunks = spark.read.parquet(f"{folder}/encoded").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("digests").distinct().count()
    store.write(empty, f"{tmp_path}/none", TOKENIZER)
    assert store.digests(spark, f"{tmp_path}/none").count() == 0 and store.verify(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        store.chunk_ids(b"0" * 16, b"\x01\x00")


@pytest.mark.parametrize("harm", ["swapped digests", "other recipe", "altered start", "lost row"])
def test_token_store_proves_its_recipes(spark, tmp_path, harm):
    rng = random.Random(3)
    made = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(1500))) for i in range(4)]
    df = spark.createDataFrame([*made, (8, "a b"), (9, "c d")], "doc_id long, text string")
    store.write(df, f"{tmp_path}/s", TOKENIZER)
    assert store.digests(spark, f"{tmp_path}/s").count() == 6
    rows = spark.read.parquet(f"{tmp_path}/s/recipes").toPandas().sort_values("doc_id").reset_index(drop=True)
    d = [bytes(x) for x in rows.digests]
    if harm == "swapped digests":
        assert len(d[0]) > 2 * store.DIGEST
        d[0] = d[0][store.DIGEST : 2 * store.DIGEST] + d[0][: store.DIGEST] + d[0][2 * store.DIGEST :]
    elif harm == "other recipe":
        assert rows.n_tokens[4] == rows.n_tokens[5] and d[4] != d[5]
        d[4] = d[5]
    elif harm == "altered start":
        rows.loc[5, "start"] += 1
    rows = rows.assign(digests=d).iloc[: 5 if harm == "lost row" else 6]
    spark.createDataFrame(rows, spark.read.parquet(f"{tmp_path}/s/recipes").schema).write.mode("overwrite").parquet(f"{tmp_path}/made")
    import shutil

    shutil.rmtree(f"{tmp_path}/s/recipes")
    shutil.move(f"{tmp_path}/made", f"{tmp_path}/s/recipes")
    spark.catalog.refreshByPath(f"{tmp_path}/s/recipes")
    assert not store.verify(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="manifest"):
        store.digests(spark, f"{tmp_path}/s").count()


def test_crc_of_parts():
    data = random.Random(4).randbytes(5000)
    cut = [0, 7, 900, 901, 5000]
    parts = [data[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
    assert store.joined_crc([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(data)


def test_license_scan(spark, docs, texts, edge, empty):
    got = license.scan(docs, license.build(docs), ["doc_id"]).toPandas().sort_values("doc_id")
    for (_, t, _), r in zip(texts.itertuples(index=False), got.itertuples(), strict=True):
        ws = words(t, ALNUM)
        at = [(i, label) for label, phrase in license.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == (min(at)[0], max(at)[0]) if at else pd.isna(r.first_word)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    df = spark.createDataFrame([(1, "Released under the MIT License. x CC-BY-NC"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "the general version of this work is public"), (4, "licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    assert [r.labels for r in license.scan(df, license.build(df), ["doc_id"]).orderBy("doc_id").collect()] == ["cc-by-nc,mit", "gpl-3", "", "apache-2"]
    assert license.scan(edge, license.build(edge), ["doc_id"]).count() == 9 and license.scan(empty, license.build(empty), ["doc_id"]).count() == 0


def test_license_versions(spark, docs):
    gpl = "under the terms of the GNU {}General Public License as published by the Free Software Foundation; {}version {} of the License"
    rows = [
        (gpl.format("", "either ", 3), "gpl-3"), (gpl.format("", "either ", 2), "gpl-2"), (gpl.format("", "", 2), "gpl-2"), (gpl.format("", "", 3), "gpl-3"), (gpl.format("", "either ", 1), ""),
        (gpl.format("Lesser ", "either ", 3), "lgpl"), (gpl.format("Affero ", "either ", 3), ""),
        ("Licensed under the Apache License, Version 1.1", ""), ("Licensed under the Apache License, Version 2.0", "apache-2"), ("Licensed under the Apache License 2.0", "apache-2"), ("Licensed under the Apache License 1.1", ""),
        ("Licensed under the Apache License, Version 1.1 (the License); you may not use this file except in compliance with the License", ""),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", ""), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = license.scan(df, license.build(docs), ["doc_id"]).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [want for _, want in rows]


def test_license_neighbours(spark, docs):
    """Bodies and notices of licenses that share most of their words."""
    cc = "This work is licensed under a Creative Commons Attribution{} {} {} License."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    nor = "Neither the name of the {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [
        (cc.format("", "4.0", "International"), "cc-by"), (cc.format("", "3.0", "Unported"), "cc-by-3"), (cc.format("", "2.0", "Generic"), ""),
        (cc.format("-ShareAlike", "4.0", "International"), "cc-by-sa"), (cc.format("-ShareAlike", "3.0", "Unported"), "cc-by-sa-3"), (cc.format("-ShareAlike", "2.5", "Generic"), ""),
        (cc.format("-NonCommercial", "4.0", "International"), "cc-by-nc"), (cc.format("-NonCommercial", "3.0", "Unported"), "cc-by-nc-3"),
        (cc.format("-NonCommercial-ShareAlike", "4.0", "International"), "cc-by-nc-sa"), (cc.format("-NonCommercial-NoDerivatives", "4.0", "International"), "cc-by-nc-nd"), (cc.format("-NoDerivatives", "4.0", "International"), "cc-by-nd"),
        (bsd, "bsd"), (bsd + nor.format("copyright holder"), "bsd,bsd-3"), (nor.format("University"), "bsd-3"), (nor.format("copyright holder").replace("endorse or", "praise or"), ""),
        ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-4"),
        ("The Artistic License 2.0", "artistic-2"), ("Licensed under the Artistic License 2.0", "artistic-2"), ("Licensed under the Artistic License 1.0", ""),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"), ("This Font Software is licensed under the SIL Open Font License, Version 1.0.", ""),
        ("made available under the terms of the Eclipse Public License v1.0", ""), ("made available under the terms of the Eclipse Public License v 1.0", "epl-1"), ("made available under the terms of the Eclipse Public License v 2.0", "epl-2"),
        ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0 1. Definitions.", "cddl-1"), ("COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 2.0 1. Definitions.", ""),
        ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "zlib"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    index = license.build(docs)
    got = license.scan(df, index, ["doc_id"]).orderBy("doc_id").collect()
    assert [set(filter(None, r.labels.split(","))) for r in got] == [brute_license(words(t, ALNUM), index) | set(filter(None, r.base_labels.split(","))) for (t, _), r in zip(rows, got, strict=True)]
    assert [r.labels for r in got] == [want for _, want in rows]


def brute_license(ws, index):
    """Labels of every template laid at every place."""
    names = license._vocabulary()
    out = set()
    for (label, text, keys), weights in zip(license.TEMPLATES, index.templates, strict=True):
        t, total = text.split(), index.weights[weights].sum()
        assert [names[c] for c in weights] == t
        for s in range(-len(t), len(ws)):
            share = sum(index.weights[c] for j, c in enumerate(weights) if 0 <= s + j < len(ws) and ws[s + j] == t[j]) / total
            around = ws[max(0, s - 2) : max(0, s + len(t) + 2)]
            has = lambda key: any(around[i : i + len(key)] == key for i in range(len(around)))
            if share >= license.LEAST - 1e-9 and all(has(k.split()) for k in keys):
                out.add(label)
    return out


def test_license_labels_by_brute_force(spark, docs, texts):
    rng = random.Random(8)
    made = [t for t in texts.text if t and len(t) < 1500][:40]
    vocabulary = license._vocabulary()
    for _ in range(160):
        t = rng.choice(license.TEMPLATES)[1].split()
        a = rng.choice([0, 0, 0, 1, 3])
        t = t[a : len(t) - rng.choice([0, 0, 0, 1, 4])]
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        made.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 6))] + t + ["x"] * rng.randint(0, 3) + rng.choice(license.TEMPLATES)[1].split()))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for index in (license.build(docs), license.build(df)):
        got = license.scan(df, index, ["doc_id"]).orderBy("doc_id").collect()
        for t, r in zip(made, got, strict=True):
            assert set(filter(None, r.labels.split(","))) == brute_license(words(t, ALNUM), index) | set(filter(None, r.base_labels.split(","))), t


def test_packing_is_optimal():
    import itertools

    sizes, counts = np.array([3, 5, 9, 10, 20, 31]), np.array([10, 1, 7, 2, 1, 4])
    cost = lambda ends: sum(c * next(e for e in ends if e >= s) for s, c in zip(sizes, counts, strict=True))
    best = min(cost(sorted([*pick, 31])) for pick in itertools.combinations(sizes[:-1].tolist(), 2))
    assert cost(packing.boundaries(sizes, counts, 3)) == best and packing.boundaries(sizes[:0], counts[:0]) == []


def test_packing_plans_with_true_lengths(spark):
    lengths = [1025] * 5 + [random.Random(k).randint(129, 4000) for k in range(300)]
    sized = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")
    assert packing.plan(sized.filter("doc_id < 5")).ends == [1025]
    how = packing.plan(sized)
    sizes, counts = np.unique(lengths, return_counts=True)
    total = np.concatenate([[0], np.cumsum(counts)])
    best = [0.0] + [np.inf] * len(sizes)
    for _ in range(packing.BUCKETS):
        best = [0.0] + [min(best[j], min(best[k] + sizes[j - 1] * (total[j] - total[k]) for k in range(j))) for j in range(1, len(sizes) + 1)]
    assert set(how.ends) <= set(lengths) and sum(c * next(e for e in how.ends if e >= s) for s, c in zip(sizes, counts, strict=True)) == best[-1]
    assert packing.pack(sized, how).agg(F.sum("bucket_size")).first()[0] == best[-1]


def test_packing(spark, small, edge, empty):
    got = queries.op9_packing(spark, small).toPandas()
    assert len(got) == 200 and (got.n_tokens + got.padding == got.bucket_size).all() and (got.padding >= 0).all()
    sized = got.groupby("batch_id").agg(n=("doc_id", "size"), size=("bucket_size", "first"), places=("place", lambda x: sorted(x) == list(range(len(x)))))
    assert sized.places.all() and ((sized.n * sized["size"] <= packing.BUDGET) | (sized.n == 1)).all()
    lengths = packing.lengths(edge, ["doc_id"], TOKENIZER)
    assert packing.pack(lengths, packing.plan(lengths)).count() == 9 and lengths.filter("doc_id = 1").first().n_tokens == 1
    named = packing.pack(lengths.withColumns({"bucket": F.lit("x"), "Padding": F.lit("y"), "other": F.lit("z")}), packing.plan(lengths))
    assert sorted(named.columns) == sorted(["doc_id", "n_tokens", "other", *packing.ADDED]) and named.agg(F.max("bucket")).first()[0] >= 0
    none = packing.lengths(empty, ["doc_id"], TOKENIZER)
    assert packing.pack(none, packing.plan(none)).count() == 0


def test_rollups(spark, tmp_path):
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, n_chars long, old_chars long, extra int")
    folder = f"{tmp_path}/r"
    first = change(("insert", "s", "en", "t1", 10, None, 50, None, 1), ("insert", "s", "en", "t1", 10, None, 50, None, 1), ("insert", None, None, "t1", None, None, 3, None, 1))
    assert rollup.totals(spark, folder).count() == 0
    assert rollup.commit(spark, folder, "a", first) and not rollup.commit(spark, folder, "a", first)
    rollup.commit(spark, folder, "b", change(("revise", "s", "en", "t1", 12, 10, 50, 50, 1), ("delete", None, None, "t1", 0, 0, 0, 3, 1)))
    rollup.commit(spark, folder, "none", change().limit(0) if False else first.limit(0))
    assert [tuple(r) for r in rollup.totals(spark, folder).collect()] == [("s", "en", "t1", 2, 22, 100)]


def test_rollups_show_what_is_left(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, n_chars long, old_chars long"
    change = lambda *rows: spark.createDataFrame(list(rows), schema)
    folder = f"{tmp_path}/r"
    rollup.commit(spark, folder, "a", change(("insert", "s", "en", "t", 10, None, 50, None)))
    rollup.commit(spark, folder, "b", change(("delete", "s", "en", "t", None, 4, None, 50)))
    assert [tuple(r) for r in rollup.totals(spark, folder).collect()] == [("s", "en", "t", 0, 6, 0)]
    for op in ("upsert", None):
        with pytest.raises(Exception, match="no such change"):
            rollup.commit(spark, folder, "c", change((op, "s", "en", "t", 10, 4, 50, 50)))
    assert rollup.totals(spark, folder).count() == 1


def test_rollups_fold(spark, tmp_path):
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, n_chars long, old_chars long"
    one = lambda n: spark.createDataFrame([("insert", "s", "en", "t", n, None, 1, None)], schema)
    folder = f"{tmp_path}/r"
    rollup.compact(spark, folder)
    for n, name in ((1, "a"), (2, "b")):
        rollup.commit(spark, folder, name, one(n))
    rollup.compact(spark, folder)
    assert not rollup.commit(spark, folder, "a", one(1)) and rollup.commit(spark, folder, "c", one(4))
    rollup.compact(spark, folder)
    assert not any(rollup.commit(spark, folder, name, one(n)) for n, name in ((1, "a"), (2, "b"), (4, "c")))
    for name in "abc":  # folded or not, other changes under a committed name are an error
        with pytest.raises(ValueError, match="other changes"):
            rollup.commit(spark, folder, name, one(9))
    assert [tuple(r) for r in rollup.totals(spark, folder).collect()] == [("s", "en", "t", 3, 7, 3)]
    # A fold that died before it removed what it had folded counts nothing twice.
    rollup.commit(spark, folder, "d", one(8))
    name = rollup._name("d")
    kept = spark.read.parquet(f"{folder}/{name}").toPandas()
    rollup.compact(spark, folder)
    spark.createDataFrame(kept, rollup.SCHEMA).write.parquet(f"{folder}/{name}")
    assert [tuple(r) for r in rollup.totals(spark, folder).collect()] == [("s", "en", "t", 4, 15, 4)]
    rollup.commit(spark, folder, "e", one(1))
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit(spark, folder, "e", one(2))
    rollup.compact(spark, folder)  # and removes what the fold that died left
    assert [n for n in rollup._complete(spark, folder) if n.startswith("batch-")] == []
    assert [tuple(r) for r in rollup.totals(spark, folder).collect()] == [("s", "en", "t", 5, 16, 5)]


def test_token_counts_by_brute_force(spark, small, docs):
    want = defaultdict(lambda: [0, 0, 0])
    for r in docs.collect():
        ws = words(r.text)
        if ws:
            n = len(encoder(TOKENIZER).tokenizer.encode(r.text, add_special_tokens=False).ids)
            for tokenizer, k in (("byte_bpe_50k", n), ("words-1", len(ws))):
                for place, x in enumerate((1, k, len(r.text))):
                    want[r.source, r.lang, tokenizer][place] += x
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_chars] for r in queries.op10_token_counts(spark, small).collect()}
    assert got == {k: v for k, v in want.items() if any(v)}


def test_pipeline(spark, small):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(shared.table(spark, stage(spark, seen[-1], small), "t"))
        assert seen[-1].columns == docs.columns, name
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] >= ids[4] and len(ids[4]) > 50
    left = seen[2].toPandas().sort_values("doc_id").reset_index(drop=True)
    links = brute_links([shingled(t) for t in left.text])
    first = {left.doc_id[i] for i in range(len(left)) if i == min(_component(i, links))}
    assert ids[3] == first
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert ids[4] == {r.doc_id for r in seen[3].collect() if not hits(r.text, bench)[1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == ids[4]


def _component(i, links):
    seen, stack = set(), [i]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            stack += links[x]
    return seen


def test_pipeline_stages_on_edges(spark, edge, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.unionByName(edge.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, small).count() > 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), small).count() == 0


CLASHES = ["score", "lang_pred", "n_languages", "__file", "__row", "__copy", "a.b", "__0", "id", "nr", "bare", "d1", "predicted", "x", "bucket", "h", "pos"]


def test_stages_keep_columns_of_any_name(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.select("*", *(F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")).alias(name) for name in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, small)
        assert got.columns == odd.columns, name
        rows = got.toDF(*(f"c{i}" for i in range(len(odd.columns)))).toPandas()
        assert 0 < len(rows) and set(rows["c0"]) == {r.doc_id for r in stage(spark, docs, small).select("doc_id").collect()}, name
        for i, clash in enumerate(CLASHES, len(docs.columns)):
            assert (rows[f"c{i}"] == clash + " " + rows["c0"].astype(str)).all(), (name, clash)
    assert corpus_pipeline.packed(spark, odd, small).count() == docs.count()


def test_packing_spreads_null_and_equal_ids(spark):
    for key in ("cast(null as long)", "7L"):
        sized = spark.range(200_000).selectExpr(f"{key} as doc_id", "100L as n_tokens")
        how = packing.plan(sized)
        got = packing.pack(sized, how)
        assert how.shards(0) > 3
        shards = got.groupBy(F.substring_index("batch_id", "-", 2).alias("s")).count().collect()
        assert len(shards) == how.shards(0) and max(r["count"] for r in shards) < 1.2 * 200_000 / how.shards(0)
        assert got.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= how.capacity(0)


def test_proportions_that_never_rest(monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROUNDS", 2)
    like = np.array([[1.0, 0.9], [0.9, 1.0]])
    share = langid.fit(like, np.array([2]), np.array([[0.9, 0.1]]))
    assert share.sum() == pytest.approx(1) and 0.5 < share[0, 0] < 0.9
