"""Hand-computed results on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import contracts, sources
from lattica.functions import scores, trees
from lattica.functions import text as T
from lattica.operators import corpus as C
from lattica.operators import dcf as D
from lattica.operators import judge as J
from lattica.operators import ontology as O
from lattica.operators import pairs as P
from lattica.operators import prompts as M
from lattica.operators import shards as G
from lattica.operators import stats as S
from lattica.operators import verdicts as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_missing_values(spark):
    got = spark.createDataFrame([(x,) for x in ("N/A", "None", "nan", "", "na", " N/A ")], "t string").select(contracts.normalize_na(F.col("t")).alias("t"))
    assert [r.t for r in got.collect()] == [None, None, None, None, "na", " N/A "]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "ask", "said", None, "b")], "HADM_ID long, normal_ECG_verbalizer_prompt string, normal_ECG_verbalized string, beam_ECG_verbalizer_prompt string, beam_ECG_verbalized string")
    long = contracts.from_wide(df, "_verbalized", "_verbalizer_prompt")
    assert [tuple(r) for r in long.collect()] == [(1, "normal", "ECG", "said")]
    assert contracts.to_wide(long, ["HADM_ID"], [("normal", "ECG")], "_v").first().normal_ECG_v == "said"
    with pytest.raises(contracts.ContractError):
        contracts.validate(df, "nli")
    with pytest.raises(contracts.ContractError):
        contracts.split_column("other_ECG")


def test_text(spark):
    c = F.col("t")
    assert one(spark, T.utrim(c), t=" \n a b \t") == "a b"
    assert one(spark, T.section(c), t="x\nHospital Course: one\ntwo\n\nthree") == "one\ntwo"
    assert one(spark, T.section(c), t="none") is None
    assert one(spark, T.section(c), t="History: end\n") == "end\n"
    assert tuple(one(spark, T.split_question(c), t="A man. He has pain. Why?")) == ("A man. He has pain.", " Why?")
    assert tuple(one(spark, T.split_question(c), t="No question.")) == (None, None)
    assert one(spark, T.strip_keywords(c), t="abc keywords: x\ny") == "abc "
    assert one(spark, T.strip_answer(c), t="Ans: b (Benign)").strip() == "Benign)"
    assert one(spark, T.sentences(c), t="Dr. Smith came. He left! Why? ok") == ["Dr. Smith came.", "He left!", "Why? ok"]
    assert one(spark, T.swap_gender(F.col("a"), F.col("b")), a="A man came", b="The man left") == "The female left"
    assert one(spark, T.fake_summary(F.col("a"), F.col("b"), F.col("z")), a="", b=" MID ", z="end") == "mid end"
    assert one(spark, T.method_label(c), t="hps") == "H + P + S" and one(spark, T.method_label(c), t="pn") == "P*"
    assert one(spark, T.annotate(T.sentences(c), "s"), t="One. Two.") == "<|s1|><One.><end||s><|s2|><Two.><end||s>"


def test_trees():
    got = trees.leaves_of('{"a": [{"n": "x", "m": null}, "y"], "a2": 1, "a2": NaN}')
    assert [("/".join(x["path"]), x["value"]) for x in got] == [("a/0/n", "x"), ("a/0/m", "None"), ("a", "y"), ("a2", "nan")]
    assert trees.leaves_of("no {") is None and trees.leaves_of(None) is None
    text = "<|r1|><It is so.><|subclaims|><one><two><end||subclaims><|cite|><|s1|,|s3|-|s5|, x><end||cite><|explain|><why><end||explain><|unsupported|><end||r><|r2|><Fine.><|subclaims|><end||subclaims><end||r>"
    a, b = trees.claims_of(text)
    assert (a["claim_id"], a["claim_string"], a["subclaims"], a["citations"], a["rationale"], a["supported"]) == (1, "It is so.", ["one", "two"], [1, 3, 4, 5], "why", False)
    assert b["supported"] and b["citations"] == []


def test_scores():
    assert scores.rouge_of("the cat sat", "the cat ran", 1)[2] == pytest.approx(2 / 3)
    assert scores.bleu_of("a b c d e", "a b c d e") == pytest.approx(1.0)
    assert scores.bleu_of("a b", "x y") == 0.0 and scores.rouge_of(None, "a", 1) is None
    assert scores.stem("running") == "run" and scores.stem("cats") == "cat"


def test_admissions(spark):
    rows = [(1, "2020", None, "D", 0), (1, "2020", "10", "N", 1), (1, "2019", "9", "N", 2), (2, "2020", "1", "D", 3), (2, "2020", "1", "D", 4), (3, "2020", "1", "N", 5), (1, "2020", None, "N", 6), (4, "x", "1", None, 7)]
    df = spark.createDataFrame(rows, "h int, d string, t string, c string, _pos int")
    got = C.format_notes(df, "h", [F.asc_nulls_last("d"), F.asc_nulls_last("t"), "_pos"], ["h", "c"], F.col("c") == "D")
    assert [(r["_pos"], r["NOTE_ORDER"]) for r in got.orderBy("NOTE_ORDER").collect()] == [(2, 0), (1, 1), (0, 2), (6, 3)]
    assert C.filter_groups(got, "h", [C.note_count(3)]).count() == 0


def test_positions(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "k int")
    got = sources.with_pos(df, ["k"]).orderBy("k").collect()
    assert [r["_pos"] for r in got] == list(range(200))


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'q"x', "N/A"), ("c", "", "ok")], "x string, y string, z string")
    sources.write_csv(df, f"{tmp_path}/t.csv")
    assert sorted(tuple(r) for r in sources.read_any(spark, f"{tmp_path}/t.csv").collect()) == [("a\nb", 'q"x', None), ("c", None, "ok")]


EDGES = [("d", "b", 0), ("d", "c", 1), ("b", "a", 0), ("c", "a", 0), ("e", "d", 0), ("e", "a", 1)]


def test_closure_order_and_cycle(spark):
    up = O.closure(spark.createDataFrame(EDGES, "child string, parent string, parent_pos int"))
    got = {(r.id, r.bfs_pos): (r.ancestor, r.depth) for r in up.collect()}
    assert [got["e", k] for k in (1, 2, 3, 4)] == [("d", 1), ("a", 1), ("b", 2), ("c", 2)]
    loop = O.closure(spark.createDataFrame([("x", "y", 0), ("y", "x", 0)], "child string, parent string, parent_pos int"))
    assert {(r.id, r.ancestor) for r in loop.collect()} == {("x", "y"), ("x", "x"), ("y", "x"), ("y", "y")}


def test_closure_against_walks(spark):
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{p}", k) for i in range(1, 40) for k, p in enumerate(rng.sample(range(i), min(i, rng.randint(1, 3))))]
    up = O.closure(spark.createDataFrame(edges, "child string, parent string, parent_pos int")).collect()
    parents = {}
    for c, p, _ in edges:
        parents.setdefault(c, []).append(p)
    for i in range(40):
        seen, queue = [], list(parents.get(f"n{i}", []))
        while queue:
            p = queue.pop(0)
            if p not in seen:
                seen.append(p)
                queue += parents.get(p, [])
        assert [r.ancestor for r in sorted((r for r in up if r.id == f"n{i}"), key=lambda r: r.bfs_pos)] == seen


def test_prune(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string, parent_pos int")
    x = spark.createDataFrame([(1, "e", "v"), (1, "d", "w"), (1, "a", "w"), (1, "b", "v"), (2, "z", "v")], "row_id int, concept_id string, value string")
    up, ok = O.closure(edges), spark.createDataFrame([("a",), ("d",), ("b",)], "id string")
    keep = lambda df: sorted((r.row_id, r.concept_id) for r in df.collect())
    assert keep(O.prune(x, up, ok, alpha=1)) == [(1, "a"), (1, "b"), (1, "d"), (1, "e")]
    assert keep(O.prune(x, up, ok, edges, alpha=1)) == [(1, "b"), (1, "d"), (1, "e")]


def test_frequencies(spark):
    up = O.closure(spark.createDataFrame(EDGES, "child string, parent string, parent_pos int"))
    m = spark.createDataFrame([("X", "d", 0), ("X", "d", 1), ("X", "b", 2), ("Y", "b", 3)], "domain string, concept_id string, _pos long")
    counts = D.ancestor_counts(m, up, ["domain"])
    assert {(r.domain, r.concept_id): r.freq for r in counts.collect()} == {("X", "b"): 2, ("X", "c"): 2, ("X", "a"): 3, ("Y", "a"): 1}
    assert [r.concept_id for r in D.top(counts, ["domain"], 3).filter("domain = 'X'").orderBy("rank").collect()] == ["a", "b", "c"]
    f = spark.createDataFrame([("X", "a", 4.0), ("Y", "a", 2.0), ("X", "b", 3.0)], "domain string, concept_id string, freq double")
    assert {(r.domain, r.concept_id): r.freq for r in D.normalise(f, 3).collect()} == {("X", "a"): 2.0, ("Y", "a"): 0.0, ("X", "b"): 2.0}


def test_decisions(spark):
    texts = ["[RESULT] A", "result: b", "[RESULT] N/A", "[RESULT] A or B", None, "none", "a result as such", "[RESULT] (A)", "Text [RESULT] B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(J.decision(F.col("t")).alias("x")).collect()] == ["a", "b", "tie", "a", "parsing_error", "parsing_error", "a", "parsing_error", "b"]
    assert df.select(J.decision(F.col("t"), strict=True, strict_ties=True).alias("x")).collect()[3].x == "tie"
    assert df.select(J.decision(F.col("t"), strict=True).alias("x")).collect()[6].x == "parsing_error"


def test_win_matrix(spark):
    rows = [("m", "n", d) for d in ("a", "a", "b", "tie", "parsing_error")] + [("n", "m", "a"), ("p", "q", "tie")]
    got = {(r.method, r.opponent): r for r in J.win_matrix(spark.createDataFrame(rows, "a string, b string, decision string")).collect()}
    x, y = got["m", "n"], got["n", "m"]
    assert (x.wins, y.wins, x.ties, x.parsing_errors, x.total, x.effective) == (2, 2, 1, 1, 6, 4)
    assert x.wins + y.wins + x.ties + x.parsing_errors == x.total and got["p", "q"].effective_win_rate is None


def test_verdicts(spark):
    texts = ["Factual: YES", "factual no ### Explanation: why", "I say yes ok", " yes and no ", None, "", "Factual not"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(V.parse(F.col("t")).alias("v")).select("v.*").collect()
    assert [(r.valid, r.prediction) for r in got] == [(True, True), (True, False), (True, True), (False, True), (False, False), (False, False), (True, False)]
    assert got[1].explanation_gen == ": why"


def test_pairs(spark):
    df = spark.createDataFrame([("k", True, "t1", 0), ("k", False, "f1", 1), ("k", True, "t2", 2), ("l", True, "x", 3)], "k string, label boolean, v string, _pos int")
    got = P.pivot_pairs(P.having_both(P.first_seen(df, ["k", "label"], ["_pos"]), ["k"], "label"), ["k"], "label", "v").collect()
    assert [tuple(r) for r in got] == [("k", "t1", "f1")]
    swapped = P.swapped_value(spark.createDataFrame([(i, "c" if i < 9 else "d", f"v{i}") for i in range(10)], "i int, c string, v string"), "c", "v", ["i"], F.col("i")).collect()
    assert len(swapped) == 10 and all(r.other_value != r.v and r.other_value for r in swapped if r.c == "c") and [r.other_value for r in swapped if r.c == "d"] == [None]


def test_prompts(spark):
    df = spark.createDataFrame([(1, 0, 0, "L", "a "), (1, 0, 1, "M", " A"), (1, 1, 2, "L", "N/A"), (1, 2, 3, "K", "b"), (2, 0, 4, "L", "N/A")], "h int, n int, o int, l string, v string")
    got = {r.h: r.prompt for r in M.group_entries(df, "h", "n", "o", "l", "v", distinct=True).collect()}
    assert got == {1: "### Clinical note 1\nL : a \n\n### Clinical note 2\nK : b\n", 2: "N/A"}
    rows = [(1, 0, 0, "L", "a"), (1, 0, 1, "K", "b"), (1, 0, 2, "L", "c"), (1, 0, 3, None, "d"), (1, 1, 4, None, "e"), (2, 0, 5, "L", "N/A")]
    repeated = M.group_entries(spark.createDataFrame(rows, "h int, n int, o int, l string, v string"), "h", "n", "o", "l", "v", structure="s").collect()
    text = "### Clinical note 1\nL : a\nK : b\nL : c\n\n### Clinical note 2\n"
    assert {r.h: (r.prompt, r.s) for r in repeated} == {1: (text, [{"L": "c", "K": "b"}, {}]), 2: ("N/A", None)}
    with pytest.raises(ValueError):
        M.judge(F.lit("i"), F.lit("a"), F.lit("b"), "other")


def test_shards(spark):
    assert G.bounds(10, size=5) == [(0, 5), (5, 10)] and G.bounds(10, count=3) == [(0, 4), (4, 8), (8, 10)] and G.bounds(10, size=3, most=5) == [(0, 3), (3, 5)]
    assert G.bounds(10, size=5, legacy=True) == [(0, 5), (5, 10), (10, 10)] and G.bounds(10, count=3, legacy=True) == [(0, 3), (3, 6), (6, 9)]
    old = spark.createDataFrame([(0, "a"), (1, "b")], "_pos int, result string")
    new = spark.createDataFrame([(1, "c"), (2, "d")], "_pos int, result string")
    twice = G.upsert(G.upsert(old, new), new)
    assert sorted(tuple(r) for r in twice.collect()) == [(0, "a"), (1, "c"), (2, "d")]


def test_inference_survives_failures(spark):
    df = spark.createDataFrame([("a", None), ("bad", None), (None, None), ("c", "kept")], "p string, output string")

    def factory():
        def answer(prompts):
            if "bad" in prompts:
                raise RuntimeError("down")
            return [p.upper() for p in prompts]

        return G.retrying(answer, retries=1, wait=0.0)

    got = {r.p: r.output for r in G.infer(df, "p", factory, batch=1).collect()}
    assert got == {"a": "A", "bad": None, None: None, "c": "kept"}


def test_statistics(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",), ("c",)], "c string")
    assert {r.c for r in S.collapse_rare(df, "c", 2).collect()} == {"a", "Others (b, c)"}
    assert {r.c: r.share for r in S.shares(df, "c").collect()}["a"] == pytest.approx(0.6)


def test_order_of_input_does_not_matter(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    a = C.first_k(df, "source", ["doc_id"], 3).select("doc_id").collect()
    b = C.first_k(df.repartition(7), "source", ["doc_id"], 3).select("doc_id").collect()
    assert sorted(a) == sorted(b)


def test_stream_upserts(spark, small, tmp_path):
    from lattica.streaming import upserting

    source = f"{tmp_path}/in"
    spark.read.parquet(f"{small}/events.parquet").limit(50).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for _ in range(2):
        upserting(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", "/x")
    (tmp_path / "c.yaml").write_text('{"data": {"path": "$HERE/y", "odd": 1}, "more": {}}')
    got, warnings = sources.read_config(str(tmp_path / "c.yaml"), {"data": {"path": None, "n": 3}}, (("data", "path"),))
    assert got == {"data": {"path": "/x/y", "n": 3}} and len(warnings) == 2
    with pytest.raises(ValueError):
        sources.read_config(str(tmp_path / "c.yaml"), {"data": {"path": None}, "more": {"k": None}}, (("more", "k"),))


def test_ontology_file(spark, tmp_path):
    from lattica.sources import owl

    (tmp_path / "o.owl").write_text("""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
<owl:Class rdf:about="http://x/1"><rdfs:label xml:lang="en">One</rdfs:label></owl:Class>
<owl:Class rdf:about="http://x/2"><rdfs:label>Two</rdfs:label><rdfs:subClassOf rdf:resource="http://x/1"/>
<owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://x/3"/>
<owl:Restriction><owl:onProperty rdf:resource="http://x/p"/><owl:someValuesFrom rdf:resource="http://x/1"/></owl:Restriction></owl:intersectionOf></owl:Class></owl:equivalentClass></owl:Class></rdf:RDF>""")
    concepts, edges, properties = owl.cache(spark, str(tmp_path / "o.owl"), str(tmp_path / "cache"))
    assert [(r.child, r.parent, r.parent_pos) for r in edges.orderBy("parent_pos").collect()] == [("2", "1", 0), ("2", "3", 1)]
    p = properties.first()
    assert (p.concept_id, p.property_type, p.labels) == ("2", "and", {"p": "One"})
    assert O.describe(concepts, O.closure(edges), properties).filter("id = '2'").first().description.startswith("Medical concept: Two.")


@pytest.mark.parametrize("size", [61, 400, 5000, 1 << 20])
def test_ontology_ranges(spark, tmp_path, size):
    """Ranges that begin in tags, comments, sections of text and nested classes give what one parse of the file gives."""
    from lattica.sources import owl

    def element(i):
        inner = [
            f'<o:Class r:about="http://x/c{i // 2}"><s:label>nested {i}</s:label></o:Class>', '<o:Class r:about="http://x/c0"/>',
            f'<o:Restriction><o:onProperty r:resource="http://x/p"/><o:someValuesFrom r:resource="http://x/c{i - 1}"/></o:Restriction>',
            f'<o:Restriction><o:onProperty r:resource="http://x/p"/><o:someValuesFrom><o:Class><o:unionOf><r:Description r:about="http://x/c{i + 1}"/></o:unionOf></o:Class></o:someValuesFrom></o:Restriction>', "<o:hasValue/>"]
        body = f"<s:label>Né &amp; <![CDATA[<o:Class> {'x' * (i % 90)}]]></s:label>" + (f"<!-- </o:Class> <o:Class r:about='no'> - {'y ' * (i % 60)}> -->" if i % 3 == 0 else "\n ")
        body += "".join(f"<s:subClassOf>{x}</s:subClassOf>" if i % 2 else f"<o:equivalentClass><o:Class><o:intersectionOf>{x}{inner[2]}</o:intersectionOf></o:Class></o:equivalentClass>" for j, x in enumerate(inner) if (i + j) % 3)
        return f'<o:Class r:about="http://x/c{i}"/>' if i % 11 == 5 else f"<o:Class title='a > b' r:about=\"http://x/c{i}\">{body}</o:Class>"

    text = '<?xml version="1.0"?>\n<!DOCTYPE r:RDF [ <!ENTITY x "y"> ]>\n<!-- <o:Class> -->\n<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://www.w3.org/2000/01/rdf-schema#" xmlns:o="http://www.w3.org/2002/07/owl#">'
    text += "".join(element(i) + ("<o:Ontology><o:Class r:about='http://x/deep'/></o:Ontology>" if i % 7 == 0 else "") for i in range(80)) + "<!-- end --></r:RDF>\n"
    (tmp_path / "o.owl").write_text(text, encoding="utf-8")
    got = owl.load(spark, str(tmp_path / "o.owl"), range_bytes=size)
    key = lambda rows: sorted(map(repr, rows))
    for df, want, columns in zip(got, owl.parse(str(tmp_path / "o.owl")), (None, None, ["concept_id", "prop_pos", "property_type", "ids"], None), strict=True):
        assert want and key(tuple(r) for r in (df.select(columns) if columns else df).collect()) == key(want)


def test_ranges_of_an_ontology_are_read_once_by_few_tasks(spark, tmp_path, monkeypatch):
    from lattica.sources import owl

    head = '<r:RDF xmlns:r="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="http://www.w3.org/2000/01/rdf-schema#" xmlns:o="http://www.w3.org/2002/07/owl#">'
    path, size = str(tmp_path / "o.owl"), 1000
    with open(path, "w", encoding="utf-8") as f:
        f.write(head + "".join(f'<o:Class r:about="http://x/{i}"><!-- a < b, <c --><s:label>{i}</s:label></o:Class>' for i in range(20_000)) + "</r:RDF>")
    read = []

    class Counted(owl._Bytes):
        def __init__(self, *given):
            super().__init__(*given)
            read.append(self)

    monkeypatch.setattr(owl, "_Bytes", Counted)
    for start in (0, 5 * size, 700 * size):  # no state is looked for to the end of the file
        owl._scan(path, start, size)
    assert max(len(x.data) for x in read) <= size + 2 + 2 * owl.STEP
    got = owl.classes(spark, path, range_bytes=size)
    assert got.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert got.count() == got.select("concept").distinct().count() == 20_000


def test_closure_follows_its_tables(spark, small, tmp_path):
    import shutil

    from lattica.plans import queries

    for name in ("part", "customer", "nation"):
        shutil.copy(f"{small}/{name}.parquet", tmp_path)
    before = queries()["closure"](spark, str(tmp_path)).count()
    few = spark.read.parquet(f"{small}/customer.parquet").limit(3).toPandas()
    few.to_parquet(f"{tmp_path}/customer.parquet")
    spark.catalog.refreshByPath(str(tmp_path))
    ups = queries()["closure"](spark, str(tmp_path))
    assert ups.count() < before and ups.filter("id like 'c%'").select("id").distinct().count() == 3


def test_stream_without_batches(spark, tmp_path):
    from lattica import streaming

    spark.createDataFrame([], "k int, v int").write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        streaming.merging(spark.readStream.schema("k int, v int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", "k", "v").awaitTermination()
        assert streaming.newest(spark, f"{tmp_path}/out").collect() == [] and streaming.newest(spark, f"{tmp_path}/out").columns == ["k", "v"]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_csv_ranges(spark, tmp_path, size):
    """Any cut of the files gives the rows that one task reads from whole files."""
    import csv
    import random

    rng = random.Random(size)
    cell = lambda: rng.choice(["plain", "", "two\nlines", 'a "quoted" one', '"', '""', "comma, and", "\n", "é中", "N/A", " x ", 'ends "\n', "x" * rng.randint(1, 90)])
    (tmp_path / "t.csv").mkdir()
    for part in range(3):
        with open(tmp_path / "t.csv" / f"part-{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=["\n", "\r\n"][part % 2])
            out.writerow(["id", "a b", 'the "c"'])
            out.writerows([part * 1000 + i, cell(), cell()] for i in range([0, 40, 25][part]))
            f.write("\n" if part == 1 else "")
        if part == 2:
            with open(tmp_path / "t.csv" / "part-2.csv", "a", newline="") as f:
                f.write('9999,"no end of line"')
    whole = spark.read.csv(f"{tmp_path}/t.csv", header=True, multiLine=True, quote='"', escape='"', emptyValue="")
    whole = whole.select(*(sources.normalize_na(F.col(f"`{c}`")).alias(c) for c in whole.columns))
    got = sources.read_csv(spark, f"{tmp_path}/t.csv", range_bytes=size)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got.columns == whole.columns and len(rows(got)) == 66 and rows(got) == rows(whole)


def test_overlap_scores_by_brute_force(spark):
    """All rows of a batch at once give what each pair gives by itself; long texts take no longer than their words."""
    import random
    import time

    rng = random.Random(6)
    text = lambda: rng.choice([None, "", " \t", *[" ".join(rng.choice(["run", "running", "Cats", "cat", "a", "été", "x-y", "relational"]) for _ in range(rng.randint(1, 25))) for _ in range(9)]])
    rows = [(i, text(), text()) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("i", *(scores.rouge(a, b, n, stemmed).alias(f"r{n}{stemmed}") for n in (1, 2, 3) for stemmed in (True, False)), scores.bleu(a, b).alias("bleu"), scores.bigram_share(a, b).alias("share"), scores.text_scores(a, b).alias("t")).collect()
    near = lambda x: None if x is None else pytest.approx(x)
    for r in got:
        _, x, y = rows[r.i]
        for n in (1, 2, 3):
            for stemmed in (True, False):
                want = scores.rouge_of(x, y, n, stemmed)
                assert tuple(r[f"r{n}{stemmed}"]) == ((None, None, None) if want is None else near(want))
        assert r.bleu == near(scores.bleu_of(x, y))
        want = scores.rouge_of(x, y, 2, False)
        assert r.share == (None if want is None or not scores._grams(y, 2, False) else pytest.approx(want[0]))
        assert r.t.rouge1 == (None if x is None or y is None else pytest.approx(scores.rouge_of(x, y, 1)[2]))
    long = " ".join(f"w{rng.randrange(30_000)}" for _ in range(100_000))
    began = time.time()
    one = spark.createDataFrame([(long, long[::-1] + long)], "a string, b string").select(scores.text_scores(a, b).alias("t"), scores.bigram_share(a, b).alias("s")).first()
    assert 0.4 < one.s < 0.6 and 0.6 < one.t.rouge2 < 0.7 and time.time() - began < 60


def test_waves_stop_for_the_whole_job(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def provider(broken):
        def ask(prompts):
            for p in prompts:
                (log / p).write_text("")
            if broken & set(prompts):
                raise RuntimeError("down")
            return [f"said {p}" for p in prompts]

        return lambda: G.aborting(ask, retries=0)

    work = spark.range(0, 100, 1, 4).select(F.col("id").alias("_pos"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("prompt"))
    asked = lambda: {int(f.name) for f in log.iterdir()}
    folder = f"{tmp_path}/answers"
    assert not G.infer_in_waves(work, "prompt", provider({"25"}), folder, 10, 2, batch=5)
    got = {r["_pos"] for r in G.answers(spark, folder).collect()}
    assert got >= set(range(20)) - {7} and 25 not in got and max(got) < 40 and max(asked()) < 40
    for f in log.iterdir():
        f.unlink()
    assert G.infer_in_waves(work, "prompt", provider(set()), folder, 10, 3, batch=5)
    assert asked() == set(range(100)) - got - {7}
    assert sorted((r["_pos"], r.result) for r in G.answers(spark, folder).collect()) == [(i, f"said {i}") for i in range(100) if i != 7]
    assert G.infer_in_waves(work, "prompt", provider({"1"}), folder, 10, 3) and G.infer_in_waves(work.limit(0), "prompt", provider(set()), f"{tmp_path}/none", 10, 3)


def test_column_dicts(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", None]), (2, [], []), (3, None, None)], "g int, x array<int>, y array<string>")
    assert sorted(tuple(r) for r in sources.from_column_dicts(df, ["x", "y"]).collect()) == [(1, 1, "a"), (1, 2, None)]
    with pytest.raises(Exception, match="unequal"):
        sources.from_column_dicts(spark.createDataFrame([(1, [1], None)], df.schema), ["x", "y"]).collect()


def test_command_line(capsys):
    from lattica.__main__ import main

    main(["shards", "10", "--size", "4"])
    assert capsys.readouterr().out.split("\n")[2] == "8 10"
    main(["list"])
    assert "win_matrix" in capsys.readouterr().out.split("\n")


def test_commands(spark, tmp_path, capsys):
    from lattica.__main__ import main

    put = lambda df, name: df.write.parquet(f"{tmp_path}/{name}") or f"{tmp_path}/{name}"
    edges = put(spark.createDataFrame(EDGES, "child string, parent string, parent_pos int"), "ontology/edge").removesuffix("/edge")
    mentions = put(spark.createDataFrame([("X", "d", 0), ("X", "b", 1)], "domain string, concept_id string, _pos long"), "mentions")
    main(["frequencies", mentions, edges, f"{tmp_path}/freq"])
    assert {r.concept_id for r in spark.read.parquet(f"{tmp_path}/freq").collect()} == {"b", "c"}
    x = put(spark.createDataFrame([(1, "e", "v"), (1, "z", "v")], "row_id int, concept_id string, value string"), "x")
    main(["prune", x, put(spark.createDataFrame([("d",)], "id string"), "ok"), edges, f"{tmp_path}/pruned", "--alpha", "1", "2"])
    assert {(r.concept_id, r.config_name) for r in spark.read.parquet(f"{tmp_path}/pruned").collect()} == {("e", "alpha-1"), ("e", "alpha-2")}
    work = put(spark.createDataFrame([(i, f"p{i}") for i in range(5)], "_pos long, p string"), "work")
    done = put(spark.createDataFrame([(0, "r"), (1, "r")], "_pos long, result string"), "done")
    main(["progress", work, done, "--size", "2"])
    assert "shard 0: 2 of 2 (100.0 %)" in capsys.readouterr().out
    main(["next", work, done, "--size", "2", "--count", "1", "--out", f"{tmp_path}/next"])
    assert [r.shard_id for r in spark.read.parquet(f"{tmp_path}/next").collect()] == [1]
    main(["merge", work, done, "--out", f"{tmp_path}/merged"])
    assert spark.read.parquet(f"{tmp_path}/merged").filter("result is null").count() == 3
    main(["split", work, f"{tmp_path}/split", "_pos"])
    assert spark.read.parquet(f"{tmp_path}/split").count() == 5
    main(["verdicts", put(spark.createDataFrame([(True, "Factual: YES", "e"), (False, "unclear", "e")], "label boolean, output string, explanation string"), "verdicts")])
    assert "n_invalid" in capsys.readouterr().out
    main(["winners", put(spark.createDataFrame([("m", "n", "[RESULT] A")], "a string, b string, result string"), "judged"), "--baseline", "n"])
    assert "head_to_head" in capsys.readouterr().out


def test_annotation(spark):
    df = spark.createDataFrame([(1, "Has high Blood pressure, fever."), (2, None)], "id int, t string")
    terms = spark.createDataFrame([("blood pressure", "c1"), ("fever", "c2"), ("high", "c3")], "term string, concept_id string")
    assert sorted((r.concept_id, r.start) for r in G.annotate(df, "t", terms, "id").collect()) == [("c1", 2), ("c2", 4), ("c3", 1)]


def test_learnt_sentences(spark):
    """An abbreviation, a starter and a pair that stays together, which no list names, and the same word in a language where it ends sentences."""
    import random

    from lattica.operators import sentences as S

    rng = random.Random(8)
    plain = lambda: " ".join(rng.choice("abel bodo cana dela ewok fumo gral".split()) for _ in range(rng.randint(4, 9)))
    lines = [f"{plain()} qz. Meyer {plain()}. Then {plain()}." for _ in range(300)]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(lines)] + [(1000 + i, None, f"Then {plain()} qz and {plain()} qz. {plain().capitalize()}. Then qz was.") for i in range(300)] + [(2000, "x", None), (2001, "y", "")], "k int, lang string, text string")
    model = S.learn(docs)
    got = {(r.lang, r.kind, r["item"]) for r in model.collect()}
    assert ("x", "abbreviation", "qz") in got and ("", "abbreviation", "qz") not in got and ("x", "collocation", "qz meyer") in got and ("", "starter", "then") in got
    rows = [(1, "x", "Then he saw qz. Meyer (qz. 3) and qz. Then left! why? \u201cOk. \n 3. x"), (2, None, "It was qz. Meyer knew."), (3, "other", "One qz. Two."), (4, "x", None), (5, "x", " ")]
    out = {r.k: r.sentences for r in S.split(spark.createDataFrame(rows, "k int, lang string, text string"), model).collect()}
    assert out == {1: ["Then he saw qz. Meyer (qz. 3) and qz.", "Then left!", "why?", "\u201cOk.", "3. x"], 2: ["It was qz.", "Meyer knew."], 3: ["One qz.", "Two."], 4: None, 5: []}
    assert S.learn(docs.limit(0)).count() == 0 and S.split(docs.limit(2), model.limit(0)).filter("size(sentences) > 1").count() == 2


def brute_mentions(texts, terms, longest):
    import regex

    word = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
    split = lambda t: [m.group().lower() for m in word.finditer(t)]
    own = {}
    for term, concept in terms:
        if term and split(term):
            own.setdefault(tuple(split(term)), set()).add((concept, term))
    out = []
    for key, text in texts:
        places = [m.span() for m in word.finditer(text or "")]
        ws = split(text or "")
        spans = [(i, n) for i in range(len(ws)) for n in range(max(map(len, own), default=0), 0, -1) if tuple(ws[i : i + n]) in own and i + n <= len(ws)]
        end = 0
        for i, n in spans:
            if not longest or i >= end:
                end = i + n
                out += [(key, c, t, i, n, places[i][0], places[i + n - 1][1]) for c, t in own[tuple(ws[i : i + n])]]
    return sorted(out)


@pytest.mark.parametrize("most", [4_000_000, 7])
def test_mentions_by_brute_force(spark, monkeypatch, most):
    """Terms of several words, with accents and punctuation and in other scripts, that overlap and contain each other; also in slices."""
    import random

    from lattica.operators import mentions

    monkeypatch.setattr(mentions, "MOST_PREFIXES", most)
    rng = random.Random(4)
    some = ["heart", "attack", "été", "caf", "café", "covid", "19", "中文", "ÉTÉ", "e\u0301t", "a_b", "x"]
    terms = [(rng.choice(["", "(", "«"]) + rng.choice([" ", "-", ", "]).join(rng.choice(some) for _ in range(rng.randint(1, 4))) + rng.choice(["", ".", ")"]), f"c{i % 23}") for i in range(40)]
    terms += [(".", "no word"), ("", "empty"), (None, "null"), ("covid-19.", "c1"), ("(abc)", "c2"), *[(" ".join(["x"] * n), f"x{n}") for n in (1, 3, 9)], ("x", "again")]
    texts = [(i, "".join(rng.choice(some) + rng.choice([" ", "  ", "-", ".\n", "’"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " .. "), (103, "(ABC) and Covid 19; cafés caf\u00e9"), (104, "x " * 5000)]
    df, given = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(terms, "term string, concept_id string")
    for longest in (False, True):
        got = G.annotate(df, "t", given, "k", overlapping=not longest).select("k", "concept_id", "term", "start", "n_words", "start_char", "end_char").collect()
        assert sorted(tuple(r) for r in got) == brute_mentions(texts, terms, longest)
    assert G.annotate(df, "t", given.limit(0), "k").count() == 0 and G.annotate(df.limit(0), "t", given, "k", overlapping=False).count() == 0


def test_annotate_terms_of_many_lengths(spark):
    terms = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 71)]
    df = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(70)))], "k int, t string")
    got = G.annotate(df, "t", spark.createDataFrame([(t, t) for t in terms], "term string, concept_id string"), "k").collect()
    assert {(r.term, r.start) for r in got} == {(t, 0) for t in terms}


def chain(spark, n):
    return spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(n)], "child string, parent string, parent_pos int")


def test_long_chains_of_ancestors(spark):
    edges = chain(spark, 55)
    assert [len(r.path) for r in O.paths(edges, "n0").collect()] == [56]
    assert O.closure(edges).count() == 55 * 56 // 2


def test_hierarchy_score(spark):
    edges = spark.createDataFrame(EDGES, "child string, parent string, parent_pos int")
    rows = [("a", "a", 1), ("a", "e", 1), ("b", "e", 0), ("e", "a", 0), ("x", "x", 0), ("a", None, 0), (None, "a", 0), ("c", "d", 1), ("c", "e", 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, base string, other string, want int")
    known = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    up = O.closure(edges)
    plain = {r.i: r.h for r in O.hierarchy_score(df, up, "base", "other", known).collect()}
    assert [plain[i] for i in (0, 1, 3, 4, 5, 6, 7)] == [1, 1, 0, 0, 0, 0, 1] and plain[2] == 1
    cut = {r.i: r.h for r in O.hierarchy_score(df, up, "base", "other", known, ("d",)).collect()}
    assert cut[0] == 1 and cut[1] == 0 and cut[7] == 1 and cut[8] == 0


def test_stems():
    # Examples published with the algorithm.
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi",
            "relational": "relat", "vietnamization": "vietnam", "sensibiliti": "sensibl", "triplicate": "triplic", "goodness": "good", "adjustable": "adjust", "adoption": "adopt", "cease": "ceas", "controll": "control", "roll": "roll"}
    assert {w: scores.stem(w) for w in want} == want


def test_numbered_by_hot_categories(spark):
    rows = [(i, "hot" if i % 3 else None if i % 2 else "cold") for i in random.Random(2).sample(range(200), 200)]
    got = C.numbered_by(spark.createDataFrame(rows, "i int, c string"), "c", ["i"], parts=7).collect()
    by = {}
    for i, c in sorted(rows, key=lambda r: r[0]):
        by.setdefault(c, []).append(i)
    assert {(r.i, r["__nr"], r["__n"]) for r in got} == {(i, k, len(v)) for v in by.values() for k, i in enumerate(v)}
    with pytest.raises(ValueError):
        C.mix(spark.createDataFrame(rows, "i int, c string"), "c", ["i"], {"hot": -0.1})
    assert C.mix(spark.createDataFrame(rows, "i int, c string"), "c", ["i"], {}).count() == 0


def test_flows_keep_rows_without_anything(spark):
    from lattica.operators import extraction as X

    notes = spark.createDataFrame([(1, "x"), (2, "y")], "note_id long, text string")
    up = O.closure(spark.createDataFrame(EDGES, "child string, parent string, parent_pos int"))
    mentions = spark.createDataFrame([(1, "e", 0)], "note_id long, concept_id string, _pos long")
    names = spark.createDataFrame([(c, f"L{c}") for c in "abcde"], "id string, label string")
    none = spark.createDataFrame([], "concept_id string, prop_pos int, property_type string, ids map<string,string>, labels map<string,string>")
    got = X.by_note(X.answered(X.guided(notes, mentions, up, names, none, 2, []), lambda: G.blocking(lambda p: p[:1]))).collect()
    assert {r.note_id: len(r.extraction) for r in got} == {1: 2, 2: 0}
    with pytest.raises(ValueError):
        X.configs(spark, ["other"])
    with pytest.raises(ValueError):
        X.evaluator_rows(notes, notes, "note_id", "text", ["nowhere"], ["note_id"], F.lit(1), 0)


def test_aborting_provider():
    asked = []

    def answer(prompts):
        asked.append(prompts)
        if "bad" in prompts:
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    provider = G.aborting(answer, retries=1, wait=0.0)
    assert [provider([p]) for p in ("a", "bad", "c")] == [["A"], [None], [None]] and len(asked) == 3


def test_streams_merge_by_key(spark, tmp_path):
    from lattica import streaming

    for rows in ([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], [(1, 1, "late"), (2, 5, "d"), (3, 1, "e")]):
        spark.createDataFrame(rows, "k int, at int, v string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("k int, at int, v string").parquet(f"{tmp_path}/in")
        for _ in range(2):
            streaming.merging(stream, f"{tmp_path}/out", f"{tmp_path}/check", "k", "at").awaitTermination()
    assert sorted(tuple(r) for r in streaming.newest(spark, f"{tmp_path}/out").collect()) == [(1, 2, "c"), (2, 5, "d"), (3, 1, "e")]


def test_explanation_scores_of_one_pair(spark):
    df = spark.createDataFrame([(False, False, "the cats ran home", "the cat ran"), (True, True, "x", "y")], "label boolean, prediction boolean, explanation string, explanation_gen string")
    r = V.explanation_scores(df).first()
    assert (r.rouge1, r.rouge2, r.bleu) == (pytest.approx(6 / 7), pytest.approx(4 / 5), 0.0)


def test_shared_folder_is_asked_for_on_clusters(monkeypatch):
    from types import SimpleNamespace

    from lattica import storage

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(ValueError, match="checkpoint"):
        storage.root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn")))


def test_results_table(spark, tmp_path):
    """Random changes in place against a dictionary; bytes written by a commit don't grow with the table; names clash with none."""
    import random

    from pyspark.sql import functions as F

    from lattica.operators import results as R

    path, rng, want = f"{tmp_path}/t", random.Random(5), {}
    schema = "k long, `row` string, `gone` int, `a.b` map<string,int>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    R.create(spark, path, frame([]).schema, "k")
    now = lambda: {r[0]: tuple(r)[1:] for r in R.read(spark, path).collect()}
    assert now() == {} and not R.compact(spark, path)
    assert not R.upsert(frame([]), path) and R.segments(spark, path) == []
    for step in range(9):
        rows = {k: (rng.choice(["x", None, ""]), rng.choice([1, None]), {"n": step}) for k in rng.sample(range(60), 60 if step == 0 else 9)}
        R.upsert(frame([(k, *v) for k, v in rows.items()]), path)
        want |= rows
        assert R.segments(spark, path)[-1]["rows"] == len(rows)
        if step % 3 == 1:
            lost = rng.sample(range(80), 12)
            R.delete(spark.createDataFrame([(k,) for k in [*lost, None, lost[0]]], "k long"), path)
            want = {k: v for k, v in want.items() if k not in lost}
        if step % 3 == 2:
            R.compact(spark, path)
        assert now() == want
    low = {r[0]: tuple(r)[1:] for r in R.read_between(spark, path, 10, 20).collect()}
    assert low == {k: v for k, v in want.items() if 10 <= k <= 20}
    R.clear(spark, path, F.col("row") == "x")
    R.repair(spark, path, spark.createDataFrame([(1,), (9,)], "shard_id long"), 20)
    want = {k: v for k, v in want.items() if v[0] != "x" and k // 20 != 1}
    assert now() == want and R.compact(spark, path, all_of_them=True) and now() == want
    assert [s["rows"] for s in R.segments(spark, path)] == [len(want)]
    assert R.vacuum(spark, path) == 0 and R.vacuum(spark, path, keep=1, seconds=-5) > 0 and now() == want
    R.create(spark, path, frame([]).schema, "k")
    with pytest.raises(ValueError):
        R.create(spark, path, frame([]).drop("gone").schema, "k")
    with pytest.raises(Exception, match="null key"):
        R.upsert(frame([(None, "x", 1, {})]), path)
    assert now() == want


def test_results_commits(spark, tmp_path):
    """Batches count once, rows with less of the order lose, and writers that meet lose nothing."""
    from concurrent.futures import ThreadPoolExecutor

    from lattica.operators import results as R

    path = f"{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame(rows, "k string, at int, v string")
    R.create(spark, path, frame(("", 0, "")).schema, "k")
    now = lambda: sorted(tuple(r) for r in R.read(spark, path).collect())
    assert R.upsert(frame(("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", None, "y")), path, "at", "w", 0)
    assert now() == [("a", 2, "x"), ("b", None, "z")]
    assert not R.upsert(frame(("a", 9, "late")), path, "at", "w", 0) and R.upsert(frame(("a", 1, "old"), ("b", 1, "new"), ("c", None, "n")), path, "at", "w", 1)
    assert now() == [("a", 2, "x"), ("b", 1, "new"), ("c", None, "n")]
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(R.upsert, frame((f"p{i}", i, "p"), ("q", i, "q")), path, "at") for i in range(4)]
        pool.submit(R.compact, spark, path).result()
        assert all(j.result() in (True, False) for j in jobs)
    got = now()
    assert [r for r in got if r[0] == "q"] == [("q", 3, "q")] and sum(r[0].startswith("p") for r in got) == 4


def test_first_by_moves_no_wide_row(spark):
    """Cuts with ties and null categories against sorted lists; the rows that are kept aren't shuffled unless ties are cut."""
    from collections import Counter

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "cold", None]), rng.choice([None, *range(6)]), f"text {rng.random()}") for _ in range(300)]
    df = spark.createDataFrame(rows, "c string, i int, wide string")
    rank = lambda r: (r[1] is not None, r[1] or 0)
    by = {c: sorted((r for r in rows if r[0] == c), key=rank) for c in ("hot", "cold", None)}
    for share in (0, 0.3, 1, 2):
        got = [tuple(r) for r in C.first_by(df, "c", ["i"], lambda sizes, f=share: sizes.withColumn("__take", (f * sizes["__n"]).cast("long"))).collect()]
        for c, own in by.items():
            assert Counter(r[1] for r in got if r[0] == c) == Counter(r[1] for r in own[: int(share * len(own))])
        assert set(got) <= set(rows) and len(set(got)) == len(got)
    assert Counter(r.c for r in C.balanced(df, "c", ["i"]).collect()) == dict.fromkeys(by, min(map(len, by.values())))
    whole = C.mix(df, "c", ["wide"], {"hot": 0.5, "cold": 1.0})
    assert sorted(r.wide for r in whole.collect()) == sorted([*sorted(r[2] for r in by["hot"])[: len(by["hot"]) // 2], *(r[2] for r in by["cold"])])
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Repartition" not in plan  # one join with the cuts and a filter


def test_coded_rare(spark):
    """The label is stored once: a hundred thousand rare names take as many rows and no long text; no category, no label."""
    many = spark.range(100000).selectExpr("cast(id as string) as c", "'x' as d").unionByName(spark.range(5).selectExpr("'often' as c", "'7' as d"))
    rows, names = S.coded_rare(many, "c", 2, ["c", "d"])
    assert rows.filter("c_label = 0").count() == names.count() == 100000 and rows.filter("d_label = 0").count() == 5
    assert [r.name for r in names.orderBy("nr").limit(3).collect()] == ["0", "1", "10"]
    rows, names = S.coded_rare(spark.createDataFrame([(None,)], "c string"), "c", 9)
    assert [tuple(r) for r in rows.collect()] == [(None, None)] and names.count() == 0
    assert [tuple(r) for r in S.collapse_rare(spark.createDataFrame([(None,)], "c string"), "c", 9).collect()] == [(None,)]


def test_table_functions(spark):
    """Tables of any form, texts that are null or no JSON, missing and clashing columns, and mentions in groups."""
    from lattica.functions import tables

    tables.register(spark)
    spark.createDataFrame([(1, None), (2, "no"), (3, '{"a": [1, {"b": null}]}')], "id int, t string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT id, pos, path, value FROM texts, LATERAL json_leaves(t)").collect()
    assert [tuple(r) for r in got] == [(3, 0, ["a", "0"], "1"), (3, 1, ["a", "1", "b"], "None")]
    assert spark.sql("SELECT * FROM texts, LATERAL tagged_claims(t)").count() == 0
    got = spark.sql("SELECT * FROM with_claims(TABLE(texts), 't') ORDER BY id")
    assert got.columns == ["id", "t", "claim_id", "claim_string", "subclaims", "citations", "rationale", "supported"] and [r.id for r in got.collect()] == [1, 2, 3]
    with pytest.raises(Exception, match="no column u"):
        spark.sql("SELECT * FROM with_claims(TABLE(texts), 'u')").collect()
    with pytest.raises(Exception, match="named Rationale too"):
        spark.sql("SELECT * FROM with_claims(TABLE(SELECT t, 1 AS Rationale FROM texts), 't')").collect()
    rng = random.Random(4)
    spans = list({(rng.choice("ab"), rng.randrange(30), rng.randrange(1, 5), rng.randrange(2)) for _ in range(60)})
    spark.createDataFrame(spans, "`a.k` string, start int, n_words int, concept int").repartition(5).createOrReplaceTempView("spans")
    want = set()
    for k in "ab":
        end = 0
        for s, n in sorted({(s, -n) for g, s, n, _ in spans if g == k}):
            if s >= end:
                end = s - n
                want |= {r for r in spans if r[:3] == (k, s, -n)}
    assert {tuple(r) for r in spark.sql("SELECT * FROM unlapped(TABLE(spans), 'a.k')").collect()} == want


def test_configurations_are_dealt_to_all_cores(spark):
    from lattica import sources

    rows = spark.createDataFrame([(i, None if i == 3 else f"a: {{x: {i}, y: no}}") for i in range(2000)], "i int, text string").coalesce(1)
    got = sources.parsed_configs(rows, "text", {"a": {"x": 0, "y": None}})
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = {(r.i, r.name): r.value for r in got.collect()}
    assert len(found) == 4000 and found[7, "x"] == "7" and found[7, "y"] == "False" and found[3, "x"] == "0"


@pytest.mark.parametrize("most", [3, 1000])
def test_longest_mentions_and_those_apart(spark, monkeypatch, most):
    from lattica.operators import mentions as M

    monkeypatch.setattr(M, "MOST_PREFIXES", most)
    monkeypatch.setattr(M, "MOST_WORDS", 4)  # rows are matched a few at a time
    terms = spark.createDataFrame([("a b", 1), ("A, b", 2), ("b c d", 3), ("a", 4), ("c", 5), ("d a", 6)], "term string, concept_id int")
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b-c d a b"), (3, None), (4, "x"), (5, "(a) c")], "k int, text string").coalesce(1)
    every = M.find(docs, "text", terms, ["k"])
    apart = M.find(docs, "text", terms, ["k"], "apart")
    longest = {(r.k, r.start, r.n_words) for r in M.spans(docs, "text", M.terms_of(terms), ["k"], "longest").collect()}
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, M.leftmost_longest(every, ["k"]).collect()))
    assert longest == {(r.k, r.start, r.n) for r in every.groupBy("k", "start").agg(F.max("n_words").alias("n")).collect()}
    assert {(r.k, r.start, r.concept_id) for r in apart.collect()} == {(1, 0, 1), (1, 0, 2), (1, 2, 5), (2, 0, 3), (2, 3, 1), (2, 3, 2), (5, 0, 4), (5, 1, 5)}


@pytest.mark.parametrize("mounted", [True, False])
def test_trie_of_mentions_leaves_the_driver_alone(spark, monkeypatch, mounted):
    """Beginnings of terms lie in many files, of which the driver sees a row each, or go through it as packed bytes slice by slice."""
    from pyspark.sql.classic.dataframe import DataFrame

    from lattica import storage
    from lattica.operators import mentions as M

    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table of beginnings in the driver"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    monkeypatch.setattr(storage, "mounted", lambda spark: mounted)
    monkeypatch.setattr(M, "IN_FILE", 100)
    monkeypatch.setattr(M, "MOST_PREFIXES", 500)
    rng = random.Random(5)
    word = lambda: rng.choice(["", "É", "b"]) + rng.choice("abcdefghij") + rng.choice("abcdefghij")
    terms = sorted({(" ".join(word() for _ in range(rng.randint(1, 4))), i % 31) for i in range(700)})
    texts = [(i, " - ".join(word() for _ in range(60))) for i in range(40)]
    df, given = spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(terms, "term string, concept_id int").repartition(8)
    got = M.find(df, "t", given, ["k"], "apart")
    assert collected and all(len(rows) < 30 for rows in collected) and sum(map(len, collected)) >= 3  # over 1,000 beginnings
    assert sorted(tuple(r) for r in collect(got)) == brute_mentions(texts, terms, True)
    assert sorted(tuple(r) for r in collect(M.find(df, "t", given, ["k"]))) == brute_mentions(texts, terms, False)
    assert collect(M.find(df, "t", given.limit(0), ["k"])) == []


def test_table_function_gets_mentions_without_a_trie_in_the_driver(spark, small, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from lattica import plans
    from lattica.operators import mentions as M

    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a table of beginnings in the driver"))
    monkeypatch.setattr(M, "IN_FILE", 50)
    names = ["doc_id", "concept_id", "term", "start", "n_words", "start_char", "end_char"]
    got = [sorted(map(tuple, plans.queries()[q](spark, small).select(*names).collect())) for q in ("table_mentions", "text_mentions")]
    assert got[0] and got[0] == got[1]


def _sorts(df):
    """Whether a plan sorts rows to aggregate them."""
    return "SortAggregate" in df._jdf.queryExecution().executedPlan().toString()


def test_first_positions_are_hashed_not_sorted(spark):
    from lattica.operators import dcf as D

    up = spark.createDataFrame([("a", "t", 1, 1), ("a", "r", 2, 2), ("b", "t", 1, 2), ("b", "s", 1, 1), ("b", "r", 2, 3), ("t", "r", 1, 1), ("s", "r", 1, 1)], "id string, ancestor string, depth int, bfs_pos int")
    rows = [("x", "a", 5), ("x", "b", -3), ("x", "b", 5), ("y", "a", None), ("y", "b", 1 << 62)]
    mentions = spark.createDataFrame(rows, "note_id string, concept_id string, _pos long")
    counts = D.ancestor_counts(mentions, up, ["note_id"])
    assert not _sorts(counts)
    # The order is that of pairs of position and place, null positions first.
    want = sorted({(n, a) for n, c, _ in rows for i, a, _, _ in up.collect() if i == c}, key=lambda k: (k[0], min(((p is not None, p or 0), b) for n, c, p in rows if n == k[0] for i, a, _, b in up.collect() if i == c and a == k[1])))
    assert [(r.note_id, r.concept_id) for r in counts.orderBy("note_id", "first_pos").collect()] == want
    best = D.note_concepts(mentions, up, 1, ["s"])
    assert not _sorts(best)
    assert sorted((r.note_id, r.concept_id, r.freq) for r in best.collect()) == [("x", "t", 2.0), ("y", "t", 1.25)]


def test_a_concept_of_most_rows_is_dealt_to_many_tasks(spark):
    ids = spark.createDataFrame([("hot",), ("cold",)], "id string")
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 100 == 0, F.lit("cold")).when(F.col("id") % 7 == 0, F.lit("none")).otherwise(F.lit("hot")).alias("concept_id"))
    kept = O.spread_join(rows, "concept_id", ids, F.col("row_id"))
    assert kept.columns == rows.columns and kept.count() == rows.filter("concept_id <> 'none'").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        parts = O.spread_join(rows, "concept_id", ids, F.col("row_id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) > 3 and max(r["count"] for r in parts) < 10_000


def test_scores_of_pieces_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    a, b = pa.array([["x", "y"], None, [], ["z"] * 9]), pa.array([["x"], ["y"], ["z"], ["z"]])
    monkeypatch.setattr(scores, "MOST_WORDS", 3)
    seen = []

    def size(x, y):
        seen.append(len(x))
        return pa.array([len(p or []) + len(q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)])

    assert scores._in_pieces(size, a, b).to_pylist() == [3, 1, 1, 10] and seen == [1, 2, 1]
    assert scores._in_pieces(size, a.slice(0, 0), b.slice(0, 0)).to_pylist() == []


def test_forms_are_matched_once_a_token(spark):
    from lattica.operators import sentences as S

    docs = spark.createDataFrame([("Dr. Who came. He saw Dr. No. ", "en")] * 50 + [(None, "en")], "text string, lang string")
    matched = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def form(token):
        matched.add(1)
        return token.lower()

    before, S.form = S.form, lambda token: form(token)
    try:
        S.learn(docs).collect()
    finally:
        S.form = before
    assert 0 < matched.value < 350  # one at each of 350 tokens before
