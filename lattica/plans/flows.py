"""Flows from end to end: factuality, judges over shards, domain fit, model tables, evaluator rows, and streams of files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import storage, streaming
from ..functions import scores
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import judge as J
from ..operators import shards as G
from ..operators import verdicts as V
from . import evaluation as plans
from . import query, sql_over, table

_CASES = """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS context, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS statement, event_id % 2 = 0 AS label FROM events"""
_ASKED = "CASE WHEN context IS NULL THEN '' ELSE 'Context:\n' || context || '\n\n' END || 'Statement: ' || statement || '\n\nIs the statement factual?'"


def _checker():
    return G.blocking(lambda p: "Factual: YES ### Explanation: so it is" if len(p) % 2 else "factual: no")


@query(f"""WITH q AS (SELECT *, {_ASKED} AS text FROM ({_CASES}) WHERE statement IS NOT NULL)
 SELECT id, text, true AS valid, length(text) % 2 = 1 AS prediction, CASE WHEN length(text) % 2 = 1 THEN ': so it is' ELSE '' END AS told FROM q""")
def factuality(spark, d):
    done, _ = E.factuality(sql_over(spark, d, _CASES, "events"), _checker)
    return done.select("id", "text", "valid", "prediction", F.when(F.col("output").contains("###"), F.col("explanation_gen")).otherwise("").alias("told"))


_EXAMPLE = "'Context:\nA dog.\n\nStatement: A cat.\n\nIs the statement factual?\n### Factual: NO\n### Explanation: It is a dog.\n'"


@query(f"""WITH q AS (SELECT *, {_ASKED} AS text FROM ({_CASES}) WHERE statement IS NOT NULL) SELECT id, text, length({_EXAMPLE} || text) % 2 = 1 AS prediction FROM q""")
def factuality_one_shot(spark, d):
    example = {"context": "A dog.", "statement": "A cat.", "label": False, "explanation": "It is a dog."}
    done, _ = E.factuality(sql_over(spark, d, _CASES, "events"), _checker, example)
    return done.select("id", "text", "prediction")


@query("SELECT event_id AS id, 'c1' AS concept_id, event_type AS statement, 'Nation 1 : ' || event_type AS labelled FROM events UNION ALL SELECT event_id, 'c2', props, 'Nation 2 : ' || props FROM events")
def extraction_statements(spark, d):
    m = F.create_map(F.lit("c1"), F.col("event_type"), F.lit("c2"), F.col("props"), F.lit(""), F.lit("left out"))
    df = table(spark, d, "events").select("event_id", F.col("event_type").alias("TEXT"), m.alias("constrained"))
    names = spark.createDataFrame([("c1", "Nation 1"), ("c2", "Nation 2")], "id string, label string")
    plain = E.statements_of_extractions(df, "event_id", "TEXT", "constrained", "constrained", names)
    named = E.statements_of_extractions(df, "event_id", "TEXT", "constrained", "constrained", names, values_only=False)
    return plain.select("id", "concept_id", "statement").join(named.select("id", "concept_id", F.col("statement").alias("labelled")), ["id", "concept_id"])


@query("SELECT event_id AS id, props AS context, event_type AS statement FROM events")
def summary_statements(spark, d):
    return E.statements_of_summaries(table(spark, d, "events"), "event_id", "props", "event_type")


@query("SELECT event_id AS _pos, CASE length(event_type) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS decision FROM events")
def judged_shards(spark, d):
    """A judge over all shards, in batches, its answers parsed."""
    work = table(spark, d, "events").select(F.col("event_id").alias("_pos"), F.col("event_type").alias("prompt"))
    judge = lambda: G.retrying(lambda ps: [["So [RESULT] A", "[RESULT] B", "[RESULT] N/A"][len(p) % 3] for p in ps])
    n = work.count()
    none = work.limit(0).select("_pos", F.col("prompt").alias("result"))
    done = G.infer_shards(work, none, "prompt", judge, G.bounds_table(spark, n, 300), 300, batch=24)
    return done.select("_pos", J.decision(F.col("result")).alias("decision"))


@query("SELECT event_id AS _pos, 'said ' || event_id AS result, event_id // 300 < 3 AS at_first FROM events")
def waves_of_calls(spark, d):
    """A provider that is down from the fourth shard on stops the whole run after that wave; a later run asks for the rest."""
    folder = f"{storage.root(spark)}/waves-{uuid.uuid4().hex}"
    work = table(spark, d, "events").select(F.col("event_id").alias("_pos"), F.col("event_id").cast("string").alias("prompt"))
    down = lambda: G.blocking(lambda p: None if int(p) >= 900 else f"said {p}")
    if G.infer_in_waves(work, "prompt", down, folder, 300, 2):
        raise ValueError("a provider that is down answers nothing")
    first = storage.table(spark, G.answers(spark, folder), "answered")
    G.infer_in_waves(work, "prompt", lambda: G.blocking(lambda p: f"said {p}"), folder, 300, 10_000)
    return G.answers(spark, folder).join(first.select("_pos", F.lit(True).alias("at_first")), "_pos", "left").select("_pos", "result", F.coalesce("at_first", F.lit(False)).alias("at_first"))


@query(f"""WITH {plans._PARSED}, v AS (SELECT * FROM parsed WHERE valid), c AS (SELECT count(*) AS n, count(*) FILTER (label AND prediction) AS tp, count(*) FILTER (NOT label AND prediction) AS fp, count(*) FILTER (label AND NOT prediction) AS fn, count(*) FILTER (NOT label AND NOT prediction) AS tn FROM v)
 SELECT n, tp, fp, fn, tn, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, (SELECT count(*) FROM parsed WHERE NOT valid) AS n_invalid FROM c""")
def metric_bundle(spark, d):
    df = plans._parsed(spark, d).withColumn("explanation", F.concat_ws(" ", F.lit("because"), "event_type"))
    return V.metrics(df).select("n", "tp", "fp", "fn", "tn", "f1", "n_invalid")


@query(f"""WITH {plans._DECIDED}, o AS (SELECT CASE WHEN a_result IS NULL OR b_result IS NULL THEN 'model_na' WHEN result IS NULL THEN 'no_concepts_found' WHEN lower(trim(a_result)) = lower(trim(b_result)) THEN 'identical_generations'
 WHEN NOT regexp_matches(result, '{plans._DECISION}') THEN 'not_enough_tokens' ELSE 'correct_generations' END AS outcome FROM d WHERE decision = 'tie') SELECT outcome, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM o GROUP BY 1""")
def tie_shares(spark, d):
    from ..operators.stats import shares

    ties = plans._decided(spark, d).filter("decision = 'tie'")
    return shares(ties.select(J.outcome(F.col("a_result"), F.col("b_result"), F.col("result")).alias("outcome")), "outcome")


@query(f"""{plans._MATRIX}, n AS (SELECT method, row_number() OVER (ORDER BY count(*) FILTER (effective_win_rate > 50) DESC, method) AS place FROM m GROUP BY 1)
 SELECT x.method, y.method AS opponent, x.place, y.place AS opponent_place, coalesce(effective_win_rate, 0) AS rate, coalesce(round(effective_win_rate * effective / 100), 0)::BIGINT AS wins, coalesce(effective, 0) AS base
 FROM n x CROSS JOIN n y LEFT JOIN m ON m.method = x.method AND m.opponent = y.method""")
def win_cells(spark, d):
    return J.matrix_cells(J.win_matrix(plans._decided(spark, d)))


@query(f"""WITH {plans._DECIDED}, w AS (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '42'), event_id) AS r FROM d WHERE ((a = 'm1' AND decision = 'a') OR (b = 'm1' AND decision = 'b')) AND a_result <> b_result) SELECT event_id FROM w WHERE r = 1""")
def sampled_win(spark, d):
    return J.sample_win(plans._decided(spark, d), "m1", "event_id").select("event_id")


_TWO = "SELECT user_id, concat('c', event_id % 5) AS concept, min(event_type) AS value, min(props) AS other FROM events GROUP BY 1, 2"


@query(f"""WITH l AS ({_TWO}), x AS (SELECT * FROM l WHERE user_id % 2 = 0), y AS (SELECT * FROM l WHERE user_id % 3 = 0)
 SELECT x.user_id, x.concept, 'one' AS a, 'two' AS b, x.value AS a_result, y.other AS b_result FROM x JOIN y ON x.user_id = y.user_id AND x.concept = y.concept UNION ALL SELECT x.user_id, x.concept, 'two', 'one', y.other, x.value FROM x JOIN y ON x.user_id = y.user_id AND x.concept = y.concept""")
def dataset_pairs(spark, d):
    long = sql_over(spark, d, _TWO, "events")
    right = long.filter("user_id % 3 = 0").select("user_id", "concept", F.col("other").alias("value"))
    return J.dataset_pairs(long.filter("user_id % 2 = 0"), right, ["user_id", "concept"], "one", "two")


_CONFIGURED = "SELECT user_id, CASE WHEN event_id % 5 = 4 THEN '' ELSE concat('c', event_id % 5) END AS concept, concat('m', event_id % 3) AS method, min(event_type) AS value FROM events GROUP BY 1, 2, 3"
_PAIRED = f"""l AS (SELECT * FROM ({_CONFIGURED}) WHERE concept <> ''), p AS (SELECT x.m AS a, y.m AS b FROM (SELECT DISTINCT method AS m FROM l) x, (SELECT DISTINCT method AS m FROM l) y WHERE x.m <> y.m),
 k AS (SELECT DISTINCT user_id, concept, a, b FROM l JOIN p ON l.method = a OR l.method = b), r AS (SELECT k.*, coalesce(x.value, 'N/A') AS a_result, coalesce(y.value, 'N/A') AS b_result FROM k LEFT JOIN l x ON x.user_id = k.user_id AND x.concept = k.concept AND x.method = k.a LEFT JOIN l y ON y.user_id = k.user_id AND y.concept = k.concept AND y.method = k.b)"""


@query(f"WITH {_PAIRED} SELECT 'all' AS kind, * FROM r UNION ALL SELECT 'baseline', * FROM r WHERE a = 'm0' OR b = 'm0'")
def config_pairs(spark, d):
    long = sql_over(spark, d, _CONFIGURED, "events")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), *df.columns)
    return tag(J.config_pairs(long, ["user_id", "concept"]), "all").unionByName(tag(J.config_pairs(long, ["user_id", "concept"], "m0"), "baseline"))


_METHOD = "CASE event_id % 5 WHEN 0 THEN 'hps' WHEN 1 THEN 'hp' WHEN 2 THEN 'h' WHEN 3 THEN 'pn' ELSE 's' END"


@query(f"""SELECT row_number() OVER (ORDER BY len(m) - (m = 'pn')::INT, rate, m) AS place, m AS method, rate FROM (SELECT {_METHOD} AS m, avg(CASE WHEN event_type IN ('click', 'view') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM events GROUP BY 1)""")
def method_order(spark, d):
    """Methods by their number of parameters, then by the rate of their events that count as won."""
    from pyspark.sql import Window

    from ..functions.text import method_label, param_count

    won = F.when(F.col("event_type").isin("click", "view"), 100.0).otherwise(0.0)
    rows = table(spark, d, "events").groupBy(F.expr(_METHOD).alias("method")).agg(F.avg(won).alias("rate"))
    by = Window.orderBy(param_count(method_label(F.col("method"))), "rate", "method")  # a row for each method
    return rows.select(F.row_number().over(by).alias("place"), "method", "rate")


@query("""WITH s AS (SELECT event_type AS domain, CASE WHEN event_id % 2 = 0 THEN 'an ECG of the nursing desk' ELSE props END AS t FROM events WHERE event_type IN ('click', 'view')),
 m AS (SELECT domain, length(regexp_replace(t, '(?i)ECG|Radiology|Nursing', 'clinical', 'g')) AS n FROM s), p AS (SELECT domain, avg(CASE domain WHEN 'click' THEN 1.0::DOUBLE / n ELSE 1 - 1.0::DOUBLE / n END) AS score FROM m GROUP BY 1)
 SELECT domain, round(score, 9) AS score FROM p UNION ALL SELECT 'average', round(avg(score), 9) FROM p""")
def domain_fit(spark, d):
    df = table(spark, d, "events").filter("event_type in ('click', 'view')").select("event_type", F.when(F.col("event_id") % 2 == 0, "an ECG of the nursing desk").otherwise(F.col("props")).alias("t"))
    guess = lambda c: F.create_map(F.lit("C"), 1.0 / F.length(c), F.lit("V"), 1 - 1.0 / F.length(c))
    return V.domain_fit(df, "t", "event_type", guess, ["ECG", "Radiology", "Nursing"], {"click": "C", "view": "V"}).select("domain", F.round("score", 9).alias("score"))


@query(f"""WITH {plans._PARSED}, t AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'NLI' ELSE 'Question-Answering' END AS task FROM parsed WHERE valid), c AS (SELECT 'one' AS model, * FROM t UNION ALL SELECT 'two', * FROM t WHERE task = 'NLI'),
 f AS (SELECT model, task, 2 * count(*) FILTER (label AND prediction) / nullif(2 * count(*) FILTER (label AND prediction) + count(*) FILTER (label <> prediction), 0)::DOUBLE AS f1 FROM c GROUP BY 1, 2)
 SELECT model, coalesce(max(f1) FILTER (task = 'NLI'), 0) AS "NLI", coalesce(max(f1) FILTER (task = 'Question-Answering'), 0) AS "Question-Answering", 0.0::DOUBLE AS "Summarization" FROM f GROUP BY 1""")
def model_table(spark, d):
    df = plans._parsed(spark, d).withColumn("task", F.when(F.col("event_id") % 3 == 0, "NLI").otherwise("Question-Answering"))
    return V.f1_table({"one": df, "two": df.filter("task = 'NLI'")}, ["NLI", "Question-Answering", "Summarization"])


@query("""WITH b AS (SELECT event_id, user_id, -(1 + event_id % 4) / 2.0::DOUBLE AS beam, 1.0::DOUBLE * (event_id % 2) + 0.5 * (event_id % 3) + 0.25 * (event_id % 5) AS boost FROM events),
 s AS (SELECT *, exp(boost) / sum(exp(boost)) OVER (PARTITION BY user_id) AS soft FROM b) SELECT event_id, round(ln(0.6 * exp(beam) + 0.4 * (soft - min(soft) OVER (PARTITION BY user_id))), 9) AS mixed FROM s""")
def beam_mix(spark, d):
    e = F.col("event_id")
    df = table(spark, d, "events").select("event_id", "user_id", (-(1 + e % 4) / 2.0).alias("beam"), V.boost(e % 2, e % 3, e % 5, (1.0, 0.5, 0.25)).alias("boost"))
    return V.rerank(df, "user_id", "beam", "boost", (0.6, 0.4)).select("event_id", F.round("mixed", 9).alias("mixed"))


_GRAMS = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


@query(f"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' of ' || p_type), '[a-z0-9]+') AS x, regexp_extract_all(lower(p_name || ' or ' || p_name), '[a-z0-9]+') AS y FROM part), b AS (SELECT p_partkey, {_GRAMS.format(w="x")} AS x, {_GRAMS.format(w="y")} AS y FROM w)
 SELECT p_partkey, round(list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda z: z = g)), len(list_filter(y, lambda z: z = g)))))::DOUBLE / greatest(len(x), 1), 9) AS recall FROM b""")
def groundedness(spark, d):
    """ROUGE-2 recall of a text about a note, without stemming."""
    note, said = F.concat_ws(" of ", "p_name", "p_type"), F.concat_ws(" or ", "p_name", "p_name")
    return table(spark, d, "part").select("p_partkey", F.round(scores.rouge(note, said, 2, stemmed=False)["recall"], 9).alias("recall"))


@query("""SELECT doc_id, source, 'said ' || length('<|system|>Summarise the user''s note in at most 250 words and write nothing else.\n<|user|>' || text) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents
 WHERE source IN ('src1', 'src2') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) WHERE r <= 20 AND n_chars <= 3000""")
def evaluator_rows(spark, d):
    rows = X.evaluator_rows(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source", ["src1", "src2"], ["doc_id"], F.col("n_chars"), 3000, 20)
    got = X.summarised(rows.select("doc_id", "source", "text"), "text", lambda: G.blocking(lambda p: f"said {len(p)}"), "summary")
    return got.select("doc_id", "source", "summary")


@query("""WITH e AS (SELECT *, ts::TIMESTAMP AS t, lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(CASE WHEN before IS NULL OR t >= before + INTERVAL '6 hours' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS nr FROM e)
 SELECT user_id, min(t) AS start, max(t) + INTERVAL '6 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, nr""")
def user_sessions(spark, d):
    got = streaming.sessions(table(spark, d, "events"), "ts", "6 hours", "10 minutes", "user_id")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_upserts(spark, d):
    """The newest event of every user, from a stream of two files that are merged one after the other."""
    path = f"{storage.root(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for half in (1, 0):
        events.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        streaming.merging(stream, f"{path}/out", f"{path}/checkpoint", "user_id", "event_id").awaitTermination()
    return streaming.newest(spark, f"{path}/out").select("user_id", "event_type", "event_id")
