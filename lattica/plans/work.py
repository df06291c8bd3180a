"""Shards, results and model calls with a deterministic stand-in for a model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import storage
from ..operators import results as R
from ..operators import shards as G
from ..streaming import event_windows
from . import query, table


def _work(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("_pos"), "event_type", "props")


def _results(spark, d):
    return table(spark, d, "events").filter("event_id % 3 <> 0").select(F.col("event_id").alias("_pos"), F.create_map(F.lit("t"), F.col("event_type")).alias("result"))


@query("""WITH n AS (SELECT count(*) AS n FROM events) SELECT k AS shard_id, k * 300 AS shard_start, least(n, (k + 1) * 300) AS shard_end FROM n, (SELECT unnest(range(0, (SELECT ceil(count(*) / 300.0)::BIGINT FROM events))) AS k)""")
def shard_bounds(spark, d):
    return G.bounds_table(spark, table(spark, d, "events").count(), 300)


@query("SELECT event_id // 300 AS shard_id, count(*) AS total, count(*) FILTER (event_id % 3 <> 0) AS done, count(*) FILTER (event_id % 3 = 0) AS pending, count(*) FILTER (event_id % 3 <> 0) * 100.0::DOUBLE / count(*) AS percent FROM events GROUP BY 1")
def shard_progress(spark, d):
    return G.progress(_work(spark, d), _results(spark, d), 300)


@query("SELECT event_id AS _pos, event_type FROM events WHERE event_id % 3 = 0")
def unprocessed_rows(spark, d):
    return G.unprocessed(_work(spark, d), _results(spark, d)).select("_pos", "event_type")


@query("SELECT coalesce(min(event_id) FILTER (event_id >= 100), count(*)) AS resume_at FROM events")
def resume_index(spark, d):
    return G.resume_index(_work(spark, d).withColumn("out", F.when(F.col("_pos") < 100, "x")), "out")


@query("""SELECT event_id AS _pos, event_type, CASE WHEN event_id % 3 <> 0 THEN '{"t":"' || event_type || '"}' END AS normal FROM events""")
def merge_results(spark, d):
    return G.merge(_work(spark, d), _results(spark, d), "normal").select("_pos", "event_type", "normal")


@query("SELECT event_id AS _pos, CASE WHEN length(event_type) <= 6 THEN 'echo ' || event_type END AS output FROM events")
def model_answers(spark, d):
    echo = lambda: G.retrying(lambda prompts: [f"echo {p}" for p in prompts])
    return G.infer(_work(spark, d).select("_pos", "event_type"), "event_type", echo, most_length=6).select("_pos", "output")


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM part), t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part)
 SELECT p_partkey, term, (i - 1)::INT AS start FROM (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w) JOIN t ON word = term""")
def annotate_terms(spark, d):
    part = table(spark, d, "part")
    terms = part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("term")).distinct().withColumn("concept_id", F.col("term"))
    return G.annotate(part, "p_name", terms, "p_partkey").select("p_partkey", "term", "start")


_W = r"[\p{L}\p{M}\p{N}_]"
_TERMS = rf"""SELECT doc_id, k, CASE k WHEN 0 THEN '(' || w[1] || ' ' || w[2] || ')' WHEN 1 THEN upper(w[2]) || '-' || w[3] || ', ' || w[4] ELSE w[1] || ' "' || w[2] || '" ' || w[3] || '.' END AS term
 FROM (SELECT doc_id, regexp_extract_all(text, '{_W}+') AS w FROM documents WHERE text IS NOT NULL), (SELECT unnest([0, 1, 2]) AS k) WHERE len(w) >= 4"""


@query(rf"""WITH RECURSIVE g AS ({_TERMS}), t AS (SELECT min(doc_id) AS concept_id, term, array_to_string(list_transform(regexp_extract_all(term, '{_W}+'), lambda x: lower(x)), ' ') AS phrase FROM g GROUP BY term),
 p AS (SELECT doc_id, regexp_extract_all(text, '{_W}+|[^{_W[1:]}+') AS ps FROM documents), q AS (SELECT doc_id, list_transform(ps, lambda x: length(x)) AS sizes, list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(ps[i], '^{_W}')) AS own, ps FROM p),
 d AS (SELECT doc_id, sizes, own, list_transform(own, lambda i: lower(ps[i])) AS w FROM q),
 a AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n)),
 h AS (SELECT doc_id, s, max(n) AS n FROM a WHERE phrase IN (SELECT phrase FROM t) GROUP BY 1, 2),
 o AS (SELECT h.doc_id, h.s, h.n, z.s AS nxt FROM h ASOF LEFT JOIN (SELECT doc_id, s FROM h) z ON h.doc_id = z.doc_id AND h.s + h.n <= z.s),
 r(doc_id, s, n, nxt) AS (SELECT * FROM o WHERE (doc_id, s) IN (SELECT (doc_id, min(s)) FROM o GROUP BY doc_id) UNION ALL SELECT o.doc_id, o.s, o.n, o.nxt FROM r JOIN o ON o.doc_id = r.doc_id AND o.s = r.nxt)
 SELECT r.doc_id, t.concept_id, t.term, (r.s - 1)::INT AS start, r.n::INT AS n_words, coalesce(list_sum(sizes[1:own[r.s] - 1]), 0)::INT AS start_char, list_sum(sizes[1:own[r.s + r.n - 1]])::INT AS end_char
 FROM r JOIN d USING (doc_id) JOIN a ON a.doc_id = r.doc_id AND a.s = r.s AND a.n = r.n JOIN t ON t.phrase = a.phrase""")
def text_mentions(spark, d):
    """The openings of all documents as terms with punctuation, overlapping each other, looked for in all documents."""
    docs = table(spark, d, "documents")
    return G.annotate(docs, "text", _openings(docs), "doc_id", overlapping=False)


def _openings(docs):
    # Only up to the fourth word: no text is split as a whole.
    w = F.regexp_extract_all(F.regexp_extract("text", f"^[^{_W[1:]}*+({_W}++[^{_W[1:]}++){{3}}{_W}++", 0), F.lit(f"{_W}+"), F.lit(0))
    at = lambda i: F.get("w", F.lit(i - 1))
    made = F.array(F.concat(F.lit("("), at(1), F.lit(" "), at(2), F.lit(")")), F.concat(F.upper(at(2)), F.lit("-"), at(3), F.lit(", "), at(4)), F.concat(at(1), F.lit(' "'), at(2), F.lit('" '), at(3), F.lit(".")))
    terms = docs.filter("text is not null").select("doc_id", w.alias("w")).filter(F.size("w") >= 4).select("doc_id", F.explode(made).alias("term"))
    return terms.groupBy("term").agg(F.min("doc_id").alias("concept_id"))


@query("SELECT time_bucket(INTERVAL '1 hour\', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_hours(spark, d):
    got = event_windows(table(spark, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def _changed(spark, d):
    """A results table of all events: first answers, answers put over them, cleared ones, two broken shards and their new answers, compacted on the way."""
    path = f"{storage.root(spark)}/results-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("event_id").alias("_pos"), F.col("event_type").alias("result"), F.create_map(F.lit("user"), "user_id").alias("more"))
    R.create(spark, path, events.schema, "_pos")
    R.upsert(events.filter("_pos % 3 <> 0"), path, writer="first", batch=0)
    R.upsert(events.filter("_pos % 5 = 0").withColumn("result", F.concat("result", F.lit("!"))), path)
    R.clear(spark, path, F.col("result") == "click")
    R.compact(spark, path)
    R.upsert(events.filter("_pos % 3 <> 0"), path, writer="first", batch=0)  # runs again: counts once
    R.repair(spark, path, spark.range(0, 3, 2).withColumnRenamed("id", "shard_id"), 300)
    R.upsert(events.filter("_pos < 300 AND _pos % 7 = 0").withColumn("result", F.upper("result")), path)
    return path


_CHANGED = """SELECT event_id AS _pos, CASE WHEN event_id < 300 AND event_id % 7 = 0 THEN upper(event_type) WHEN event_id // 300 IN (0, 2) THEN NULL WHEN event_id % 5 = 0 THEN event_type || '!' WHEN event_id % 3 <> 0 AND event_type <> 'click' THEN event_type END AS result, user_id FROM events"""


@query(f"SELECT _pos, result, user_id FROM ({_CHANGED}) WHERE result IS NOT NULL")
def results_table(spark, d):
    return R.read(spark, _changed(spark, d)).select("_pos", "result", F.col("more")["user"].alias("user_id"))


@query(f"SELECT _pos // 300 AS shard_id, count(*) AS total, count(result) AS done, count(*) - count(result) AS pending, count(result) * 100.0::DOUBLE / count(*) AS percent FROM ({_CHANGED}) GROUP BY 1")
def results_progress(spark, d):
    """Progress of the shards of a results table that was changed in place."""
    return G.progress(_work(spark, d), R.read(spark, _changed(spark, d)), 300)
