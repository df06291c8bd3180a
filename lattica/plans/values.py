"""Rows and values: filters, sorts, unions, pairs of rows, samples and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import contracts, sources
from ..functions import text as T
from ..functions.trees import leaves
from ..operators import corpus as C
from ..operators import pairs as P
from ..operators import stats as S
from ..operators import verdicts as V
from . import CHOICE, query, sql_over, table


@query("SELECT event_id, md5(concat_ws(chr(1), event_type, event_id::VARCHAR, coalesce(CASE WHEN event_id % 3 = 0 THEN 'true' END, chr(2)))) AS id FROM events")
def unique_ids(spark, d):
    return table(spark, d, "events").select("event_id", T.unique_id(F.col("event_type"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "true")).alias("id"))


@query("SELECT event_id, event_type || '!' AS event_type, length(event_type) AS n_chars, props FROM events")
def merged_columns(spark, d):
    got = C.updated(table(spark, d, "events"), {"event_type": F.concat("event_type", F.lit("!")), "n_chars": F.length("event_type")})
    return got.select("event_id", "event_type", F.col("n_chars").cast("long").alias("n_chars"), "props")


@query("""WITH c AS (SELECT event_id, (event_id % 97)::VARCHAR AS k, (event_id % 89)::VARCHAR AS other FROM events), n AS (SELECT k, count(*) AS n FROM c GROUP BY 1 HAVING count(*) < (SELECT count(*) // 97 + 1 FROM events)),
 r AS (SELECT 'Others (' || string_agg(k, ', ' ORDER BY k) || ')' AS label FROM n) SELECT event_id, CASE WHEN k IN (SELECT k FROM n) THEN label ELSE k END AS k, CASE WHEN other IN (SELECT k FROM n) THEN label ELSE other END AS other FROM c LEFT JOIN r ON true""")
def rare_everywhere(spark, d):
    events = table(spark, d, "events")
    df = events.select("event_id", (F.col("event_id") % 97).cast("string").alias("k"), (F.col("event_id") % 89).cast("string").alias("other"))
    return S.collapse_rare(df, "k", events.count() // 97 + 1, ["k", "other"])


_RARE = "WITH c AS (SELECT event_id, (event_id % 97)::VARCHAR AS k, (event_id % 89)::VARCHAR AS other FROM events), n AS (SELECT k FROM c GROUP BY 1 HAVING count(*) < (SELECT count(*) // 97 + 1 FROM events))"


def _coded(spark, d):
    events = table(spark, d, "events")
    df = events.select("event_id", (F.col("event_id") % 97).cast("string").alias("k"), (F.col("event_id") % 89).cast("string").alias("other"))
    return S.coded_rare(df, "k", events.count() // 97 + 1, ["k", "other"])


@query(f"{_RARE} SELECT event_id, k, other, CASE WHEN k IN (SELECT k FROM n) THEN 0 END AS k_label, CASE WHEN other IN (SELECT k FROM n) THEN 0 END AS other_label FROM c")
def rare_codes(spark, d):
    """Rare categories by the number of their label, which is stored once."""
    return _coded(spark, d)[0]


@query(f"{_RARE} SELECT 0 AS label_id, row_number() OVER (ORDER BY k) - 1 AS nr, k AS name FROM n")
def rare_names(spark, d):
    """The label that ``rare_codes`` refers to."""
    return _coded(spark, d)[1]


_GAPS = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS category, CASE WHEN event_id % 6 = 0 THEN NULL ELSE props END AS statement FROM events"


@query(f"SELECT event_id, category FROM ({_GAPS}) WHERE category IS DISTINCT FROM 'click'")
def differs_filter(spark, d):
    return sql_over(spark, d, _GAPS, "events").filter(T.differs(F.col("category"), "click")).select("event_id", "category")


@query(f"SELECT count(*) AS given, count(statement) AS kept, count(*) - count(statement) AS dropped, (SELECT sum(event_id) FROM ({_GAPS}) WHERE statement IS NOT NULL)::BIGINT AS ids FROM ({_GAPS})")
def counted_filter(spark, d):
    kept, seen = C.counted(sql_over(spark, d, _GAPS, "events"), F.col("statement").isNotNull())
    return seen.join(kept.agg(F.sum("event_id").alias("ids")))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 800")
def within_length(spark, d):
    return C.within_length(table(spark, d, "documents"), F.col("n_chars"), 800).select("doc_id", "n_chars")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Question-Answering' WHEN 'de' THEN 'NLI' END AS task FROM documents")
def tasks(spark, d):
    source = F.when(F.col("lang") == "en", "medqa").when(F.col("lang") == "de", "mednli").otherwise("other")
    return V.by_task(table(spark, d, "documents").withColumn("source", source)).select("doc_id", "task")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, props, event_id) - 1 AS place FROM events")
def ordered_statements(spark, d):
    return sources.with_pos(table(spark, d, "events"), ["event_type", "props", "event_id"]).select("event_id", F.col("_pos").alias("place"))


@query("SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '|42'), event_id) - 1 AS place FROM events")
def shuffled_rows(spark, d):
    return sources.with_pos(C.shuffled(table(spark, d, "events"), ["event_id"]), ["shuffle_key", "event_id"]).select("event_id", F.col("_pos").alias("place"))


@query("SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events) WHERE place >= 40 AND place < 90")
def slice_rows(spark, d):
    placed = sources.with_pos(table(spark, d, "events"), ["value", "event_id"])
    return C.sliced(placed, 40, 90).select("event_id", F.col("_pos").alias("place"))


@query("SELECT 'c' AS kind, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier UNION ALL SELECT 'p', p_partkey, p_name FROM part")
def same_schema_union(spark, d):
    one = lambda n, k: table(spark, d, n).select(F.lit(k).alias("kind"), F.col(f"{k}_{'part' if k == 'p' else 'cust' if k == 'c' else 'supp'}key").alias("k"), F.col(f"{k}_name").alias("name"))
    return contracts.union_all([one("customer", "c"), one("supplier", "s"), one("part", "p")])


@query("""WITH a AS (SELECT DISTINCT event_id % 50 AS k FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT event_id % 50 AS k FROM events WHERE event_id % 5 = 0)
 SELECT 'both' AS kind, k FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT 'only', k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'any', k FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def key_sets(spark, d):
    pick = lambda n: table(spark, d, "events").filter(F.col("event_id") % n == 0).select((F.col("event_id") % 50).alias("k")).distinct()
    a, b, tag = pick(2), pick(5), lambda df, kind: df.select(F.lit(kind).alias("kind"), "k")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "only")).unionByName(tag(a.union(b).distinct(), "any"))


@query("""SELECT event_id, k.concept_id, CASE m.method WHEN 'greedy' THEN k.v ELSE k.v || ' again' END AS value, m.method FROM (SELECT event_id, unnest(['c1', 'c2']) AS concept_id, unnest([event_type, props]) AS v FROM events) k, (VALUES ('greedy'), ('beam')) m(method)
 WHERE NOT (m.method = 'beam' AND k.event_id % 3 = 0)""")
def rows_of_maps(spark, d):
    m = F.create_map(F.lit("c1"), F.col("event_type"), F.lit("c2"), F.col("props"))
    again = F.when(F.col("event_id") % 3 != 0, F.transform_values(m, lambda k, v: F.concat(v, F.lit(" again"))))
    return P.rows_of_maps(table(spark, d, "events").select("event_id", m.alias("normal"), again.alias("beam")), ["event_id"], {"normal": "greedy", "beam": "beam"})


@query("SELECT user_id, string_agg(event_type || '=' || v, '|' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, arg_max(props, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def maps_of_rows(spark, d):
    got = P.maps_of_rows(table(spark, d, "events"), "user_id", "event_type", "props", "event_id")
    entries = F.array_sort(F.transform(F.map_entries("extraction"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return got.select("user_id", F.array_join(entries, "|").alias("entries"))


_TREES = """SELECT event_id, concat('{"Symptoms": [{"name": "', event_type, '", "site": "s', event_id % 3, '", "odd": 1}, {"site": "', CASE WHEN event_id % 4 = 0 THEN 'None' ELSE 'arm' END, '", "name": "n', event_id % 5, '"}], "visit": {"reason": "r', event_id % 7, '", "name": null}}') AS tree FROM events"""


@query("""WITH x AS (SELECT event_id, event_type, event_id % 4 = 0 AS gone, event_id % 3 AS s, event_id % 5 AS n, event_id % 7 AS r FROM events)
 SELECT event_id, 'symptoms' AS category, 'name' AS concept, event_type AS value, event_type AS concept_reference FROM x UNION ALL SELECT event_id, 'symptoms', 'site', 's' || s, event_type FROM x
 UNION ALL SELECT event_id, 'symptoms', 'site', 'arm', 'arm' FROM x WHERE NOT gone UNION ALL SELECT event_id, 'symptoms', 'name', 'n' || n, CASE WHEN gone THEN 'n' || n ELSE 'arm' END FROM x UNION ALL SELECT event_id, 'visit', 'reason', 'r' || r, 'None' FROM x""")
def scattered_concepts(spark, d):
    rows = sql_over(spark, d, _TREES, "events").select("event_id", F.explode(leaves(F.col("tree"))).alias("l")).select("event_id", "l.*")
    return P.scatter(rows, "event_id", ["name", "site", "reason"], ["symptoms"]).select("event_id", "category", "concept", "value", "concept_reference")


@query(f"""WITH p AS (SELECT *, {CHOICE.format("event_id::VARCHAR")} AS h FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h % 64, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM p),
 w AS (SELECT *, CASE WHEN n > 1 THEN (place + h % greatest(n - 1, 1) + 1) % n END AS want FROM a)
 SELECT event_id, true AS factual, NULL AS corrupted_value FROM events UNION ALL SELECT w.event_id, false, b.props FROM w LEFT JOIN a b ON b.event_type = w.event_type AND b.place = w.want""")
def corrupted_pairs(spark, d):
    return P.with_corrupted(table(spark, d, "events"), "event_type", "props", ["event_id"], F.col("event_id")).select("event_id", "factual", "corrupted_value")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '42'), event_id) AS r FROM events WHERE event_type = 'click') WHERE r = 1")
def random_row(spark, d):
    return C.random_row(table(spark, d, "events"), "event_id", F.col("event_type") == "click").select("event_id")


@query("""WITH s AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 90 AS train FROM documents WHERE lang IN ('en', 'de')),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM s WHERE train),
 x AS (SELECT doc_id, lang, 'train' AS split FROM r WHERE r <= floor(CASE lang WHEN 'en' THEN 0.5 ELSE 1.0 END * n) UNION ALL SELECT doc_id, lang, 'val' FROM s WHERE NOT train)
 SELECT doc_id, lang, split, row_number() OVER (PARTITION BY split ORDER BY md5(split || '|' || doc_id || '|42'), doc_id) - 1 AS place FROM x""")
def mixed_splits(spark, d):
    df = C.split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", (("train", 90), ("val", 10)))
    pick = lambda s: df.filter(F.col("split") == s).drop("split")
    return C.mixed(pick("train"), pick("val"), "lang", ["doc_id"], {"en": 0.5, "de": 1.0}).select("doc_id", "lang", "split", "place")
