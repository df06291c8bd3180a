"""Readers and writers on the shared folder: every query writes, reads back, and returns what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import contracts, sources, storage
from ..operators import corpus as C
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import shards as G
from ..sources import owl
from . import query, sql_over, table


def _folder(spark, name: str) -> str:
    return f"{storage.root(spark)}/{name}-{uuid.uuid4().hex}"


_ODD = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' WHEN c_custkey % 7 = 0 THEN concat('two', chr(10), 'lines, \"quoted\"') ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE c_mktsegment END AS segment, c_custkey AS `Unnamed: 0` FROM customer"


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN concat('two', chr(10), 'lines, \"quoted\"') ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def csv_round_trip(spark, d):
    path = _folder(spark, "t") + ".csv"
    sources.write_csv(sql_over(spark, d, _ODD, "customer"), path)
    untyped = sources.read_csv(spark, path)
    if "Unnamed: 0" in untyped.columns:
        raise ValueError("index columns are dropped")
    return sources.read_any(spark, path, schema="c_custkey long, name string, segment string")


@query("SELECT event_id, event_type, props FROM events")
def json_lines_scan(spark, d):
    path = _folder(spark, "t") + ".jsonl"
    table(spark, d, "events").select("event_id", "event_type", "props").write.json(path)
    return sources.read_any(spark, path, schema="event_id long, event_type string, props string")


@query("""WITH s AS (SELECT doc_id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM documents))
 SELECT 'some' AS kind, doc_id, split FROM s WHERE split IN ('train', 'test') UNION ALL SELECT 'all', doc_id, split FROM s""")
def split_scan(spark, d):
    path = _folder(spark, "splits")
    sources.write_split(C.split(table(spark, d, "documents"), "doc_id"), path)
    read = lambda kind, splits: sources.read_any(spark, path, splits=splits).select(F.lit(kind).alias("kind"), "doc_id", "split")
    return read("some", ["train", "test"]).unionByName(read("all", None))


@query("SELECT 'positive' AS side, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 'negative', doc_id FROM labels WHERE quality <> 1")
def factual_outputs(spark, d):
    path = _folder(spark, "factual")
    sources.write_factual(table(spark, d, "labels").withColumn("factual", F.col("quality") == 1), path)
    read = lambda side: spark.read.parquet(f"{path}/{side}").select(F.lit(side).alias("side"), "doc_id")
    return read("positive").unionByName(read("negative"))


@query("SELECT 1 AS step, n_nationkey AS k FROM nation UNION ALL SELECT 2, n_nationkey FROM nation UNION ALL SELECT 3, r_regionkey FROM region")
def write_once(spark, d):
    path = _folder(spark, "once")
    nation, region = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    out = None
    for step, df, overwrite in ((1, nation, False), (2, region, False), (3, region, True)):
        sources.write_once(df, path, overwrite)
        now = storage.table(spark, spark.read.parquet(path).select(F.lit(step).alias("step"), "k"), "step")
        out = now if out is None else out.unionByName(now)
    return out


@query("SELECT lower(replace(replace(c_mktsegment, ' ', '_'), '/', '_')) || '_x' AS domain_slug, count(*) AS n FROM customer GROUP BY 1")
def domain_files(spark, d):
    path = _folder(spark, "domains")
    sources.write_domains(table(spark, d, "customer").withColumn("domain", F.concat("c_mktsegment", F.lit("/X"))), path)
    return spark.read.parquet(path).groupBy("domain_slug").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c AS config_name, try AS attempt, try = 1 AS wrote, (SELECT count(*) FROM nation) AS n FROM (VALUES ('hps'), ('pn'), ('normal')) z(c), (VALUES (1), (2)) t(try)")
def config_results(spark, d):
    path, nation = _folder(spark, "configs"), table(spark, d, "nation")
    names = [r.config_name for r in X.configs(spark, ["hps", "pn", "normal"]).collect()]
    rows = [(name, attempt, sources.write_config_result(nation, path, name)) for attempt in (1, 2) for name in names]
    counts = spark.read.parquet(path).groupBy("config_name").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(rows, "config_name string, attempt int, wrote boolean").join(counts, "config_name")


_CONFIGURED = "(['hps', 'hp', 'hs', 'ps', 'h', 'p', 's', 'pn', 'beam', 'normal'])[event_id % 10 + 1]"


@query(f"""WITH e AS (SELECT {_CONFIGURED} AS config_name, count(*) AS n FROM events GROUP BY 1)
 SELECT config_name, n, (config_name[1] = 'h')::INT::DOUBLE AS h, (config_name IN ('hps', 'hp', 'ps', 'p', 'pn'))::INT::DOUBLE AS p, (config_name IN ('hps', 'hs', 'ps', 's'))::INT::DOUBLE AS s, config_name NOT IN ('pn', 'beam', 'normal') AS uses_context,
 CASE config_name WHEN 'beam' THEN 'beam' WHEN 'normal' THEN 'greedy' ELSE 'ontology' END AS search, CASE config_name WHEN 'normal' THEN 1 ELSE 10 END AS beams, CASE config_name WHEN 'normal' THEN 1 ELSE 2 END AS beam_groups,
 2048 AS max_length, 128 AS max_new_tokens, 5 AS window_size, 1 AS kept, 1.0::DOUBLE AS diversity_penalty, 0.5::DOUBLE AS model_weight, 0.5::DOUBLE AS boost_weight FROM e""")
def decoding_configs(spark, d):
    """How many events each configuration decodes, and with what."""
    names = F.array(*map(F.lit, X.CONFIGS))
    asked = table(spark, d, "events").groupBy(F.get(names, (F.col("event_id") % 10).cast("int")).alias("config_name")).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(X.configs(spark, full=True), "config_name")


@query("SELECT e.event_type AS concept, t.n AS batch, count(*) AS n FROM events e, (VALUES (1), (2)) t(n) GROUP BY 1, 2")
def scoring_log(spark, d):
    path = _folder(spark, "log")
    for n in (1, 2):
        sources.append_log(table(spark, d, "events").select(F.col("event_type").alias("concept"), F.lit(n).alias("batch")), path)
    return spark.read.parquet(path).groupBy("concept", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def stored_without_text(spark, d):
    path = _folder(spark, "narrow")
    sources.write_without(table(spark, d, "documents"), path, "text")
    return contracts.validate(spark.read.parquet(path), ("doc_id", "lang", "source", "n_chars"))


@query("SELECT user_id, event_id, event_type FROM events")
def dict_table(spark, d):
    """Rows from one dictionary of lists for each user."""
    own = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    lists = table(spark, d, "events").groupBy("user_id").agg(own.alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"))
    return sources.from_column_dicts(lists, ["event_id", "event_type"])


_HEAD = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:skos="http://www.w3.org/2004/02/skos/core#">'
_HAS = """'<owl:Restriction><owl:onProperty rdf:resource="http://x/has"/><owl:someValuesFrom rdf:resource="http://x/p', k - 1, '"/></owl:Restriction>'"""
_ELEMENT = f"""concat('<owl:Class rdf:about="http://x/p', k, '"><rdfs:label xml:lang="en">', p_name, '</rdfs:label><rdfs:subClassOf rdf:resource="http://x/b', p_size % 7, '"/>', CASE k % 4
 WHEN 0 THEN concat('<owl:equivalentClass><owl:Class><owl:intersectionOf rdf:parseType="Collection"><rdf:Description rdf:about="http://x/s', p_size, '"/>', {_HAS}, '</owl:intersectionOf></owl:Class></owl:equivalentClass>')
 WHEN 1 THEN concat('<owl:equivalentClass><owl:Class><owl:unionOf rdf:parseType="Collection"><owl:Class rdf:about="http://x/s', p_size, '"/>', {_HAS}, '</owl:unionOf></owl:Class></owl:equivalentClass>')
 WHEN 2 THEN concat('<rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/g"/><owl:someValuesFrom>', {_HAS}, '</owl:someValuesFrom></owl:Restriction></rdfs:subClassOf>')
 ELSE '<!-- <owl:Class rdf:about="http://x/none"> --><owl:equivalentClass><owl:Class><owl:intersectionOf/></owl:Class></owl:equivalentClass>' END, '</owl:Class>')"""


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_size FROM part) SELECT 'concept' AS relation, 'p' || k AS id, p_name AS text, '' AS target FROM p UNION ALL SELECT 'edge', 'p' || k, '0', 'b' || p_size % 7 FROM p UNION ALL SELECT 'edge', 'p' || k, '1', 's' || p_size FROM p WHERE k % 4 < 2
 UNION ALL SELECT CASE k % 4 WHEN 0 THEN 'and' WHEN 1 THEN 'or' ELSE 'res_simple' END, 'p' || k, 'has', coalesce(q.p_name, 'p' || (k - 1)) FROM p LEFT JOIN part q ON q.p_partkey = k - 1 WHERE k % 4 < 3 UNION ALL SELECT 'unknown', 'p' || k, 'intersectionOf', '' FROM p WHERE k % 4 = 3""")
def ontology_cache(spark, d):
    """An ontology file made from the parts, converted once from ranges of 100,000 bytes and read twice."""
    path = _folder(spark, "owl")
    parts = table(spark, d, "part").selectExpr("p_partkey AS k", "p_name", "p_size").selectExpr("k", f"{_ELEMENT} AS value")
    ends = spark.createDataFrame([(-1, _HEAD), (1 << 62, "</rdf:RDF>")], "k long, value string")
    parts.unionByName(ends).orderBy("k").select("value").coalesce(1).write.text(path)  # an ontology is one file: sorted by many tasks, put together by one
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    file = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)[0].getPath().toString()
    for _ in range(2):
        concepts, edges, properties = owl.cache(spark, file, f"{path}-cache", range_bytes=100_000)
    row = lambda df, kind, a, b, c: df.select(F.lit(kind).alias("relation") if isinstance(kind, str) else kind.alias("relation"), F.col(a).alias("id"), b.cast("string").alias("text"), c.alias("target"))
    entry = F.map_entries("labels")[0]
    got = row(concepts, "concept", "id", F.col("label"), F.lit("")).unionByName(row(edges, "edge", "child", F.col("parent_pos"), F.col("parent")))
    got = got.unionByName(row(properties, F.col("property_type"), "concept_id", entry["key"], entry["value"]))
    return got.unionByName(row(spark.read.parquet(f"{path}-cache/unknown"), "unknown", "concept_id", F.substring_index("tag", "}", -1), F.lit("")))


@query("""WITH c AS (SELECT c_custkey, [('data', 'path', '/x/' || c_custkey), ('data', 'n', CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR ELSE '3' END), ('model', 'name', c_mktsegment)] AS v FROM customer)
 SELECT c_custkey, z[1] AS section, z[2] AS name, z[3] AS value, (2 + (c_custkey % 3 = 0)::INT)::INT AS n_warnings FROM (SELECT c_custkey, unnest(v) AS z FROM c)""")
def config_values(spark, d):
    """A configuration of every customer, with keys and sections that nobody knows, over defaults."""
    text = F.format_string('{"data": {"path": "/x/%d", "odd": 1%s}, "model": {"name": "%s"%s}, "more": {}}', "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.format_string(', "n": %d', "c_nationkey")).otherwise(""), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, ', "size": 2').otherwise(""))
    return sources.parsed_configs(table(spark, d, "customer").select("c_custkey", text.alias("text")), "text", {"data": {"path": None, "n": 3}, "model": {"name": None}}, (("data", "path"),))


@query("""WITH s AS (SELECT event_id // 300 AS shard_id, count(*) AS total, count(*) FILTER (event_id % 3 <> 0) AS done FROM events GROUP BY 1)
 SELECT shard_id, printf('shard %d: %d of %d (%.1f %%)', shard_id, done, total, done * 100.0 / total) AS line FROM s""")
def progress_report(spark, d):
    work, results = _work(spark, d)
    return G.report(G.progress(work, results, 300))


def _work(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("_pos"), "event_type")
    return events, events.filter("_pos % 3 <> 0").select("_pos", F.col("event_type").alias("result"))


@query("SELECT event_id AS _pos, event_id // 300 IN (0, 2) OR event_id % 3 = 0 AS open, CASE WHEN event_id // 300 NOT IN (0, 2) AND event_id % 3 <> 0 AND event_type <> 'click' THEN event_type END AS result FROM events")
def repaired_shards(spark, d):
    work, results = _work(spark, d)
    kept, left = G.repair(work, results, [0, 2], 300)
    cleared = G.clear(kept, F.col("result") == "click")
    return work.select("_pos").join(left.select("_pos", F.lit(True).alias("open")), "_pos", "left").join(cleared, "_pos", "left").select("_pos", F.coalesce("open", F.lit(False)).alias("open"), "result")


@query("SELECT DISTINCT event_id // 300 AS shard_id FROM events WHERE event_id % 3 = 0 AND event_id // 300 < 2")
def next_shards(spark, d):
    work, results = _work(spark, d)
    return G.incomplete(G.progress(work, results, 300), 2).select("shard_id")


@query("SELECT event_id AS _pos, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'asked ' || event_type END AS result FROM events WHERE event_id % 3 <> 0 OR event_id // 300 IN (0, 1)")
def shard_inference(spark, d):
    work, results = _work(spark, d)
    return G.infer_shards(work, results, "event_type", lambda: G.blocking(lambda p: f"asked {p}"), [0, 1], 300)


@query("SELECT event_id AS _pos, CASE WHEN event_type = 'click' THEN NULL ELSE 'system+user:' || event_type END AS output FROM events")
def chat_provider(spark, d):
    def ask(messages):
        if messages[-1]["content"] == "click":
            raise RuntimeError("down")
        return "+".join(m["role"] for m in messages) + ":" + messages[-1]["content"]

    return G.infer(_work(spark, d)[0], "event_type", lambda: G.chatting(ask, "Be brief.")).select("_pos", "output")


@query("SELECT event_id AS _pos, 'async ' || event_type AS output FROM events")
def concurrent_calls(spark, d):
    async def one(p):
        return f"async {p}"

    return G.infer(_work(spark, d)[0], "event_type", lambda: G.concurrent(one)).select("_pos", "output")


@query("SELECT event_id, round(1.0::DOUBLE / length(event_type), 9) AS short, round(1 - 1.0::DOUBLE / length(event_type), 9) AS long FROM events")
def class_probabilities(spark, d):
    model = lambda: lambda texts: [[1 / len(t), 1 - 1 / len(t)] for t in texts]
    got = G.classify(table(spark, d, "events").select("event_id", "event_type"), "event_type", model, ["short", "long"])
    return got.select("event_id", F.round(F.col("probabilities")["short"], 9).alias("short"), F.round(F.col("probabilities")["long"], 9).alias("long"))


_REVIEW = """SELECT conv_id, turn, text, CASE WHEN turn % 4 = 3 THEN 'N/A' ELSE concat('v', turn % 3) END AS value, concat('k', turn % 5) AS label FROM conversations WHERE text IS NOT NULL"""
_SUMMED = "SELECT DISTINCT conv_id, m.method, 'ECG' AS domain, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 5 = 0 THEN NULL ELSE concat('sum ', conv_id) END AS summary FROM conversations, (VALUES ('normal'), ('beam')) m(method)"
_SAMPLE_SQL = f"""r AS ({_REVIEW}), t AS (SELECT conv_id, string_agg('### Clinical note ' || i || '\n' || text, '\n\n' ORDER BY i) AS notes FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM r) GROUP BY 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn // 2, lower(trim(value)) ORDER BY turn) AS n FROM r WHERE value <> 'N/A'),
 e AS (SELECT conv_id, turn // 2 AS note, string_agg('- ' || label || ' : ' || value || '\n', '' ORDER BY turn) AS s FROM k WHERE n = 1 GROUP BY 1, 2),
 g AS (SELECT conv_id, string_agg('### Clinical note ' || i || '\n' || s, '\n' ORDER BY i) AS structured FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY note) AS i FROM e) GROUP BY 1),
 sample AS (SELECT md5(concat_ws(chr(1), z.conv_id::VARCHAR, method, domain)) AS id, notes, z.conv_id AS admission_id, coalesce(structured, 'N/A') AS structured_summary, summary, method, domain FROM ({_SUMMED}) z JOIN t ON t.conv_id = z.conv_id LEFT JOIN g ON g.conv_id = z.conv_id WHERE length(summary) > 0)"""


def _sample(spark, d):
    rows = sql_over(spark, d, _REVIEW, "conversations")
    entries = rows.select("conv_id", F.explode(F.array(F.lit("normal"), F.lit("beam"))).alias("method"), F.lit("ECG").alias("domain"), F.floor(F.col("turn") / 2).alias("note"), F.col("turn").alias("pos"), "label", "value")
    return E.review_sample(rows, entries.withColumnRenamed("pos", "turn"), sql_over(spark, d, _SUMMED, "conversations"), "conv_id", "note", "turn", "text", "label", "value")


@query(f"WITH {_SAMPLE_SQL} SELECT id, md5(notes) AS notes_md5, admission_id, structured_summary, summary, method, domain FROM sample")
def review_sample(spark, d):
    return contracts.validate(_sample(spark, d), "human_evaluation").select("id", F.md5("notes").alias("notes_md5"), "admission_id", "structured_summary", "summary", "method", "domain")


@query(f"""WITH {_SAMPLE_SQL} SELECT domain, id, sheet, row, md5(text) AS text_md5 FROM (SELECT domain, id, 'Notes' AS sheet, 0 AS row, notes AS text FROM sample UNION ALL SELECT domain, id, 'Summary', 0, summary FROM sample UNION ALL SELECT domain, id, 'Structured summary', 0, structured_summary FROM sample
 UNION ALL SELECT domain, id, 'Evaluation', 0, 'Right? (0-5)' FROM sample UNION ALL SELECT domain, id, 'Evaluation', 1, 'Whole? (0-5)' FROM sample
 UNION ALL SELECT domain, id, 'Domain concepts', 1, 'Nation 3 (n3)' FROM sample UNION ALL SELECT domain, id, 'Domain concepts', 2, 'Nation 7 (n7)' FROM sample)""")
def review_sheets(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("Nation "), "n_nationkey").alias("label"))
    ranked = spark.createDataFrame([("ECG", "n3", 1), ("ECG", "n7", 2), ("Other", "n1", 1)], "domain string, concept_id string, rank int")
    sheets = E.review_sheets(_sample(spark, d), ranked, names, ["Right?", "Whole?"])
    path = _folder(spark, "review")
    sheets.write.partitionBy("domain").parquet(path)
    return spark.read.parquet(path).select("domain", "id", "sheet", "row", F.md5("text").alias("text_md5"))
