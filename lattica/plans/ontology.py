"""Ontology and domain frequencies over part (two parents each) and the geography of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..operators import dcf as D
from ..operators import extraction as X
from ..operators import ontology as O
from ..operators import reach as R
from ..operators import shards as G
from . import query, sql_over, table

_EDGES = """SELECT concat('p', p_partkey) AS child, concat('t:', p_type) AS parent, 0 AS parent_pos FROM part
 UNION ALL SELECT concat('p', p_partkey), concat('b:', p_brand), 1 FROM part
 UNION ALL SELECT DISTINCT concat('t:', p_type), concat('size', p_size % 3), p_size % 3 FROM part UNION ALL SELECT DISTINCT concat('b:', p_brand), 'brands', 0 FROM part
 UNION ALL SELECT DISTINCT concat('size', p_size % 3), 'root', 0 FROM part UNION ALL SELECT 'brands', 'root', 0
 UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), 0 FROM customer UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 0 FROM nation"""
_UP = f"""e AS ({_EDGES}), u(id, ancestor, path) AS (SELECT child, parent, [parent_pos::INT] FROM e UNION ALL SELECT u.id, e.parent, list_append(u.path, e.parent_pos::INT) FROM u JOIN e ON e.child = u.ancestor),
 f AS (SELECT id, ancestor, min(len(path)) AS depth FROM u GROUP BY 1, 2), g AS (SELECT u.id, u.ancestor, f.depth, min(u.path) AS path FROM u JOIN f ON u.id = f.id AND u.ancestor = f.ancestor AND len(u.path) = f.depth GROUP BY 1, 2, 3),
 up AS (SELECT id, ancestor, depth, row_number() OVER (PARTITION BY id ORDER BY depth, path) AS bfs_pos FROM g)"""


def edges(spark, d):
    for name in ("part", "customer", "nation"):
        table(spark, d, name).createOrReplaceTempView(f"lattica_{name}")
    sql = _EDGES
    for name in ("part", "customer", "nation"):
        sql = sql.replace(f"FROM {name}", f"FROM lattica_{name}")
    return storage.table(spark, spark.sql(sql), "ontology-edges")


_made: dict[tuple, tuple] = {}


def ontology(spark, d):
    """Edges and their closure, made once for a session and the files of the tables as they are, as an ontology's cache is."""
    files = storage.state(spark, *(f"{d}/{name}.parquet" for name in ("part", "customer", "nation")))
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), files)
    if key not in _made:
        e = edges(spark, d)
        _made[key] = (e, O.closure(e))
    return _made[key]


def _up(spark, d):
    return ontology(spark, d)[1]


def _labelled(spark, d):
    """Edges and labels, made once like the closure."""
    files = storage.state(spark, *(f"{d}/{name}.parquet" for name in ("part", "customer", "nation")))
    key = ("labels", spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), files)
    if key not in _made:
        e = edges(spark, d)
        _made[key] = (e, R.labels(e))
    return _made[key]


@query(f"WITH RECURSIVE {_UP} SELECT id, ancestor, depth::INT AS depth, bfs_pos::INT AS bfs_pos FROM up")
def closure(spark, d):
    return _up(spark, d).select("id", "ancestor", "depth", F.col("bfs_pos").cast("int").alias("bfs_pos"))


@query(f"SELECT parent AS id, count(DISTINCT child) AS n_children FROM ({_EDGES}) GROUP BY 1")
def children_count(spark, d):
    return O.children_count(edges(spark, d))


@query(f"WITH RECURSIVE {_UP}, ids AS (SELECT DISTINCT child AS id FROM e UNION SELECT DISTINCT parent FROM e) SELECT id FROM ids WHERE id NOT IN ('brands', 'n3') AND id IN (SELECT id FROM up) AND id NOT IN (SELECT id FROM up WHERE ancestor IN ('brands', 'n3'))")
def branch_filter(spark, d):
    e, up = ontology(spark, d)
    ids = e.select(F.col("child").alias("id")).union(e.select("parent")).distinct()
    return O.branch_filter(ids, "id", up, ["brands", "n3"])


@query(f"WITH RECURSIVE {_UP}, ids AS (SELECT DISTINCT child AS id FROM e UNION SELECT DISTINCT parent FROM e) SELECT id FROM ids WHERE id NOT IN ('brands', 'n3') AND id IN (SELECT id FROM up) AND id NOT IN (SELECT id FROM up WHERE ancestor IN ('brands', 'n3'))")
def labelled_branches(spark, d):
    e, labels = _labelled(spark, d)
    ids = e.select(F.col("child").alias("id")).union(e.select("parent")).distinct()
    return R.branch_filter(ids, "id", labels, ["brands", "n3"])


@query("SELECT DISTINCT concat('p', l_partkey) AS id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def set_filter(spark, d):
    ids = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id"))
    return O.set_filter(ids, "id", table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id")))


_MENTIONS = "SELECT l_returnflag AS domain, concat('p', l_partkey) AS concept_id, l_orderkey * 10 + l_linenumber AS pos FROM lineitem"
_COUNTS = f"""m AS ({_MENTIONS}), c AS (SELECT domain, concept_id, count(*) AS n, min(pos) AS p FROM m GROUP BY 1, 2),
 freq AS (SELECT domain, up.ancestor AS concept_id, sum(n)::DOUBLE AS freq, min((p, bfs_pos)) AS first_pos FROM c JOIN up ON up.id = c.concept_id GROUP BY 1, 2)"""


def _mentions(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("domain"), F.concat(F.lit("p"), "l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_pos"))


@query(f"WITH RECURSIVE {_UP}, {_COUNTS} SELECT domain, concept_id, freq FROM freq")
def ancestor_multiset(spark, d):
    return D.ancestor_counts(_mentions(spark, d), _up(spark, d), ["domain"]).select("domain", "concept_id", "freq")


@query(f"WITH RECURSIVE {_UP}, {_COUNTS} SELECT domain, concept_id, freq FROM freq")
def labelled_counts(spark, d):
    return R.ancestor_counts(_mentions(spark, d), _labelled(spark, d)[1], ["domain"])


_KEPT = "kept AS (SELECT * FROM freq WHERE concept_id NOT IN ('brands') AND concept_id IN (SELECT id FROM up) AND concept_id NOT IN (SELECT id FROM up WHERE ancestor IN ('brands')))"
_ADJ = "na AS (SELECT id, count(*) AS n FROM up GROUP BY 1)"
_DOMAIN = f"""WITH RECURSIVE {_UP}, {_COUNTS}, {_KEPT}, {_ADJ}, t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM kept),
 dcf AS (SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq FROM t LEFT JOIN na ON na.id = t.concept_id WHERE r <= 5)"""


def _frequencies(spark, d):
    return D.domain_frequencies(_mentions(spark, d), _up(spark, d), 5, ["brands"]).select("domain", "concept_id", "freq")


@query(f"{_DOMAIN} SELECT domain, concept_id, freq FROM dcf")
def domain_frequency(spark, d):
    return _frequencies(spark, d)


@query(f"""WITH RECURSIVE {_UP}, {_COUNTS.replace("l_returnflag", "l_suppkey::VARCHAR")}, {_KEPT}, {_ADJ},
 a AS (SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq, first_pos FROM kept LEFT JOIN na ON na.id = kept.concept_id)
 SELECT domain AS note_id, concept_id, freq, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM a) WHERE r <= 3""")
def adjusted_topn(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("note_id"), F.concat(F.lit("p"), "l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_pos"))
    return D.note_concepts(m, _up(spark, d), 3, ["brands"]).select("note_id", "concept_id", "freq", F.col("rank").cast("long").alias("rank"))


@query(f"{_DOMAIN}, mean AS (SELECT concept_id, sum(freq) / 3.0::DOUBLE AS m FROM dcf GROUP BY 1) SELECT domain, concept_id, round(freq - m, 6) AS freq FROM dcf JOIN mean USING (concept_id)")
def dcf_normalise(spark, d):
    return D.normalise(_frequencies(spark, d), 3).withColumn("freq", F.round("freq", 6)).select("domain", "concept_id", "freq")


@query(f"{_DOMAIN} SELECT DISTINCT concept_id FROM dcf")
def dcf_union(spark, d):
    return D.concepts(_frequencies(spark, d))


_EXTRACTED = """SELECT l_orderkey AS row_id, concat('p', l_partkey) AS concept_id, concat('v', l_partkey % 4) AS value FROM lineitem
 UNION SELECT l_orderkey, concat('t:', p_type), concat('v', l_partkey % 4) FROM lineitem JOIN part ON l_partkey = p_partkey
 UNION SELECT l_orderkey, concat('size', p_size % 3), concat('v', l_partkey % 4) FROM lineitem JOIN part ON l_partkey = p_partkey"""
_ALLOWED = "SELECT DISTINCT concat('t:', p_type) AS id FROM part WHERE p_size < 30"


def _extracted(spark, d):
    for name in ("part", "lineitem"):
        table(spark, d, name).createOrReplaceTempView(f"lattica_{name}")
    swap = lambda s: s.replace("FROM lineitem", "FROM lattica_lineitem").replace("JOIN part", "JOIN lattica_part").replace("FROM part", "FROM lattica_part")
    return spark.sql(swap(_EXTRACTED)), spark.sql(swap(_ALLOWED))


_PRUNED = f"x AS ({_EXTRACTED}), ok AS ({_ALLOWED}), pruned AS (SELECT * FROM x WHERE concept_id IN (SELECT id FROM ok) OR concept_id IN (SELECT up.id FROM up JOIN ok ON up.ancestor = ok.id WHERE bfs_pos <= 2))"


@query(f"WITH RECURSIVE {_UP}, {_PRUNED} SELECT row_id, concept_id, value FROM pruned")
def alpha_prune(spark, d):
    x, ok = _extracted(spark, d)
    return O.prune(x, _up(spark, d), ok)


@query(f"""WITH RECURSIVE {_UP}, {_PRUNED}, gone AS (SELECT DISTINCT k.row_id, up.ancestor, k.value FROM pruned k JOIN up ON up.id = k.concept_id WHERE k.concept_id IN (SELECT parent FROM e) AND up.ancestor <> k.concept_id)
 SELECT row_id, concept_id, value FROM pruned p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.row_id = p.row_id AND g.ancestor = p.concept_id AND g.value = p.value)""")
def smart_prune(spark, d):
    x, ok = _extracted(spark, d)
    e, up = ontology(spark, d)
    return O.prune(x, up, ok, e)


@query(f"""WITH RECURSIVE {_UP}, {_PRUNED}, gone AS (SELECT DISTINCT k.row_id, up.ancestor, k.value FROM pruned k JOIN up ON up.id = k.concept_id WHERE k.concept_id IN (SELECT parent FROM e) AND up.ancestor <> k.concept_id)
 SELECT row_id, concept_id, value FROM pruned p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.row_id = p.row_id AND g.ancestor = p.concept_id AND g.value = p.value)""")
def labelled_pruning(spark, d):
    x, ok = _extracted(spark, d)
    e, labels = _labelled(spark, d)
    return R.prune(x, labels, ok, e)


#: The edges after sizes changed their root, two types lost a size, the second brand of 'brands' went to a size, and suppliers came below their nations.
_CAME = """SELECT DISTINCT concat('size', p_size % 3) AS child, 'sizes' AS parent, 0 AS parent_pos FROM part
 UNION ALL SELECT concat('b:', p_brand), 'size2', 1 FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY p_brand
 UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 0 FROM supplier WHERE s_nationkey < 3 UNION ALL SELECT 'sizes', 'all', 0"""
_WENT = """SELECT DISTINCT concat('size', p_size % 3) AS child, 'root' AS parent FROM part UNION ALL SELECT DISTINCT concat('t:', p_type), 'size1' FROM part WHERE p_type <> (SELECT min(p_type) FROM part)
 UNION ALL SELECT concat('b:', p_brand), 'brands' FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY p_brand"""


@query(f"""WITH RECURSIVE came AS ({_CAME}), went AS ({_WENT}), e AS (SELECT child, parent FROM ({_EDGES}) o WHERE NOT EXISTS (SELECT 1 FROM went w WHERE w.child = o.child AND w.parent = o.parent) UNION SELECT child, parent FROM came),
 u(id, ancestor) AS (SELECT child, parent FROM e UNION SELECT u.id, e.parent FROM u JOIN e ON e.child = u.ancestor), bases(base) AS (VALUES ('root'), ('all'), ('brands'), ('size1'), ('size2'), ('n1'), ('n3')),
 ids AS (SELECT child AS id FROM e UNION SELECT parent FROM e) SELECT ids.id, base, EXISTS (SELECT 1 FROM u WHERE u.id = ids.id AND u.ancestor = base) AS below FROM ids, bases""")
def labels_after_changes(spark, d):
    e, labels = _labelled(spark, d)
    went, came = sql_over(spark, d, _WENT, "part"), sql_over(spark, d, _CAME, "part", "supplier")
    labels, after = R.change(labels, e, came, went)
    ids = after.select(F.col("child").alias("id")).union(after.select("parent")).distinct()
    asked = ids.select("id", F.explode(F.array(*map(F.lit, ("root", "all", "brands", "size1", "size2", "n1", "n3")))).alias("base"))
    return R.ancestry(asked, labels, "id", "base", "below")


_BASES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN 'unknown' ELSE concat('p', l_partkey) END AS other, CASE WHEN l_linenumber = 5 THEN 'unknown' WHEN l_linenumber % 3 = 0 THEN 'brands' WHEN l_linenumber % 3 = 1 THEN 'size1' ELSE concat('p', l_partkey) END AS base FROM lineitem"


@query(f"""WITH RECURSIVE {_UP}, q AS ({_BASES}), k AS (SELECT child AS id FROM e UNION SELECT parent FROM e), bad AS (SELECT DISTINCT id FROM up WHERE ancestor = 't:ECONOMY')
 SELECT q.l_orderkey, q.l_linenumber, CASE WHEN other NOT IN (SELECT id FROM k) THEN 0 WHEN base = other THEN 1 WHEN other IN (SELECT id FROM bad) THEN 0 WHEN up.id IS NOT NULL THEN 1 ELSE 0 END AS h FROM q LEFT JOIN up ON up.id = q.other AND up.ancestor = q.base""")
def hierarchy_score(spark, d):
    e, up = ontology(spark, d)
    known = e.select(F.col("child").alias("id")).union(e.select("parent"))
    return O.hierarchy_score(sql_over(spark, d, _BASES, "lineitem"), up, "base", "other", known, ("t:ECONOMY",)).select("l_orderkey", "l_linenumber", "h")


CONCEPTS = f"""SELECT id, 'Label of ' || id AS label, CASE WHEN id LIKE 't:%' THEN array('first', 'alias ' || id, 'also ' || id) ELSE array() END AS alt_label,
 CASE WHEN id LIKE 'p%' THEN array('Definition of ' || id, 'More on ' || id) ELSE array() END AS definition FROM (SELECT child AS id FROM ({_EDGES}) UNION SELECT parent FROM ({_EDGES}))"""
PROPERTIES = """SELECT concept_id, prop_pos, CASE WHEN concept_id LIKE '%A%' THEN 'or' ELSE 'and' END AS property_type, map('size', 'size' || prop_pos, 'kind', 'root') AS ids, map('has size', 'size ' || prop_pos, 'is of kind', 'root') AS labels
 FROM (SELECT DISTINCT concat('t:', p_type) AS concept_id, p_size % 3 AS prop_pos FROM part)"""
#: For DuckDB: a value text for each property.
VALUES = "v AS (SELECT concept_id, prop_pos, 'size ' || prop_pos || CASE WHEN concept_id LIKE '%A%' THEN ' or ' ELSE ' ' END || 'root' AS value FROM (SELECT DISTINCT concat('t:', p_type) AS concept_id, p_size % 3 AS prop_pos FROM part))"


def concepts(spark, d):
    return storage.table(spark, sql_over(spark, d, CONCEPTS, "part", "customer", "nation"), "concepts")


def properties(spark, d):
    return sql_over(spark, d, PROPERTIES, "part")


@query(f"""WITH RECURSIVE {_UP}, {VALUES}, ch AS (SELECT id, string_agg('Label of ' || ancestor, ', which is a type of ' ORDER BY bfs_pos) FILTER (bfs_pos < n) AS chain, n FROM (SELECT *, max(bfs_pos) OVER (PARTITION BY id) AS n FROM up) GROUP BY id, n),
 pr AS (SELECT concept_id, string_agg(value, ', ' ORDER BY prop_pos) AS t FROM v GROUP BY 1), ids AS (SELECT child AS id FROM e UNION SELECT parent FROM e)
 SELECT ids.id, 'Medical concept: Label of ' || ids.id || '.\n' || CASE WHEN ids.id LIKE 'p%' THEN 'Definitions: Definition of ' || ids.id || '. More on ' || ids.id || '.\n' ELSE '' END
  || CASE WHEN ids.id LIKE 't:%' THEN 'Synonyms: alias ' || ids.id || ', also ' || ids.id || '.\n' ELSE '' END || CASE WHEN n > 1 THEN 'Label of ' || ids.id || ' is a ' || chain || '.\n' ELSE '' END
  || CASE WHEN t IS NOT NULL THEN 'Properties: ' || t ELSE '' END AS description FROM ids LEFT JOIN ch ON ch.id = ids.id LEFT JOIN pr ON pr.concept_id = ids.id""")
def concept_description(spark, d):
    return O.describe(concepts(spark, d), _up(spark, d), properties(spark, d))


@query(f"SELECT parent_pos::INT AS pos, parent FROM (SELECT * FROM ({_EDGES}) WHERE child = 'p7')")
def concept_parents(spark, d):
    return O.parents(ontology(spark, d)[0], "p7").select(F.monotonically_increasing_id().cast("int").alias("pos"), "parent")


@query(f"SELECT DISTINCT child AS child, 'Label of ' || child AS label FROM ({_EDGES}) WHERE parent = 'size1'")
def concept_children(spark, d):
    return O.labels(O.children(ontology(spark, d)[0], "size1"), concepts(spark, d), "child", "label")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w(last, path) AS (SELECT 'p7', ['p7'] UNION ALL SELECT e.parent, list_append(w.path, e.parent) FROM w JOIN e ON e.child = w.last)
 SELECT DISTINCT array_to_string(path, '/') AS path FROM w WHERE last NOT IN (SELECT child FROM e)""")
def ancestor_paths(spark, d):
    return O.paths(ontology(spark, d)[0], "p7").select(F.array_join("path", "/").alias("path")).distinct()


@query(f"SELECT l_orderkey, l_linenumber, concat('p', l_partkey + l_linenumber * 40) IN (SELECT child FROM ({_EDGES})) AS known FROM lineitem")
def concept_known(spark, d):
    q = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey") + F.col("l_linenumber") * 40).alias("id"))
    return O.members(q, "id", concepts(spark, d)).select("l_orderkey", "l_linenumber", "known")


@query(f"WITH {VALUES} SELECT concept_id, prop_pos, value FROM v")
def property_values(spark, d):
    return properties(spark, d).select("concept_id", "prop_pos", O.property_value(F.col("property_type"), F.col("labels")).alias("value"))


@query(f"""WITH RECURSIVE {_UP} SELECT DISTINCT concat('p', l_partkey) AS id FROM lineitem WHERE concat('p', l_partkey) NOT IN (SELECT id FROM up WHERE ancestor = 't:ECONOMY')
 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def composed_filter(spark, d):
    up, allowed = _up(spark, d), table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    ids = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id"))
    return O.composed(ids, "id", [lambda df, k: O.branch_filter(df, k, up, ["t:ECONOMY"]), lambda df, k: O.set_filter(df, k, allowed)])


_SCORED = """SELECT p_partkey, concat('t:', p_type) AS base, CASE WHEN p_partkey % 3 = 0 THEN concat('size', p_size % 3) WHEN p_partkey % 3 = 1 THEN concat('p', p_partkey) ELSE 'kind' END AS other, concat(p_name, ' of size ', p_size % 3, ' root') AS context FROM part"""
_BIGRAMS = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


@query(f"""WITH RECURSIVE {_UP}, {VALUES}, q AS ({_SCORED}), ent AS (SELECT concept_id, unnest(['size', 'kind']) AS k, unnest(['size' || prop_pos, 'root']) AS v FROM v),
 dir AS (SELECT q.p_partkey, sum(((k = other OR v = other)::INT + (up.id IS NOT NULL)::INT) / 2.0::DOUBLE) AS s FROM q JOIN ent ON ent.concept_id = q.base LEFT JOIN up ON up.id = q.other AND up.ancestor = ent.v GROUP BY 1),
 tx AS (SELECT concept_id, regexp_extract_all(lower(string_agg(value, ' ' ORDER BY prop_pos)), '[a-z0-9]+') AS w FROM v GROUP BY 1),
 b AS (SELECT q.p_partkey, {_BIGRAMS.format(w="w")} AS y, {_BIGRAMS.format(w="c")} AS x FROM (SELECT q.p_partkey, base, regexp_extract_all(lower(context), '[a-z0-9]+') AS c FROM q) q JOIN tx ON tx.concept_id = q.base),
 r AS (SELECT p_partkey, coalesce(list_sum(list_transform(list_distinct(y), lambda g: least(len(list_filter(x, lambda z: z = g)), len(list_filter(y, lambda z: z = g)))))::DOUBLE, 0.0) / len(y) AS share FROM b)
 SELECT q.p_partkey, round((coalesce(s, 0) + coalesce(share, 0)) / 2, 9) AS p, round(coalesce(s, 0), 9) AS direct FROM q LEFT JOIN dir USING (p_partkey) LEFT JOIN r USING (p_partkey)""")
def property_score(spark, d):
    q, props, up = sql_over(spark, d, _SCORED, "part"), properties(spark, d), _up(spark, d)
    whole = O.property_scores(q, props, up, ["p_partkey"], "base", "other", "context")
    direct = O.property_scores(q, props, up, ["p_partkey"], "base", "other").withColumnRenamed("p", "direct")
    return whole.join(direct, "p_partkey").select("p_partkey", F.round("p", 9).alias("p"), F.round("direct", 9).alias("direct"))


@query(f"WITH e AS ({_EDGES}), {VALUES} SELECT (SELECT count(*) FROM (SELECT child FROM e UNION SELECT parent FROM e)) AS n_concepts, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM v) AS n_properties")
def ontology_summary(spark, d):
    return O.summary(concepts(spark, d), ontology(spark, d)[0], properties(spark, d))


@query(f"""WITH RECURSIVE {_UP}, {_COUNTS}, {_KEPT}, {_ADJ}, t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM kept),
 dcf AS (SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq, first_pos FROM t LEFT JOIN na ON na.id = t.concept_id WHERE r <= 5),
 b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS rank FROM dcf)
 SELECT domain, rank::INT AS rank, domain || '-' || concept_id AS id, 'Label of ' || concept_id AS label, 1.0::DOUBLE / ((SELECT count(*) FROM b WHERE rank <= 2) * (SELECT count(DISTINCT domain) FROM b)) AS share FROM b WHERE rank <= 2""")
def frequency_rings(spark, d):
    freqs = D.domain_frequencies(_mentions(spark, d), _up(spark, d), 5, ["brands"])
    return D.rings(freqs, concepts(spark, d), 2)


@query(f"{_DOMAIN} SELECT domain, concept_id, freq FROM dcf WHERE domain <> 'R' UNION ALL SELECT 'R', concept_id, freq * 2 FROM dcf WHERE domain = 'A'")
def replaced_domain(spark, d):
    freqs = _frequencies(spark, d)
    new = freqs.filter("domain = 'A'").select(F.lit("R").alias("domain"), "concept_id", (F.col("freq") * 2).alias("freq"))
    return D.replace_domain(freqs, new, "R")


_ORDERED = "SELECT o_orderkey AS note_id, o_orderpriority AS domain FROM orders"


@query(f"""WITH RECURSIVE {_UP}, first AS (SELECT note_id, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY note_id) AS r FROM ({_ORDERED})) WHERE r <= 40),
 c AS (SELECT domain, concat('p', l_partkey) AS concept_id, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem JOIN first ON l_orderkey = note_id GROUP BY 1, 2),
 freq AS (SELECT domain, up.ancestor AS concept_id, sum(n)::DOUBLE AS freq, min((p, bfs_pos)) AS first_pos FROM c JOIN up ON up.id = c.concept_id GROUP BY 1, 2), {_KEPT}, {_ADJ},
 t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM kept),
 dcf AS (SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq FROM t LEFT JOIN na ON na.id = t.concept_id WHERE r <= 5),
 mean AS (SELECT concept_id, sum(freq) / (SELECT count(DISTINCT o_orderpriority) FROM orders)::DOUBLE AS m FROM dcf GROUP BY 1) SELECT domain, concept_id, round(freq - m, 6) AS freq FROM dcf JOIN mean USING (concept_id)""")
def capped_frequency(spark, d):
    notes = sql_over(spark, d, _ORDERED, "orders")
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.concat(F.lit("p"), "l_partkey").alias("concept_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_pos"))
    got = D.capped_frequencies(notes, m, _up(spark, d), "note_id", ["note_id"], 40, 5, ["brands"])
    return got.select("domain", "concept_id", F.round("freq", 6).alias("freq"))


_SECTIONED = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('Seen.\nHospital course: ', p_name, '\n\nPlan: ', p_brand) END AS note FROM part"
_TERMS = "SELECT lower(split_part(p_name, ' ', 1)) AS term, concat('p', min(p_partkey)) AS concept_id FROM part GROUP BY 1"


@query(f"""WITH RECURSIVE {_UP}, first AS (SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 1000) AND p_partkey % 3 <> 0),
 w AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM first)),
 c AS (SELECT 'BHC' AS domain, concept_id, count(*) AS n, min((p_partkey, i)) AS p FROM w JOIN ({_TERMS}) ON term = word GROUP BY 1, 2),
 freq AS (SELECT domain, up.ancestor AS concept_id, sum(n)::DOUBLE AS freq, min((p, bfs_pos)) AS first_pos FROM c JOIN up ON up.id = c.concept_id GROUP BY 1, 2), {_KEPT}, {_ADJ},
 t AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM kept)
 SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq FROM t LEFT JOIN na ON na.id = t.concept_id WHERE r <= 8""")
def section_frequency(spark, d):
    from ..operators.shards import annotate

    notes = sql_over(spark, d, _SECTIONED.replace("\n", "\\n"), "part")
    terms = sql_over(spark, d, _TERMS.replace("split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), "part")
    return D.section_frequencies(notes, "note", lambda df, text: annotate(df, text, terms, "p_partkey"), _up(spark, d), "p_partkey", ["p_partkey"], 1000, 8, ["brands"]).select("domain", "concept_id", "freq")


_DOMAIN_SET = "SELECT DISTINCT concat('t:', p_type) AS id FROM part WHERE p_size < 30 UNION SELECT 'size1' UNION SELECT 'brands'"
_NOTES = "SELECT c_custkey AS note_id, concat(c_name, ' of ', c_mktsegment) AS text FROM customer"
_NOTED = "SELECT l_suppkey AS note_id, concat('p', l_partkey) AS concept_id, l_orderkey * 10 + l_linenumber AS _pos FROM lineitem"
_ABOUT = f"""{_COUNTS.replace("l_returnflag", "l_suppkey")}, {_KEPT}, {_ADJ}, a AS (SELECT domain, concept_id, 0.75 * freq - 0.25 * greatest(coalesce(n, 0), 1) AS freq, first_pos FROM kept LEFT JOIN na ON na.id = kept.concept_id)"""
_TOP = f"{_ABOUT}, wanted AS (SELECT domain AS note_id, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY freq DESC, first_pos, concept_id) AS r FROM a) WHERE r <= 3)"
_IN_DOMAIN = f"{_ABOUT}, ok AS ({_DOMAIN_SET}), wanted AS (SELECT DISTINCT domain AS note_id, concept_id FROM kept WHERE concept_id IN (SELECT id FROM ok))"
_EVERY = "wanted AS (SELECT c_custkey AS note_id, concept_id FROM customer, (VALUES ('size0'), ('size1'), ('t:none')) z(concept_id))"
_ASKED = f"""{VALUES}, tx AS (SELECT concept_id, string_agg(value, '\n- ' ORDER BY prop_pos) AS t FROM v GROUP BY 1), known AS (SELECT id FROM (SELECT child AS id FROM e UNION SELECT parent FROM e)),
 asked AS (SELECT n.note_id, coalesce(w.concept_id, '') AS concept_id, CASE WHEN w.concept_id IS NULL THEN '' ELSE n.text || '\n\nWhat does the note say about ' || coalesce('Label of ' || known.id, '') || '?'
   || CASE WHEN t IS NULL THEN '' ELSE '\n' || 'Label of ' || known.id || ' has these properties:\n- ' || t || '\n' END END AS prompt
  FROM ({_NOTES}) n LEFT JOIN wanted w ON w.note_id = n.note_id LEFT JOIN tx ON tx.concept_id = w.concept_id LEFT JOIN known ON known.id = w.concept_id),
 told AS (SELECT *, CASE WHEN prompt = '' THEN '' WHEN length(prompt) % 5 = 0 THEN 'N/A' ELSE length(prompt) || ' characters' END AS value FROM asked)"""


def _answers():
    return G.blocking(lambda p: "There is no mention of it." if len(p) % 5 == 0 else f" {len(p)} characters\n")


def _flow(spark, d, kind):
    notes, mentions = sql_over(spark, d, _NOTES, "customer"), sql_over(spark, d, _NOTED, "lineitem")
    up, names, props = _up(spark, d), concepts(spark, d), properties(spark, d)
    if kind == "guided":
        return X.guided(notes, mentions, up, names, props, 3, ["brands"])
    if kind == "every":
        return X.of_domain(notes, spark.createDataFrame([("size0",), ("size1",), ("t:none",)], "id string"), names, props)
    return X.of_domain(notes, sql_over(spark, d, _DOMAIN_SET, "part"), names, props, mentions, up, ["brands"])


def _told(asked):
    return X.answered(asked, _answers).select("note_id", "concept_id", F.md5("prompt").alias("prompt_md5"), "value")


_TOLD = "SELECT note_id, concept_id, md5(prompt) AS prompt_md5, value FROM told"


@query(f"WITH RECURSIVE {_UP}, {_TOP}, {_ASKED} {_TOLD}")
def guided_extraction(spark, d):
    return _told(_flow(spark, d, "guided"))


@query(f"WITH RECURSIVE {_UP}, {_IN_DOMAIN}, {_ASKED} {_TOLD}")
def domain_extraction(spark, d):
    return _told(_flow(spark, d, "domain"))


@query(f"WITH e AS ({_EDGES}), {_EVERY}, {_ASKED} {_TOLD}")
def domain_cross_extraction(spark, d):
    return _told(_flow(spark, d, "every"))


@query(f"WITH RECURSIVE {_UP}, {_IN_DOMAIN} SELECT note_id, concept_id FROM wanted")
def domain_concepts(spark, d):
    return D.domain_concepts(sql_over(spark, d, _NOTED, "lineitem"), _up(spark, d), ["brands"], sql_over(spark, d, _DOMAIN_SET, "part"))


@query(f"WITH RECURSIVE {_UP}, {_TOP}, {_ASKED} SELECT note_id, count(*) FILTER (concept_id <> '')::INT AS n, md5(coalesce(string_agg(concept_id || '=' || value, '|' ORDER BY concept_id) FILTER (concept_id <> ''), '')) AS entries_md5 FROM told GROUP BY 1")
def extraction_by_note(spark, d):
    maps = X.by_note(X.answered(_flow(spark, d, "guided"), _answers))
    entries = F.array_sort(F.transform(F.map_entries("extraction"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return maps.select("note_id", F.size("extraction").alias("n"), F.md5(F.array_join(entries, "|")).alias("entries_md5"))


@query(f"""WITH RECURSIVE {_UP}, {_TOP}, {_ASKED} SELECT note_id, c AS config_name, md5(coalesce(string_agg(concept_id || '=' || CASE c WHEN 'normal' THEN value ELSE c || ' ' || length(prompt) END, '|' ORDER BY concept_id) FILTER (concept_id <> ''), '')) AS entries_md5
 FROM told, (VALUES ('normal'), ('beam'), ('hps')) z(c) GROUP BY 1, 2""")
def extraction_variants(spark, d):
    other = lambda name: lambda: G.blocking(lambda p: f"{name} {len(p)}")
    got = X.variants(_flow(spark, d, "guided"), {"normal": _answers, "beam": other("beam"), "hps": other("hps")})
    entries = F.array_sort(F.transform(F.map_entries("extraction"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return got.select("note_id", "config_name", F.md5(F.array_join(entries, "|")).alias("entries_md5"))


#: Customers below their nations, and these below the roots of the branches that are left out or below one of two others.
_ROOTED = f"""SELECT concat('c', c_custkey) AS child, concat('n', c_nationkey) AS parent, 0 AS parent_pos FROM customer
 UNION ALL SELECT concat('n', n_nationkey), [{", ".join(f"'{r}'" for r in (*D.EXCLUDED_ROOTS, "404684003", "71388002"))}][n_nationkey % 8 + 1], 0 FROM nation
 UNION ALL SELECT concat('c', c_custkey), concat('m:', c_mktsegment), 1 FROM customer WHERE c_custkey % 5 = 0"""


@query(f"""WITH RECURSIVE e AS ({_ROOTED}), u(id, ancestor) AS (SELECT child, parent FROM e UNION SELECT u.id, e.parent FROM u JOIN e ON e.child = u.ancestor),
 roots(root) AS (VALUES {", ".join(f"('{r}')" for r in D.EXCLUDED_ROOTS)}), asked AS (SELECT o_orderkey, concat('c', o_custkey) AS concept_id FROM orders UNION ALL SELECT o_orderkey, concat('n', o_custkey % 25) FROM orders UNION ALL SELECT o_orderkey, root FROM orders JOIN roots ON o_orderkey % 50 = 0)
 SELECT o_orderkey, concept_id FROM asked WHERE concept_id NOT IN (SELECT root FROM roots) AND concept_id IN (SELECT id FROM u) AND concept_id NOT IN (SELECT id FROM u WHERE ancestor IN (SELECT root FROM roots))""")
def excluded_branches(spark, d):
    """What orders speak of, without the branches that are always left out."""
    labels = R.labels(sql_over(spark, d, _ROOTED.replace("['", "array('").replace("'][n_nationkey % 8 + 1]", "')[n_nationkey % 8]"), "customer", "nation"))
    orders = table(spark, d, "orders")
    concepts = F.array(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("n"), F.col("o_custkey") % 25))
    named = F.when(F.col("o_orderkey") % 50 == 0, F.concat(concepts, F.array(*map(F.lit, D.EXCLUDED_ROOTS)))).otherwise(concepts)
    return R.branch_filter(orders.select("o_orderkey", F.explode(named).alias("concept_id")), "concept_id", labels, list(D.EXCLUDED_ROOTS))
