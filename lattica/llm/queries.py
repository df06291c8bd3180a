"""The operators over whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontam, jaccard, kmeans, langid, license, lm, packing, quality, rollup, rules, shared, store, trie

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(5) == 1)
    model = lm.train(docs.filter("not held_out"))
    scored = lm.perplexity(lm.score(docs, model, ["doc_id", "held_out"]))
    return scored.withColumn("train_tokens", F.lit(model.words.tokens).cast("long"))


def trained_quality(spark: SparkSession, sf_dir: str, described: DataFrame) -> quality.Model:
    """Fitted to the rows of ``described`` (doc_id, x) outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(fold(3) != 1)
    return quality.train(described.filter(fold(3) != 1), labels)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = shared.table(spark, quality.features(documents(spark, sf_dir), ["doc_id"]), "described")
    model = trained_quality(spark, sf_dir, described)
    return quality.predict(described.withColumn("held_out", fold(3) == 1), model, ["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(documents(spark, sf_dir), ["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


def trained_languages(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.train(documents(spark, sf_dir).filter(fold(5) != 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(5) == 0)
    return langid.predict(docs, trained_languages(spark, sf_dir), ["doc_id", "held_out"])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("row_nr", "class_nr")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark)
    store.write(documents(spark, sf_dir), folder, tokenizer_path(), end_id=0)
    return store.digests(spark, folder)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return license.scan(docs, license.build(docs), ["doc_id"])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = shared.table(spark, packing.lengths(documents(spark, sf_dir), ["doc_id"], tokenizer_path()), "lengths")
    return packing.pack(sized, packing.plan(sized))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by characters are inserted, revised by a tokenizer's exact counts (a batch sent twice), counts by
    words inserted as a second version, and what texts without a word counted deleted again; the batches are folded
    into one in between."""
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "text", "source", "lang", F.char_length(text).cast("long").alias("n_chars"),
        F.size(F.array_remove(F.split(text, rules.SPACE + "+"), "")).cast("long").alias("spaced"))
    counted = shared.table(spark, packing.lengths(docs, ["source", "lang", "n_chars", "spaced"], tokenizer_path()), "counted")
    counted = counted.withColumn("exact", F.col("n_tokens") - 1).drop("n_tokens")  # without an end
    folder = f"{shared.root(spark)}/rollup-{uuid.uuid4().hex}"
    none = F.lit(0).cast("long")

    def changes(op: str, tokenizer: str, new: Column, old: Column = none, old_chars: Column = none, rows: DataFrame = counted) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), new.alias("n_tokens"), old.alias("old_tokens"), F.col("n_chars"), old_chars.alias("old_chars"))

    chars, exact, words = F.col("n_chars"), F.col("exact"), F.col("spaced")
    version, guess = TOKENIZER.removesuffix(".json"), F.ceil(F.col("n_chars") / 4).cast("long")
    revised = changes("revise", version, exact, guess, chars)
    rollup.commit(spark, folder, f"insert {version}", changes("insert", version, guess))
    rollup.commit(spark, folder, f"revise {version}", revised)
    rollup.compact(spark, folder)
    rollup.commit(spark, folder, f"revise {version}", revised)
    rollup.commit(spark, folder, "insert words-1", changes("insert", "words-1", words))
    bare = counted.filter("spaced = 0")
    rollup.commit(spark, folder, "delete bare", changes("delete", version, none, exact, chars, bare).unionByName(changes("delete", "words-1", none, words, chars, bare)))
    return rollup.totals(spark, folder)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation c begins with the first turns of c - c % 5, as many as the CRC of its number says."""
    c = F.col("c")
    heads = F.crc32(c.cast("string").cast("binary")) % 9
    return trie.nodes(trie.graft(trie.steps(spark.read.parquet(f"{sf_dir}/conversations.parquet")), c - c % 5, heads, 8))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")), 256)
    assigned, centroids = kmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 8, 10, rank)
    return kmeans.report(assigned, centroids).withColumnRenamed("id", "vec_id").drop("spent")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.remove(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_lm_scoring, op2_quality, op3_quality_rules, op4_decontamination, op5_language_id, op6_ngram_jaccard, op7_token_store, op8_license_scan, op9_packing, op10_token_counts, op11_conversation_trie, op12_centroid_clustering, op13_substring_dedup)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_SPACED = r"'[^\x20\x09-\x0D]+'"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
_OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {_SPACED}) AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM again) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS stop_words, len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS shouts, len(regexp_extract_all(text, '[A-Z]')) AS upper
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, greatest(n_words, 1) AS n, greatest(word_chars, 1) AS c FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars / n >= 2 AND word_chars / n <= 15 AND n_symbols / n <= 0.1 AND shouts / n <= 0.3 AND stop_words / n >= 0.06
   AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AND upper / c <= 0.4) AS kept
FROM b"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS ws FROM benchmark),
iw AS (SELECT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS x
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS x
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s, n FROM dw JOIN iw USING (n, x)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
ip AS (SELECT nr, item_id, unnest(ws) AS w, unnest(range(len(ws))) AS off, least(10, len(ws)) AS n, len(ws) AS m FROM (SELECT *, row_number() OVER () AS nr FROM i)),
often AS (SELECT w, count(*) AS c FROM dp GROUP BY w),
ranked AS (SELECT ip.*, coalesce(c, 0) AS c FROM ip LEFT JOIN often USING (w)),
anchor AS (SELECT DISTINCT nr, item_id, off FROM (SELECT a.nr, a.item_id, a.off, row_number() OVER (PARTITION BY a.nr, g.start ORDER BY a.c, a.off) AS r
           FROM ranked a, LATERAL (SELECT unnest(range(greatest(0, a.off - a.n + 1), least(a.off, a.m - a.n) + 1)) AS start) g) WHERE r = 1),
around AS (SELECT DISTINCT a.nr, a.off, b.w FROM anchor a JOIN ip b ON a.nr = b.nr AND b.off BETWEEN a.off - 9 AND a.off + 9),
need AS (SELECT nr, off, ceil(0.8 * count(*) - 1e-9) AS least FROM around GROUP BY ALL),
aligned AS (SELECT a.nr, a.item_id, a.off, dp.doc_id, dp.p FROM anchor a JOIN ip USING (nr, off) JOIN dp ON dp.w = ip.w),
met AS (SELECT l.nr, l.item_id, l.off, l.doc_id, l.p, count(DISTINCT b.w) AS c FROM aligned l JOIN around b ON b.nr = l.nr AND b.off = l.off JOIN dp e ON e.doc_id = l.doc_id AND e.w = b.w AND e.p BETWEEN l.p - 9 AND l.p + 9 GROUP BY ALL),
nears AS (SELECT doc_id, count(DISTINCT item_id) AS n_near_items FROM (SELECT doc_id, item_id FROM met JOIN need USING (nr, off) WHERE c >= least UNION ALL SELECT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nears USING (doc_id)"""

_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)"
_OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, text, sha256(strlen(role)::VARCHAR || ':' || role || text) AS g FROM t),
o AS (SELECT conv_id, text, g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS i FROM k),
n AS (SELECT conv_id, max(i) AS n FROM o GROUP BY conv_id),
a AS (SELECT n.conv_id, n.n, n.conv_id - n.conv_id % 5 AS base, {_CRC} % 9 AS h FROM n),
b AS (SELECT a.*, least(h, coalesce(m.n, 0)) AS taken FROM a LEFT JOIN n m ON m.conv_id = a.base),
r AS (SELECT b.conv_id AS c, i AS d, g, text FROM b JOIN o ON o.conv_id = b.base AND i <= h UNION ALL SELECT b.conv_id, taken + i - h, g, text FROM b JOIN o ON o.conv_id = b.conv_id AND i > h),
p AS (SELECT c, d, strlen(text) AS size, string_agg(g, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS x, max(d) OVER (PARTITION BY c) = d AS last FROM r
      UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT c FROM r) FROM b),
v AS MATERIALIZED (SELECT x, any_value(d) AS depth, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM p GROUP BY x),
e AS (SELECT u.x, count(w.x) AS n_children FROM v u LEFT JOIN v w ON w.depth = u.depth + 1 AND left(w.x, 64 * u.depth::INT) = u.x GROUP BY u.x),
s AS (SELECT x, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT DISTINCT q.x, w.x AS below, (e.n_children = 0)::INT AS leaf, (w.n_convs - 1) * w.size AS saved
      FROM p q JOIN p z ON z.c = q.c AND z.d >= q.d JOIN v w ON w.x = z.x JOIN e ON e.x = w.x) GROUP BY x)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN e USING (x) JOIN s USING (x) LEFT JOIN v u ON v.depth > 0 AND u.x = left(v.x, 64 * (v.depth - 1)::INT)"""


def _op12(k: int = 8, rounds: int = 10, width: int = 64) -> str:
    """A pair of tables for each round: the vectors with their clusters (a), and the centroids that follow (c)."""
    made = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
            f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r) - 1 AS j, e FROM (SELECT e, sha256('3:' || vec_id::VARCHAR) AS r FROM v ORDER BY r NULLS LAST LIMIT {k}))"]
    far = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for r in range(rounds + 1):
        made.append(f"a{r} AS MATERIALIZED (SELECT nr, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT nr, j, {far} AS d FROM v, c{r} c) GROUP BY nr)")
        if r < rounds:
            made.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(n.e, c{r}.e) AS e FROM c{r} LEFT JOIN (SELECT j, list(m ORDER BY i) AS e FROM (
      SELECT j, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m FROM (SELECT a.j, unnest(v.e) AS x, unnest(range({width})) AS i FROM a{r} a JOIN v USING (nr)) GROUP BY j, i) GROUP BY j) n USING (j))""")
    return "WITH " + ",\n".join(made) + f"""
SELECT vec_id, j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (nr) JOIN c{rounds} c USING (j)"""


_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
w AS (SELECT nr, s, array_to_string(ws[s:s + 34], ' ') AS x FROM (SELECT nr, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35)),
g AS (SELECT nr, list(DISTINCT p) AS ps FROM (SELECT nr, unnest(range(s, s + 35)) AS p FROM (SELECT nr, s, count(*) OVER (PARTITION BY x) AS c FROM w) WHERE c > 1) GROUP BY nr)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (nr)"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op3_quality_rules": _OP3, "op4_decontamination": _OP4, "op11_conversation_trie": _OP11, "op12_centroid_clustering": _op12(), "op13_substring_dedup": _OP13}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
