"""Verdicts, judgements and pairs of methods over rows made from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import from_wide, to_wide
from ..functions import scores
from ..operators import judge as J
from ..operators import verdicts as V
from . import query, table


def _sql(spark, d, sql, *names):
    for name in names:
        table(spark, d, name).createOrReplaceTempView(f"lattica_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM lattica_{name}")
    return spark.sql(sql)


# The patterns of operators/verdicts.py in the form that DuckDB reads.
_OUTPUTS = """SELECT event_id, event_type, value > 50 AS label, CASE CAST(event_id % 9 AS INT) WHEN 0 THEN 'Factual: YES' WHEN 1 THEN 'factual: **no ### Explanation because' WHEN 2 THEN 'I say yes indeed'
 WHEN 3 THEN ' no ' WHEN 4 THEN 'it is: yes and no' WHEN 5 THEN NULL WHEN 6 THEN '' WHEN 7 THEN 'Factual not sure' ELSE 'unclear' END AS output FROM events"""
_PARSED = rf"""o AS ({_OUTPUTS}), l AS (SELECT *, lower(output) AS t FROM o),
 m AS (SELECT *, regexp_matches(t, '(?i)Factual(?::)?(?:\n| |\*)*(YES|NO)') AS strict, regexp_matches(t, '(?i)(?:Factual)?(?:\s|:)(?:\[)?(?:yes|is factual)(?:\])?(?:\s|:)?') AS y, regexp_matches(t, '(?i)(?:Factual)?(?:\s|:)(?:\[)?(?:no|not factual)(?:\])?(?:\s|:)?') AS n FROM l),
 parsed AS (SELECT event_id, event_type, label, CASE WHEN output IS NULL OR output = '' THEN false WHEN strict THEN true ELSE y <> n END AS valid,
  CASE WHEN output IS NULL OR output = '' THEN false WHEN strict THEN lower(regexp_extract(t, '(?i)Factual(?::)?(?:\n| |\*)*(YES|NO)', 1)) = 'yes' ELSE y END AS prediction,
  CASE WHEN output IS NULL OR output = '' THEN '' WHEN strict THEN trim(CASE WHEN regexp_matches(t, '(?i)### Explanation([\s\S]+)') THEN regexp_extract(t, '(?i)### Explanation([\s\S]+)', 1) ELSE t END) ELSE t END AS explanation_gen FROM m)"""


def _parsed(spark, d):
    return _sql(spark, d, _OUTPUTS, "events").select("event_id", "event_type", "label", V.parse(F.col("output")).alias("v")).select("event_id", "event_type", "label", "v.*")


@query(f"WITH {_PARSED} SELECT event_id, event_type, label, valid, prediction, explanation_gen FROM parsed")
def verdict_parse(spark, d):
    return _parsed(spark, d)


def _confusion_sql(by: str) -> str:
    return f"""WITH {_PARSED}, c AS (SELECT {by} count(*) AS n, count(*) FILTER (label AND prediction) AS tp, count(*) FILTER (NOT label AND prediction) AS fp, count(*) FILTER (label AND NOT prediction) AS fn,
  count(*) FILTER (NOT label AND NOT prediction) AS tn FROM parsed WHERE valid {"GROUP BY event_type" if by else ""})
 SELECT *, (tp + tn) / nullif(n, 0)::DOUBLE AS accuracy, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1 FROM c"""


@query(_confusion_sql(""))
def confusion_metrics(spark, d):
    return V.confusion(_parsed(spark, d).filter("valid"), F.col("label"), F.col("prediction"))


@query(_confusion_sql("event_type,"))
def f1_by_category(spark, d):
    return V.confusion(_parsed(spark, d).filter("valid"), F.col("label"), F.col("prediction"), ["event_type"])


@query(f"WITH {_PARSED} SELECT event_type, count(*) AS total, avg((label = prediction)::INT::DOUBLE) * 100 AS correct_pct, 100 - avg((label = prediction)::INT::DOUBLE) * 100 AS incorrect_pct FROM parsed GROUP BY 1")
def accuracy_by_category(spark, d):
    return V.accuracy_by(_parsed(spark, d), "event_type", F.col("label"), F.col("prediction"))


@query("""WITH j AS (SELECT source, quality = 1 AS label, n_chars > 500 AS prediction FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT source, count(*) AS n, count(*) FILTER (label AND prediction) AS tp, count(*) FILTER (NOT label AND prediction) AS fp, count(*) FILTER (label AND NOT prediction) AS fn, count(*) FILTER (NOT label AND NOT prediction) AS tn FROM j GROUP BY 1)
 SELECT source, tp, fp, fn, tn, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1 FROM c""")
def label_scores(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return V.confusion(df, F.col("quality") == 1, F.col("n_chars") > 500, ["source"]).select("source", "tp", "fp", "fn", "tn", "f1")


_JUDGED = """SELECT event_id, concat('m', event_id % 4) AS a, concat('m', (event_id + 1 + user_id % 3) % 4) AS b, event_type AS concept,
 CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('x', event_id % 6) END AS a_result, concat('X', event_id % 5) AS b_result,
 CASE CAST(event_id % 10 AS INT) WHEN 0 THEN 'Feedback. [RESULT] A' WHEN 1 THEN '[RESULT] B' WHEN 2 THEN 'Result: N/A' WHEN 3 THEN '[RESULT] A or B' WHEN 4 THEN 'result: b' WHEN 5 THEN NULL WHEN 6 THEN 'no tag'
  WHEN 7 THEN '[RESULT] (A)' WHEN 8 THEN 'a good result as such' ELSE concat('[RESULT] ', CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END) END AS result FROM events"""
# The pattern of operators/judge.py.
_DECISION = r"(?i)(?:\[?Result\]?:?)\s*(N/A|A|B)\s*(or|and)?\s*(A|B)?"
_DECIDED = f"""j AS ({_JUDGED}), d AS (SELECT *, CASE WHEN result IS NULL OR NOT regexp_matches(result, '{_DECISION}') THEN 'parsing_error' WHEN regexp_extract(result, '{_DECISION}', 1) = 'N/A' THEN 'tie'
 ELSE lower(regexp_extract(result, '{_DECISION}', 1)) END AS decision FROM j)"""


def _decided(spark, d):
    return _sql(spark, d, _JUDGED, "events").withColumn("decision", J.decision(F.col("result")))


@query(f"WITH {_DECIDED} SELECT event_id, decision FROM d")
def judge_parse(spark, d):
    return _decided(spark, d).select("event_id", "decision")


_MATRIX = f"""WITH {_DECIDED}, b AS (SELECT a AS method, b AS opponent, (decision = 'a')::INT AS w, decision FROM d UNION ALL SELECT b, a, (decision = 'b')::INT, decision FROM d),
 c AS (SELECT method, opponent, sum(w)::BIGINT AS wins, count(*) FILTER (decision = 'tie') AS ties, count(*) FILTER (decision = 'parsing_error') AS parsing_errors, count(*) AS total FROM b GROUP BY 1, 2),
 m AS (SELECT *, total - ties - parsing_errors AS effective, wins * 100.0::DOUBLE / total AS win_rate, wins * 100.0::DOUBLE / nullif(total - ties - parsing_errors, 0) AS effective_win_rate FROM c)"""


@query(f"{_MATRIX} SELECT * FROM m")
def win_matrix(spark, d):
    return J.win_matrix(_decided(spark, d))


@query(f"{_MATRIX} SELECT method, wins, total, wins * 100.0::DOUBLE / nullif(total - ties, 0) AS head_to_head FROM m WHERE opponent = 'm0'")
def win_vs_baseline(spark, d):
    return J.head_to_head(J.versus(J.win_matrix(_decided(spark, d)), "m0")).select("method", "wins", "total", "head_to_head")


@query(f"{_MATRIX} SELECT method, count(*) FILTER (effective_win_rate > 50) AS beaten FROM m GROUP BY 1")
def opponents_beaten(spark, d):
    return J.opponents_beaten(J.win_matrix(_decided(spark, d)))


@query(f"""WITH {_DECIDED}, o AS (SELECT CASE WHEN a_result IS NULL OR b_result IS NULL THEN 'model_na' WHEN result IS NULL THEN 'no_concepts_found' WHEN lower(trim(a_result)) = lower(trim(b_result)) THEN 'identical_generations'
 WHEN NOT regexp_matches(result, '{_DECISION}') THEN 'not_enough_tokens' ELSE 'correct_generations' END AS outcome FROM d) SELECT outcome, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM o GROUP BY 1""")
def outcome_shares(spark, d):
    from ..operators.stats import shares

    return shares(_decided(spark, d).select(J.outcome(F.col("a_result"), F.col("b_result"), F.col("result")).alias("outcome")), "outcome")


_WIDE = """SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'N/A' ELSE 'ask' END AS normal_ECG_verbalizer_prompt, concat('n', conv_id) AS normal_ECG_verbalized,
 'ask' AS beam_Radiology_verbalizer_prompt, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('b', conv_id) END AS beam_Radiology_verbalized FROM conversations WHERE turn = 0"""


@query(f"WITH w AS ({_WIDE}) SELECT conv_id, 'normal' AS method, 'ECG' AS domain, normal_ECG_verbalized AS value FROM w WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id, 'beam', 'Radiology', beam_Radiology_verbalized FROM w WHERE beam_Radiology_verbalized IS NOT NULL")
def unpivot_verbalized(spark, d):
    return from_wide(_sql(spark, d, _WIDE, "conversations"), "_verbalized", "_verbalizer_prompt")


@query(f"WITH w AS ({_WIDE}) SELECT conv_id, max(CASE WHEN conv_id % 4 <> 0 THEN normal_ECG_verbalized END) AS normal_ECG_value, max(beam_Radiology_verbalized) AS beam_Radiology_value FROM w WHERE conv_id % 4 <> 0 OR beam_Radiology_verbalized IS NOT NULL GROUP BY 1")
def pivot_methods(spark, d):
    return to_wide(unpivot_verbalized(spark, d), ["conv_id"], [("normal", "ECG"), ("beam", "Radiology")], "_value")


_LONG = "SELECT user_id, concat('c', event_id % 5) AS concept, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'normal' WHEN 1 THEN 'beam' ELSE 'constrained' END AS method, min(event_type) AS value FROM events GROUP BY 1, 2, 3"


@query(f"WITH l AS ({_LONG}) SELECT x.user_id, x.concept, x.method AS a, y.method AS b, x.value AS a_result, y.value AS b_result FROM l x JOIN l y ON x.user_id = y.user_id AND x.concept = y.concept AND x.method <> y.method WHERE x.value <> y.value")
def method_pairs(spark, d):
    return J.method_pairs(_sql(spark, d, _LONG, "events"), ["user_id", "concept"], different_only=True).select("user_id", "concept", "a", "b", "a_result", "b_result")


@query(f"""WITH l AS ({_LONG}), x AS (SELECT * FROM l WHERE method = 'normal' AND user_id % 2 = 0), y AS (SELECT * FROM l WHERE method = 'beam' AND user_id % 3 = 0)
 SELECT coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.concept, y.concept) AS concept, 'normal' AS a, 'beam' AS b, coalesce(x.value, 'N/A') AS a_result, coalesce(y.value, 'N/A') AS b_result FROM x FULL JOIN y ON x.user_id = y.user_id AND x.concept = y.concept""")
def outer_pairs(spark, d):
    long = _sql(spark, d, _LONG, "events")
    pick = lambda m, k: long.filter((F.col("method") == m) & (F.col("user_id") % k == 0)).drop("method")
    return J.outer_pairs(pick("normal", 2), pick("beam", 3), ["user_id", "concept"], "normal", "beam")


_BI = "list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"


@query(f"""WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' of ' || p_type), '[a-z0-9]+') AS x, regexp_extract_all(lower(p_name || ' or ' || p_brand), '[a-z0-9]+') AS y FROM part),
 b AS (SELECT p_partkey, list_distinct({_BI.format(w="x")}) AS x, list_distinct({_BI.format(w="y")}) AS y FROM w) SELECT p_partkey, len(list_intersect(x, y)) / nullif(len(x), 0)::DOUBLE AS overlap FROM b""")
def bigram_overlap(spark, d):
    a, b = F.concat_ws(" of ", "p_name", "p_type"), F.concat_ws(" or ", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", scores.bigram_overlap(a, b).alias("overlap"))


@query()
def explanation_scores(spark, d):
    df = _parsed(spark, d).withColumn("explanation", F.concat_ws(" ", F.lit("because the"), "event_type", (F.col("event_id") % 7).cast("string"), F.lit("says no indeed")))
    return V.explanation_scores(df)


def _grams_sql(words: str, orders: str) -> str:
    """both, n_ref and n_made of runs of words for each pair (k, a, b) and order n."""
    runs = f"SELECT k, side, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT k, 'a' AS side, {words.format('a')} AS w FROM pairs UNION ALL SELECT k, 'b', {words.format('b')} FROM pairs), (SELECT unnest({orders}) AS n) WHERE len(w) >= n)"
    counted = f"SELECT k, n, g, count(*) FILTER (side = 'a') AS x, count(*) FILTER (side = 'b') AS y FROM ({runs}) GROUP BY 1, 2, 3"
    return f"SELECT k, n, sum(least(x, y)) AS both_, sum(x) AS n_ref, sum(y) AS n_made FROM ({counted}) GROUP BY 1, 2"


def _scores_sql() -> str:
    """rouge1, rouge2 and bleu of pairs (k, a, b)."""
    rouge, bleu = _grams_sql("regexp_extract_all(lower({0}), '[a-z0-9]+')", "[1, 2]"), _grams_sql(r"list_filter(string_split_regex({0}, '[\x09-\x0D\x20]+'), lambda x: x <> '')", "[1, 2, 3, 4]")
    return f"""rg AS ({rouge}), bl AS ({bleu}), f AS (SELECT k, n, 2 * both_ / (greatest(n_ref, 1) + greatest(n_made, 1))::DOUBLE AS f FROM rg),
 q AS (SELECT k, CASE WHEN count(*) FILTER (both_ > 0) = 4 THEN exp(sum(CASE WHEN both_ > 0 THEN ln(both_ / n_made::DOUBLE) END) / 4) * CASE WHEN max(n_made) > max(n_ref) THEN 1 ELSE exp(1 - max(n_ref) / max(n_made)::DOUBLE) END ELSE 0 END AS bleu FROM bl GROUP BY 1),
 scored AS (SELECT pairs.k, coalesce(f1.f, 0) AS rouge1, coalesce(f2.f, 0) AS rouge2, coalesce(bleu, 0) AS bleu FROM pairs LEFT JOIN f f1 ON f1.k = pairs.k AND f1.n = 1 LEFT JOIN f f2 ON f2.k = pairs.k AND f2.n = 2 LEFT JOIN q ON q.k = pairs.k)"""


@query(f"""WITH pairs AS (SELECT a.doc_id AS k, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL), {_scores_sql()}
 SELECT k AS doc_id, round(rouge1, 9) AS rouge1, round(rouge2, 9) AS rouge2, round(bleu, 9) AS bleu FROM scored""")
def overlap_scores(spark, d):
    """ROUGE-1, ROUGE-2 (of words as they are) and BLEU of every document and the next one."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")
    return pairs.select("doc_id", scores.text_scores(F.col("text"), F.col("next"), stemmed=False).alias("t")).select("doc_id", *(F.round(f"t.{c}", 9).alias(c) for c in ("rouge1", "rouge2", "bleu")))


@query(f"""WITH {_PARSED}, pairs AS (SELECT event_id AS k, 'because the ' || event_type || ' ' || (event_id % 7) || ' says no indeed' AS a, explanation_gen AS b FROM parsed WHERE NOT label AND NOT prediction), {_scores_sql()}
 SELECT round(avg(rouge1), 9) AS rouge1, round(avg(rouge2), 9) AS rouge2, round(avg(bleu), 9) AS bleu FROM scored""")
def plain_explanation_scores(spark, d):
    """``explanation_scores`` of words as they are."""
    df = _parsed(spark, d).withColumn("explanation", F.concat_ws(" ", F.lit("because the"), "event_type", (F.col("event_id") % 7).cast("string"), F.lit("says no indeed")))
    return V.explanation_scores(df, stemmed=False).select(*(F.round(c, 9).alias(c) for c in ("rouge1", "rouge2", "bleu")))


@query("SELECT user_id, avg(value) AS mean_score, sum(value) AS sum_score FROM events GROUP BY 1")
def entailment_mean(spark, d):
    return V.entailment(table(spark, d, "events"), "user_id", "value")


@query("SELECT avg(m) AS macro_mean FROM (SELECT avg(value) AS m FROM events GROUP BY event_type)")
def macro_mean(spark, d):
    return V.macro_mean(table(spark, d, "events"), "event_type", "value")
