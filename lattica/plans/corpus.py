"""Curation, statistics, statement pairs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import union_all
from ..functions import text as T
from ..functions.trees import is_json, leaves
from ..operators import corpus as C
from ..operators import pairs as P
from ..operators import prompts as M
from ..operators import stats as S
from . import CHOICE, query, table

_ONE_SYSTEM = "SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 1"
_FORMATTED = f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS note_order, role, text, length(text)::BIGINT AS n_chars
  FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL AND conv_id IN ({_ONE_SYSTEM})"""


def _formatted(spark, d):
    return C.format_notes(table(spark, d, "conversations"), "conv_id", ["turn", "text"], ["conv_id", "turn", "role", "text"], F.col("role") == "system")


def _out(df, *more):
    return df.select("conv_id", F.col("NOTE_ORDER").alias("note_order"), "role", F.length("text").cast("long").alias("n_chars"), *more)


@query(f"SELECT conv_id, note_order, role, n_chars FROM ({_FORMATTED})")
def admission_format(spark, d):
    return _out(_formatted(spark, d))


@query(f"WITH f AS ({_FORMATTED}) SELECT conv_id, note_order, role, n_chars FROM f WHERE conv_id IN (SELECT conv_id FROM f GROUP BY 1 HAVING count(*) <= 7 AND max(n_chars) <= 400)")
def admission_filter(spark, d):
    return _out(C.filter_groups(_formatted(spark, d), "conv_id", [C.note_count(7), C.longest(F.length("text"), 400)]))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT conv_id FROM conversations ORDER BY conv_id, turn, text LIMIT 50))")
def admission_cap(spark, d):
    return C.cap_groups(table(spark, d, "conversations"), "conv_id", ["conv_id", "turn", "text"], 50).select("conv_id", "turn", "role")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_processed(spark, d):
    return C.without(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


_HEADED = "CASE WHEN doc_id % 3 = 0 THEN concat('Name: x\nHOSPITAL COURSE: ', text, '\n\nPlan: none') WHEN doc_id % 3 = 1 THEN concat(text, '\n\nHistory:\n', text) ELSE text END"


@query(rf"""WITH h AS (SELECT doc_id, source, {_HEADED} AS body FROM documents),
 m AS (SELECT doc_id, source, regexp_matches(body, '(?i)(history of present illness|history|hospital course|present illness):') AS found,
   regexp_extract(body, '(?i)(history of present illness|history|hospital course|present illness):\s*([^\n]*(?:\n[^\n]+)*(?:\n\z)?)', 2) AS s FROM h)
 SELECT doc_id, CASE WHEN found AND source IS DISTINCT FROM 'src3' THEN length(s)::BIGINT END AS section_chars, CASE WHEN found AND source IS DISTINCT FROM 'src3' THEN md5(s) END AS section_md5 FROM m""")
def section_extract(spark, d):
    df = table(spark, d, "documents").withColumn("body", F.expr(_HEADED.replace("\n", "\\n")))
    return C.sections(df, "body", T.differs(F.col("source"), "src3")).select("doc_id", F.length("BHC").cast("long").alias("section_chars"), F.md5("BHC").alias("section_md5"))


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def first_k_per_category(spark, d):
    return C.first_k(table(spark, d, "documents"), "source", ["doc_id"], 5).select("doc_id", "source", "n_chars")


@query("SELECT lang, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share FROM documents GROUP BY lang")
def category_share(spark, d):
    return S.shares(table(spark, d, "documents"), "lang")


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 50)")
def category_at_least(spark, d):
    return S.at_least(table(spark, d, "documents"), "source", 50).select("doc_id", "source")


@query("""WITH c AS (SELECT event_type, event_id % 97 AS k FROM events), n AS (SELECT k, count(*) AS n FROM c GROUP BY 1),
 r AS (SELECT string_agg(k::VARCHAR, ', ' ORDER BY k::VARCHAR) AS names FROM n WHERE n < 104)
 SELECT CASE WHEN n.n < 104 THEN 'Others (' || names || ')' ELSE c.k::VARCHAR END AS bucket, count(*) AS n FROM c JOIN n USING (k), r GROUP BY 1""")
def rare_bucket(spark, d):
    df = table(spark, d, "events").select((F.col("event_id") % 97).cast("string").alias("bucket"))
    return S.collapse_rare(df, "bucket", 104).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, CASE WHEN n_chars < 0 THEN 0 WHEN n_chars >= 10000 THEN 21 ELSE floor(n_chars / 500.0)::BIGINT + 1 END AS bin, count(*) AS n FROM documents GROUP BY 1, 2""")
def length_histogram(spark, d):
    return S.histogram(table(spark, d, "documents"), F.col("n_chars").cast("double"), 0.0, 10000.0, 20, ["lang"])


@query("""WITH w AS (SELECT lang, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x{85}\\x0B]+'), lambda x: x <> '') AS ws FROM documents),
 r AS (SELECT lang, len(list_filter(ws, lambda x: length(x) > 8)) / nullif(len(ws), 0)::DOUBLE AS v FROM w)
 SELECT lang, round(avg(v), 4) AS diversity, count(*) AS n FROM r GROUP BY 1""")
def diversity_by_category(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: F.length(w) > 8)
    return S.diversity(table(spark, d, "documents"), "lang", "text", F.size(words))


_MCQ = """SELECT event_id AS id, concat('Which value is right', CASE WHEN event_id % 11 = 0 THEN ' except one?' WHEN event_id % 13 = 0 THEN ' Except one?' ELSE '?' END) AS question,
 CASE WHEN event_id % 17 = 0 THEN 'TRUE' ELSE concat('a', event_id % 5) END AS opa, concat('b', event_id % 7) AS opb, concat('c', user_id) AS opc,
 CASE WHEN event_id % 7 = 0 THEN 'All of the Above' ELSE concat('d', event_type) END AS opd, CAST(event_id % 4 AS INT) AS cop FROM events"""
_VALID = "contains(lower(opd), 'the above') OR contains(question, 'except') OR contains(lower(concat(opa, '|', opb, '|', opc, '|', opd)), 'true') OR contains(lower(concat(opa, '|', opb, '|', opc, '|', opd)), 'false')"


def _mcq(spark, d):
    table(spark, d, "events").createOrReplaceTempView("lattica_events")
    return spark.sql(_MCQ.replace("FROM events", "FROM lattica_events"))


@query(f"SELECT id, question, opd FROM ({_MCQ}) WHERE NOT ({_VALID})")
def mcq_filter(spark, d):
    return P.valid_choice_question(_mcq(spark, d)).select("id", "question", "opd")


@query(f"""WITH m AS (SELECT * FROM ({_MCQ}) WHERE NOT ({_VALID})), o AS (SELECT id, cop, [opa, opb, opc, opd] AS os,
   list_filter([0, 1, 2, 3], lambda k: k <> cop) AS wrong FROM m),
 w AS (SELECT id, os, cop, wrong[(('0x' || substr(md5(id::VARCHAR), 1, 8))::BIGINT % 3) + 1] AS pick FROM o)
 SELECT id, true AS is_correct, os[cop + 1] AS answer FROM w UNION ALL SELECT id, false, os[pick + 1] FROM w""")
def pos_neg_pairs(spark, d):
    df = P.valid_choice_question(_mcq(spark, d))
    options = F.create_map(*(x for k, c in enumerate(("opa", "opb", "opc", "opd")) for x in (F.lit(str(k)), F.col(c))))
    return P.two_answers(df, options, F.col("cop").cast("string"), F.col("id")).select("id", "is_correct", "answer")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_seen_dedupe(spark, d):
    return P.first_seen(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH f AS (SELECT *, value > 50 AS label FROM events), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, label ORDER BY event_id) AS r FROM f WHERE label IS NOT NULL) WHERE r = 1)
 SELECT user_id, event_type, max(props) FILTER (label) AS factual, max(props) FILTER (NOT label) AS hallucinated FROM u GROUP BY 1, 2 HAVING count(DISTINCT label) = 2""")
def both_labels_pairs(spark, d):
    df = table(spark, d, "events").withColumn("label", F.col("value") > 50).filter("label is not null")
    seen = P.first_seen(df, ["user_id", "event_type", "label"], ["event_id"])
    return P.pivot_pairs(P.having_both(seen, ["user_id", "event_type"], "label"), ["user_id", "event_type"], "label", "props")


@query("""WITH b AS (SELECT doc_id, text, substr(text, 1, 200) AS abstract, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 1, 50) END AS short FROM documents)
 SELECT doc_id, pair, md5(t) AS text_md5, md5(s) AS summary_md5 FROM (SELECT doc_id, 'text-abstract' AS pair, text AS t, abstract AS s FROM b
 UNION ALL SELECT doc_id, 'text-short', text, short FROM b UNION ALL SELECT doc_id, 'abstract-short', abstract, short FROM b) WHERE length(t) > 0 AND length(s) > 0""")
def three_way_union(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", F.substring("text", 1, 200).alias("abstract"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.substring("text", 1, 50)).alias("short"))
    got = P.projections(df, ["doc_id"], [("text-abstract", "text", "abstract"), ("text-short", "text", "short"), ("abstract-short", "abstract", "short")])
    return got.select("doc_id", "pair", F.md5("text").alias("text_md5"), F.md5("summary").alias("summary_md5"))


@query("SELECT doc_id, quality::INTEGER AS quality, NULL::BIGINT AS n_chars FROM labels UNION ALL SELECT doc_id, NULL, n_chars FROM documents")
def null_filled_union(spark, d):
    return union_all([table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), table(spark, d, "documents").select("doc_id", "n_chars")], fill=True)


@query("SELECT doc_id FROM documents WHERE length(text) + length(source) < 30000")
def length_filtered(spark, d):
    return table(spark, d, "documents").filter(F.length("text") + F.length("source") < 30000).select("doc_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))")
def task_balanced(spark, d):
    return C.balanced(table(spark, d, "documents"), "lang", ["doc_id"]).select("doc_id", "lang")


@query("WITH b AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS b FROM documents) SELECT doc_id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'val' ELSE 'test' END AS split FROM b")
def hash_split(spark, d):
    return C.split(table(spark, d, "documents"), "doc_id").select("doc_id", "split")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
 SELECT doc_id, lang FROM r WHERE r <= floor(CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 1.0 WHEN 'fr' THEN 0.25 END * n)""")
def mix_fractions(spark, d):
    return C.mix(table(spark, d, "documents"), "lang", ["doc_id"], {"en": 0.5, "de": 1.0, "fr": 0.25}).select("doc_id", "lang")


@query("SELECT doc_id, md5(concat(doc_id::VARCHAR, '|42')) AS shuffle_key FROM documents")
def seeded_shuffle(spark, d):
    return C.shuffled(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "shuffle_key")


_GROUPED = "SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE text IS NOT NULL AND role <> 'system'"


@query(f"SELECT conv_id, md5('Notes:\n' || string_agg('### Clinical note ' || r || '\n' || text, '\n\n' ORDER BY r)) AS prompt_md5, count(*) AS n FROM ({_GROUPED}) GROUP BY 1")
def group_prompt(spark, d):
    df = table(spark, d, "conversations").filter("role <> 'system'")
    n = df.filter("text is not null").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return M.group_texts(df, ["conv_id"], "turn", "text", template="Notes:\n{notes}").join(n, "conv_id").select("conv_id", F.md5("prompt").alias("prompt_md5"), "n")


@query("SELECT DISTINCT conv_id, domain, 'Summarise for ' || domain || ': ' || conv_id AS prompt FROM conversations, (VALUES ('Radiology'), ('Nursing/Other'), ('ECG')) v(domain)")
def domain_prompt_cross(spark, d):
    df = M.for_domains(table(spark, d, "conversations").select("conv_id").distinct(), ["Radiology", "Nursing/Other", "ECG"])
    return df.withColumn("prompt", M.render("Summarise for {domain}: {id}", domain=F.col("domain"), id=F.col("conv_id")))


@query(f"""WITH p AS (SELECT conv_id, count(*) AS n FROM ({_GROUPED}) WHERE conv_id % 3 <> 0 GROUP BY 1)
 SELECT c.conv_id, c.turn, 'notes: ' || p.n AS prompt FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id WHERE c.role = 'user'""")
def left_join_prompt(spark, d):
    df = table(spark, d, "conversations")
    p = df.filter("role <> 'system' and text is not null and conv_id % 3 <> 0").groupBy("conv_id").agg(F.concat(F.lit("notes: "), F.count(F.lit(1)).cast("string")).alias("prompt"))
    return df.filter("role = 'user'").select("conv_id", "turn").join(p, "conv_id", "left")


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'None' WHEN 2 THEN '' ELSE props END AS context, event_type AS statement, value > 50 AS label FROM events),
 t AS (SELECT event_id, CASE WHEN context IS NULL OR context IN ('None', '') THEN '' ELSE 'Context:\n' || context || '\n\n' END || 'Statement: ' || statement || '\n\nIs the statement factual?'
   || '\n### Factual: ' || CASE WHEN label THEN 'YES' ELSE 'NO' END || '\n### Explanation: ' || '<end>' AS text FROM s) SELECT event_id, text FROM t""")
def format_sample(spark, d):
    df = table(spark, d, "events")
    context = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "None").when(F.col("event_id") % 4 == 2, "").otherwise(F.col("props"))
    return df.select("event_id", M.sample(context, F.col("event_type"), F.col("value") > 50, F.lit(None).cast("string"), "<end>").alias("text"))


@query("SELECT event_id, '<|system|>Answer.\n<|user|>one\n<|assistant|>two\n<|user|>' || event_type AS chat FROM events")
def chat_struct(spark, d):
    messages = M.chat(F.lit("Answer."), F.lit("one"), F.lit("two"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", M.chat_text(messages).alias("chat"))


_ENTRIES = "SELECT user_id, event_id % 3 AS note, event_id, event_type AS label, CASE WHEN event_id % 5 = 0 THEN 'N/A' WHEN event_id % 2 = 0 THEN concat(' V', event_id % 4) ELSE concat('v', event_id % 4) END AS value FROM events"


@query(f"""WITH e AS ({_ENTRIES}), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, note, lower(trim(value)) ORDER BY event_id) AS r FROM e WHERE value <> 'N/A'),
 n AS (SELECT user_id, note, string_agg('- ' || label || ' : ' || value || '\n', '' ORDER BY event_id) AS t FROM k WHERE r = 1 GROUP BY 1, 2),
 z AS (SELECT user_id, note, t, row_number() OVER (PARTITION BY user_id ORDER BY note) AS i FROM n),
 g AS (SELECT user_id, string_agg('### Clinical note ' || i || '\n' || t, '\n' ORDER BY i) AS prompt FROM z GROUP BY 1)
 SELECT u.user_id, md5(coalesce(g.prompt, 'N/A')) AS prompt_md5 FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN g ON u.user_id = g.user_id""")
def entry_prompt(spark, d):
    table(spark, d, "events").createOrReplaceTempView("lattica_events")
    df = spark.sql(_ENTRIES.replace("FROM events", "FROM lattica_events"))
    return M.group_entries(df, "user_id", "note", "event_id", "label", "value", distinct=True, bullet="- ").select("user_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 9 = 0 THEN 'no {' ELSE props END) AS valid FROM events")
def json_valid(spark, d):
    return table(spark, d, "events").select("event_id", is_json(F.when(F.col("event_id") % 9 == 0, "no {").otherwise(F.col("props"))).alias("valid"))


@query("""WITH j AS (SELECT event_id, props, (props::JSON ->> '$.k') AS k FROM events) SELECT event_id, 0 AS pos, 'items/0/k' AS path, coalesce(k, 'None') AS value FROM j
 UNION ALL SELECT event_id, 1, 'items', 'text' FROM j UNION ALL SELECT event_id, 2, 'none', 'None' FROM j""")
def json_leaves(spark, d):
    tree = F.concat(F.lit('{"items": ['), F.col("props"), F.lit(', "text"], "none": null}'))
    df = table(spark, d, "events").select("event_id", F.explode(leaves(tree)).alias("l"))
    return df.select("event_id", F.col("l.pos").alias("pos"), F.array_join("l.path", "/").alias("path"), F.col("l.value").alias("value"))


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS pc, lag(event_id % 2) OVER w AS pi, event_id % 2 AS idx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 n AS (SELECT *, sum(CASE WHEN pc IS NOT DISTINCT FROM event_type AND pi IS NOT DISTINCT FROM idx THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
 SELECT event_id, first_value(props) OVER (PARTITION BY user_id, run ORDER BY event_id) AS reference FROM n""")
def run_first_value(spark, d):
    df = table(spark, d, "events").withColumn("idx", F.col("event_id") % 2)
    return P.run_first(df, "user_id", "event_id", "event_type", "idx", "props", "reference").select("event_id", "reference")


@query(r"""WITH q AS (SELECT event_id, concat('Seen on day ', event_id % 30, '. Value is ', event_type, CASE WHEN event_id % 3 = 0 THEN '. Which type is it?' WHEN event_id % 3 = 1 THEN '.' ELSE '! Why?' END) AS t FROM events)
 SELECT event_id, CASE WHEN t LIKE '%?' THEN regexp_extract(t, '(?s)\A(.*?)([^.!?]+\?)\n?\z', 1) END AS context, CASE WHEN t LIKE '%?' THEN regexp_extract(t, '(?s)\A(.*?)([^.!?]+\?)\n?\z', 2) END AS question FROM q""")
def question_split(spark, d):
    t = F.concat(F.lit("Seen on day "), (F.col("event_id") % 30).cast("string"), F.lit(". Value is "), "event_type", F.when(F.col("event_id") % 3 == 0, ". Which type is it?").when(F.col("event_id") % 3 == 1, ".").otherwise("! Why?"))
    return table(spark, d, "events").select("event_id", T.split_question(t).alias("q")).select("event_id", "q.context", "q.question")


@query("""WITH a AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' There is NO INFORMATION on it ' WHEN 1 THEN 'n/a.' WHEN 2 THEN 'It does not mention pain' ELSE concat('  ', event_type, ' ') END AS t FROM events)
 SELECT event_id, CASE WHEN contains(lower(t), 'n/a') OR contains(lower(t), 'no information') OR contains(lower(t), 'does not mention') OR contains(lower(t), 'no mention') THEN 'N/A' ELSE trim(t) END AS answer FROM a""")
def answer_normalise(spark, d):
    k = F.col("event_id") % 5
    t = F.when(k == 0, " There is NO INFORMATION on it ").when(k == 1, "n/a.").when(k == 2, "It does not mention pain").otherwise(F.concat(F.lit("  "), "event_type", F.lit(" ")))
    return table(spark, d, "events").select("event_id", T.normalize_answer(t).alias("answer"))


@query("""WITH r AS (SELECT event_id, replace(replace(concat(CASE event_id % 4 WHEN 0 THEN 'Nursing' WHEN 1 THEN 'ECG' WHEN 2 THEN 'Nursing/Other' ELSE event_type END, ' and ', props, ' of Nursing'), 'Nursing', 'clinical'), 'ECG', 'clinical') AS t FROM events) SELECT event_id, t AS masked, lower(translate(event_type || ' A/b', ' /', '__')) AS slug FROM r JOIN events USING (event_id)""")
def mask_and_slug(spark, d):
    k = F.col("event_id") % 4
    said = F.concat(F.when(k == 0, "Nursing").when(k == 1, "ECG").when(k == 2, "Nursing/Other").otherwise(F.col("event_type")), F.lit(" and "), "props", F.lit(" of Nursing"))
    return table(spark, d, "events").select("event_id", T.mask_domains(said, ["Nursing", "ECG", "Nursing/Other"]).alias("masked"), T.slug(F.concat("event_type", F.lit(" A/b"))).alias("slug"))


@query("SELECT event_id, f.factual, event_type FROM events, (VALUES (true), (false)) f(factual)")
def label_both_ways(spark, d):
    return P.both_ways(table(spark, d, "events")).select("event_id", "factual", "event_type")


@query(f"""WITH p AS (SELECT *, {CHOICE.format("event_id::VARCHAR")} AS h FROM events),
 a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h % 64, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM p),
 w AS (SELECT *, CASE WHEN n > 1 THEN (place + h % greatest(n - 1, 1) + 1) % n END AS want FROM a)
 SELECT w.event_id, w.event_type, w.props, b.props AS other_value FROM w LEFT JOIN a b ON b.event_type = w.event_type AND b.place = w.want""")
def swapped_values(spark, d):
    return P.swapped_value(table(spark, d, "events"), "event_type", "props", ["event_id"], F.col("event_id")).select("event_id", "event_type", "props", "other_value")


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}_])(dr|mr|mrs|ms|prof|st|vs|etc|e\.g|i\.e|fig|no|approx|[A-Z])\.(\s)', '\1\2' || chr(1) || '\3', 'g'), '(?i)(^|[^\p{{L}}\p{{N}}_])(dr|mr|mrs|ms|prof|st|vs|etc|e\.g|i\.e|fig|no|approx|[A-Z])\.(\s)', '\1\2' || chr(1) || '\3', 'g'),
   '([.!?]["'')\]]*)\s+(["''(\[]?[\p{{Lu}}\d])', '\1' || chr(2) || '\2', 'g') AS t FROM documents),
 s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(2)), lambda x: regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM m),
 c AS (SELECT doc_id, s, len(s) AS n, {CHOICE.format("doc_id::VARCHAR")} % greatest(len(s) - 1, 1) AS k FROM s)
 SELECT doc_id, CASE WHEN n < 2 THEN '' ELSE s[k + 1] END AS sentence, CASE WHEN n < 2 THEN '' ELSE array_to_string(s[1:k], ' ') END AS before, CASE WHEN n < 2 THEN '' ELSE array_to_string(s[k + 2:], ' ') END AS after, n::INT AS n_sentences FROM c""")
def sentence_around(spark, d):
    return table(spark, d, "documents").select("doc_id", P.split_sentence(T.sentences(F.col("text")), F.col("doc_id")).alias("s")).select("doc_id", "s.*")
