"""Text functions, prompts and chats over rows made from events, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T
from ..functions import trees
from ..operators import prompts as M
from ..operators import sentences as S
from . import CHOICE, query, sql_over, table


def _rows(spark, d, sql, *names):
    return sql_over(spark, d, sql, *names)


_SAID = """SELECT event_id, event_type, props, concat(CASE event_id % 3 WHEN 0 THEN 'The man ' WHEN 1 THEN 'A woman ' ELSE 'Someone ' END, 'made a ', event_type) AS a,
 concat(CASE event_id % 4 WHEN 0 THEN 'The male ' WHEN 1 THEN 'A girl ' ELSE 'The other boy ' END, 'saw ', event_type) AS b,
 concat('Text on ', event_type, CASE WHEN event_id % 2 = 0 THEN concat(' keywords: ', props, ' more') ELSE '' END) AS k,
 concat(CASE event_id % 4 WHEN 0 THEN 'Ans. is (b) ' WHEN 1 THEN 'Answer: C i.e. ' WHEN 2 THEN 'ans-' ELSE '' END, event_type, ' is it') AS x FROM events"""


@query(rf"""WITH q AS ({_SAID}) SELECT event_id, regexp_replace(k, 'keywords[\s\S]*', '', 'g') AS plain,
 regexp_replace(x, '(?i)Ans(?:wer|wee)*(?:\.|:)* *(?:is)* *(?:\(|''|"|-)* *[?:a-d|A-D]* *(?:\(|\)|''|")* *(?:i\.e\.|:)*(?:\.|,)*', '', 'g') AS answer,
 CASE WHEN regexp_matches(a, '(?i)\s(?:male|man|boy)') AND regexp_matches(b, '(?i)\s(?:male|man|boy)') THEN regexp_replace(b, '\s(?:male|man|boy)', ' female', 'g')
  WHEN NOT regexp_matches(a, '(?i)\s(?:male|man|boy)') AND NOT regexp_matches(b, '(?i)\s(?:male|man|boy)') THEN regexp_replace(b, '\s(?:female|woman|girl)', ' male', 'g') ELSE b END AS swapped FROM q""")
def text_repairs(spark, d):
    return _rows(spark, d, _SAID, "events").select("event_id", T.strip_keywords(F.col("k")).alias("plain"), T.strip_answer(F.col("x")).alias("answer"), T.swap_gender(F.col("a"), F.col("b")).alias("swapped"))


_PARTS = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS before, concat('  ', upper(event_type), ' ') AS middle, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS after FROM events"


@query(f"""WITH q AS ({_PARTS}) SELECT event_id, trim(before || ' ' || trim(lower(middle)) || ' ' || coalesce(after, 'end')) AS summary, coalesce(nullif(before, ''), 'none given') AS explanation, 'According to the context, ' || middle AS prefixed,
 replace(middle || 'x' || middle, middle, '') AS without, CASE event_id % 3 WHEN 0 THEN 'en ' || event_id WHEN 1 THEN 'fr ' || event_id ELSE '' END AS told FROM q""")
def text_assembly(spark, d):
    k = F.col("event_id") % 3
    told = F.when(k == 0, F.create_map(F.lit("en"), F.concat(F.lit("en "), "event_id"))).when(k == 1, F.create_map(F.lit("fr"), F.concat(F.lit("fr "), "event_id"), F.lit("en"), F.lit("no"))).otherwise(F.create_map(F.lit("de"), F.lit("nein")))
    return _rows(spark, d, _PARTS, "events").select(
        "event_id", T.fake_summary(F.col("before"), F.col("middle"), F.coalesce("after", F.lit("end"))).alias("summary"), T.default_explanation(F.col("before"), "none given").alias("explanation"),
        T.prefixed(F.col("middle")).alias("prefixed"), T.without_text(F.concat("middle", F.lit("x"), "middle"), F.col("middle")).alias("without"), T.in_locale(told, "fr").alias("told"))


_FEW = "SELECT event_id, concat('One ', event_type, '.', CASE WHEN event_id % 2 = 0 THEN ' Two here!' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN ' Is it three? Yes.' ELSE '' END) AS t FROM events"
_LISTED = "list_filter(['One ' || event_type || '.', CASE WHEN event_id % 2 = 0 THEN 'Two here!' END, CASE WHEN event_id % 3 = 0 THEN 'Is it three?' END, CASE WHEN event_id % 3 = 0 THEN 'Yes.' END], lambda x: x IS NOT NULL)"


@query(f"""WITH q AS (SELECT event_id, {_LISTED} AS s FROM events) SELECT event_id, len(s) = 1 AS single, CASE WHEN len(s) > 1 THEN array_to_string(s[1:len(s) - 1], ' ') END AS context,
 (list_filter(s, lambda x: length(x) > 9))[({CHOICE.format("event_id::VARCHAR")} % greatest(len(list_filter(s, lambda x: length(x) > 9)), 1)) + 1] AS long,
 array_to_string(list_transform(s, lambda x, i: '<|s' || i || '|><' || x || '><end||s>'), '') AS marked FROM q""")
def sentence_functions(spark, d):
    from ..operators.pairs import long_sentence

    s = T.sentences(F.col("t"))
    return _rows(spark, d, _FEW, "events").select("event_id", T.is_single_sentence(F.col("t")).alias("single"), T.all_but_last(s).alias("context"), long_sentence(s, F.col("event_id"), 9).alias("long"), T.annotate(s, "s").alias("marked"))


_CLAIMED = """SELECT event_id, concat('<|r', event_id % 4 + 1, '|><It is ', event_type, '.><|subclaims|><one><two><end||subclaims><|cite|><|s1|,|s3|-|s', event_id % 3 + 3, '|><end||cite><|explain|><why ', event_id, '><end||explain><|',
 CASE WHEN event_id % 2 = 0 THEN 'un' ELSE '' END, 'supported|><end||r><|r9|><Fine.><|subclaims|><end||subclaims><end||r>') AS response FROM events"""


@query("""SELECT event_id, event_id % 4 + 1 AS claim_id, 'It is ' || event_type || '.' AS claim, 'one,two' AS subclaims, array_to_string(list_concat([1], range(3, event_id % 3 + 4)), ',') AS citations, 'why ' || event_id AS rationale, event_id % 2 = 1 AS supported FROM events
 UNION ALL SELECT event_id, 9, 'Fine.', '', '', '', true FROM events""")
def claim_parse(spark, d):
    df = _rows(spark, d, _CLAIMED, "events").select("event_id", F.explode(trees.claims(F.col("response"))).alias("c")).select("event_id", "c.*")
    return df.select("event_id", F.col("claim_id").cast("long").alias("claim_id"), F.col("claim_string").alias("claim"), F.array_join("subclaims", ",").alias("subclaims"), F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"), "rationale", "supported")


_STORED = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('{"k": "', event_type, '", "n": "', event_id, '"}') WHEN 1 THEN concat('[{"k": "', event_type, '"}, {"k": "other"}]') WHEN 2 THEN 'no map' WHEN 3 THEN NULL ELSE '[]' END AS stored FROM events"""


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN event_type END AS k, CASE WHEN event_id % 5 = 0 THEN event_id::VARCHAR END AS n, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS size FROM events")
def stored_extractions(spark, d):
    df = _rows(spark, d, _STORED, "events").select("event_id", T.stored_map(F.col("stored")).alias("m"))
    return df.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("n")).alias("n"), F.size("m").alias("size"))


@query("SELECT event_id, event_type AS t, event_id % 7 AS v FROM events")
def encoded_cells(spark, d):
    coded = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("t"), (F.col("event_id") % 7).alias("v"))).alias("cell"))
    return coded.select("event_id", F.from_json("cell", "t string, v long").alias("c")).select("event_id", "c.*")


@query("""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hps' WHEN 1 THEN 'pn' WHEN 2 THEN 'h' ELSE 'ps' END AS m FROM events)
 SELECT event_id, CASE m WHEN 'hps' THEN 'H + P + S' WHEN 'pn' THEN 'P*' WHEN 'h' THEN 'H' ELSE 'P + S' END AS label, CASE m WHEN 'hps' THEN 3 WHEN 'ps' THEN 2 ELSE 1 END::INT AS params FROM c""")
def method_labels(spark, d):
    k = F.col("event_id") % 4
    label = T.method_label(F.when(k == 0, "hps").when(k == 1, "pn").when(k == 2, "h").otherwise("ps"))
    return table(spark, d, "events").select("event_id", label.alias("label")).select("event_id", "label", T.param_count(F.col("label")).alias("params"))


_SAMPLES = "SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'None' ELSE props END AS context, event_type AS statement FROM events"


@query(f"""WITH q AS (SELECT event_id, CASE WHEN context IS NULL OR context IN ('None', '') THEN '' ELSE 'Context:\n' || context || '\n\n' END || 'Statement: ' || statement || '\n\nIs the statement factual?' AS asked FROM ({_SAMPLES}))
 SELECT event_id, asked, 'Context:\nA dog.\n\nStatement: A cat.\n\nIs the statement factual?\n### Factual: NO\n### Explanation: It is a dog.' || '\n' || asked AS with_example FROM q""")
def inference_prompts(spark, d):
    asked = M.sample(F.col("context"), F.col("statement"))
    example = M.sample(F.lit("A dog."), F.lit("A cat."), F.lit(False), F.lit("It is a dog."))
    return _rows(spark, d, _SAMPLES, "events").select("event_id", asked.alias("asked"), M.one_shot(example, asked).alias("with_example"))


@query("""SELECT event_id, '<context>\n' || props || '\n</context>\n\n<claims>\n' || event_type || '\n</claims>' AS classifier,
 '<|context|><|s1|><One ' || event_type || '.><end||s><|s2|><Two.><end||s><end||context><|request|><' || event_type || '><end||request><|response|><|r1|><It is ' || event_type || '.><end||r><end||response>' AS generator FROM events""")
def claim_prompts(spark, d):
    context = F.concat(F.lit(" One "), "event_type", F.lit(". Two. "))
    made = M.claim_generator(context, F.concat(F.lit(" "), "event_type", F.lit("\n")), F.concat(F.lit("It is "), "event_type", F.lit(".")))
    return table(spark, d, "events").select("event_id", M.claim_check(F.col("props"), F.col("event_type")).alias("classifier"), made.alias("generator"))


@query("""SELECT event_id, 'Note:\n' || props || '\n\nIs it right that ' || event_type || ' : ' || event_id || '? Answer yes or no.' AS valid, 'Note:\n' || props || '\n\nDoes the note speak of ' || event_type || '? Answer yes or no.' AS present FROM events""")
def extraction_checks(spark, d):
    slots = {"note": F.col("props"), "label": F.col("event_type"), "value": F.col("event_id")}
    return table(spark, d, "events").select("event_id", M.render(M.VALID_VALUE, **slots).alias("valid"), M.render(M.PRESENT, note=F.col("props"), label=F.col("event_type")).alias("present"))


@query("""SELECT event_id, 'notes' AS kind, 'Note: ' || props || '\nExtraction: ' || event_type || '\n\nIs the extraction factual? Answer YES or NO only.' AS prompt FROM events
 UNION ALL SELECT event_id, 'choices', 'Question: ' || props || '\nAnswer: ' || event_id || '\nStatement: ' || event_type || '\n\nDoes the statement say what the answer says? Answer YES or NO only.' FROM events
 UNION ALL SELECT event_id, 'cases', 'Context: ' || user_id || '\nQuestion: ' || props || '\nAnswer: ' || event_id || '\nStatement: ' || event_type || '\n\nDoes the statement say what the answer says? Answer YES or NO only.' FROM events
 UNION ALL SELECT event_id, 'papers', 'First: ' || lower(props) || '\nSecond: ' || lower(event_type) || '\n\nDo the sentences contradict each other? Answer YES or NO only.' FROM events""")
def validator_prompts(spark, d):
    out, props, kind = F.col("event_type"), F.col("props"), lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("prompt"))
    each = F.array(
        kind("notes", M.validation("notes", note=props, output=out)), kind("choices", M.validation("choices", question=props, answer=F.col("event_id"), output=out)),
        kind("cases", M.validation("cases", context=F.col("user_id"), question=props, answer=F.col("event_id"), output=out)), kind("papers", M.validation("papers", sentence=props, output=out)))
    return table(spark, d, "events").select("event_id", F.explode(each).alias("e")).select("event_id", "e.*")


@query("""SELECT event_id, 'Instruction: Premise: ' || props || '\nHypothesis: ' || event_type || '\n\nDoes the hypothesis follow from the premise? Answer yes or no.\nResponse A: Yes\nResponse B: No\nRubric: factuality\nSay which response is better, ending in [RESULT] A or B.' AS prompt
 FROM events WHERE event_type IS DISTINCT FROM 'click'""")
def entailment_prompts(spark, d):
    rows = table(spark, d, "events").filter(T.differs(F.col("event_type"), "click"))
    return rows.select("event_id", M.entailment_judge(F.col("props"), F.col("event_type")).alias("prompt"))


@query("""WITH x(c, u, a) AS (SELECT event_type, 'u ' || event_type, 'a ' || event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type <> 'view')
 SELECT event_id, '<|system|>Answer.\n<|user|>' || coalesce(u, '') || '\n<|assistant|>' || coalesce(a, '') || '\n<|user|>' || props AS chat,
  '<|user|>Answer.\n\n' || coalesce(u, '') || '\n<|assistant|>' || coalesce(a, '') || '\n<|user|>' || props AS plain, '<|system|>Summarise the user''s note in at most 250 words and write nothing else.\n<|user|>' || props AS summary FROM events LEFT JOIN x ON c = event_type""")
def chats(spark, d):
    df = table(spark, d, "events")
    examples = df.select("event_type").distinct().filter("event_type <> 'view'").select(F.col("event_type").alias("concept"), F.concat(F.lit("u "), "event_type").alias("user"), F.concat(F.lit("a "), "event_type").alias("assistant"))
    filled = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    got = M.one_shot_chats(df, examples, "event_type", "Answer.", F.col("props")).withColumn("chat", filled("chat"))
    return got.select("event_id", M.chat_text(F.col("chat")).alias("chat"), M.chat_text(F.col("chat"), system_role=False).alias("plain"), M.chat_text(M.summary_chat(F.col("props"))).alias("summary"))


@query("""SELECT user_id, md5('Notes:\n' || string_agg('### Clinical note ' || r || '\n' || props, '\n\n' ORDER BY r)) AS prompt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, props) AS r FROM events WHERE props IS NOT NULL) WHERE r <= 3 GROUP BY 1""")
def first_notes_prompt(spark, d):
    got = M.group_texts(table(spark, d, "events"), ["user_id"], "event_id", "props", template="Notes:\n{notes}", most=3)
    return got.select("user_id", F.md5("prompt").alias("prompt_md5"))


_PRUNED = "SELECT user_id, event_id % 3 AS note, event_id, event_type AS label, CASE WHEN event_id % 5 = 0 THEN 'N/A' ELSE concat('v', event_id % 4) END AS value FROM events"


@query(f"""WITH n AS (SELECT user_id, note, string_agg(label || ' : ' || value || '\n', '' ORDER BY event_id) AS t FROM ({_PRUNED}) WHERE value <> 'N/A' GROUP BY 1, 2),
 z AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY note) AS i FROM n), g AS (SELECT user_id, string_agg('### Clinical note ' || i || '\n' || t, '\n' ORDER BY i) AS prompt FROM z GROUP BY 1),
 a AS (SELECT u.user_id, coalesce(prompt, 'N/A') AS prompt FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g ON u.user_id = g.user_id)
 SELECT user_id, md5(prompt) AS prompt_md5, 'said ' || length(prompt) AS normal_ECG_verbalized FROM a""")
def verbalised_concepts(spark, d):
    from ..operators import extraction as X
    from ..operators import shards as G

    said = lambda: G.blocking(lambda p: f"said {len(p)}")
    got = X.verbalised(_rows(spark, d, _PRUNED, "events"), "user_id", "note", "event_id", "label", "value", "normal_ECG", said)
    return got.select("user_id", F.md5("normal_ECG_verbalizer_prompt").alias("prompt_md5"), "normal_ECG_verbalized")


@query(f"""WITH e AS (SELECT *, lower(trim(value)) AS nv FROM ({_PRUNED}) WHERE value <> 'N/A'), k AS (SELECT *, row_number() OVER (PARTITION BY user_id, note, nv ORDER BY event_id) AS r FROM e),
 o AS (SELECT user_id, note, label, arg_max(value, event_id) AS value FROM k WHERE r = 1 GROUP BY 1, 2, 3), z AS (SELECT user_id, note, string_agg(label || '=' || value, ',' ORDER BY label) AS m FROM o GROUP BY 1, 2)
 SELECT u.user_id, coalesce(string_agg(m, '|' ORDER BY note), '') AS structure FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN z ON u.user_id = z.user_id GROUP BY 1""")
def entry_structure(spark, d):
    got = M.group_entries(_rows(spark, d, _PRUNED, "events"), "user_id", "note", "event_id", "label", "value", distinct=True, bullet="- ", structure="structure")
    line = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return got.select("user_id", F.array_join(F.transform(F.coalesce("structure", F.array().cast("array<map<string,string>>")), line), "|").alias("structure"))


_TOK, _SPACED_TOK, _FORM, _NUMBER = r"[^\x09-\x0D\x20]+", r"[^\x09-\x0D\x20]+[\x09-\x0D\x20]*", r"(?s)^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}.!?]*$", r"^[0-9]+(?:[.,:-][0-9]+)*$"
_ENDS = """[.!?]["'')\\]]*$"""


def _form(t):
    return f"lower(regexp_extract({t}, '{_FORM}', 1))"


def _kind(t):
    bare = rf"regexp_replace({_form(t)}, '\.$', '')"
    return f"CASE WHEN regexp_matches({bare}, '{_NUMBER}') THEN '##' ELSE {bare} END"


def _together(p, n, m):
    term = lambda n, p: f"CASE WHEN {n} = 0 THEN 0.0 ELSE ({n}) * ln({p}) END"
    return f"CASE WHEN ({p}) <= 0 OR ({p}) >= 1 OR ({p}) IS NULL THEN 0.0 ELSE {term(n, p)} + {term(m, f'1 - {p}')} END"


def _ratio(rest="total - a - b + ab"):
    p, p1, p2 = "(b / total::DOUBLE)", "(ab / a::DOUBLE)", "((b - ab) / nullif(total - a, 0)::DOUBLE)"
    return f"-2 * (({_together(p, 'ab', 'a - ab')}) + ({_together(p, 'b - ab', rest)}) - ({_together(p1, 'ab', 'a - ab')}) - ({_together(p2, 'b - ab', rest)}))"


_LEARNT = rf"""w AS (SELECT coalesce(lang, '') AS lang, regexp_extract_all(text, '{_TOK}') AS w FROM documents), p AS (SELECT lang, w[i] AS token, w[i + 1] AS following FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
 r AS (SELECT lang, {_kind("token")} AS word, {_form("token")} AS f, regexp_matches(token, '{_ENDS}') AS ends, {_kind("following")} AS next FROM p WHERE {_form("token")} <> ''),
 c AS (SELECT lang, word, count(*) AS n, count(*) FILTER (f LIKE '%.') AS k FROM r GROUP BY 1, 2), t AS (SELECT lang, sum(n) AS total, sum(k) AS periods FROM c GROUP BY 1),
 short AS (SELECT * FROM (SELECT lang, word, k, -2 * ((k * ln(periods / total::DOUBLE) + CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - periods / total::DOUBLE) END) - (k * ln(0.99::DOUBLE) + (n - k) * ln(1 - 0.99::DOUBLE)))
  * exp(-length(replace(word, '.', ''))::DOUBLE) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', ''))::DOUBLE, -(n - k)::DOUBLE) AS score
  FROM c JOIN t USING (lang) WHERE k > 0 AND periods < total AND regexp_matches(word, '\p{{L}}')) WHERE score >= 0.3),
 f AS (SELECT r.lang, r.word, f LIKE '%.' AS period, next, f LIKE '%.' AND s.word IS NOT NULL AS short, count(*) AS ab FROM r LEFT JOIN short s ON s.lang = r.lang AND s.word = r.word WHERE ends AND next <> '' GROUP BY ALL),
 sure AS (SELECT lang, next, sum(ab) AS ab FROM f WHERE NOT short GROUP BY 1, 2), nb AS (SELECT lang, sum(ab) AS a FROM sure GROUP BY 1),
 starters AS (SELECT * FROM (SELECT *, {_ratio()} AS score FROM (SELECT s.lang, s.next, s.ab, nb.a, c.n AS b, total FROM sure s JOIN nb USING (lang) JOIN t USING (lang) JOIN c ON c.lang = s.lang AND c.word = s.next WHERE regexp_matches(s.next, '^\p{{L}}'))) WHERE score >= 30 AND total / a::DOUBLE > b / ab::DOUBLE),
 tied AS (SELECT * FROM (SELECT *, {_ratio()} AS score FROM (SELECT f.lang, f.word, f.next, f.ab, o.k AS a, c.n AS b, total FROM f JOIN t USING (lang) JOIN c o ON o.lang = f.lang AND o.word = f.word JOIN c ON c.lang = f.lang AND c.word = f.next
  WHERE period AND ab > 1 AND (short OR f.word = '##' OR length(f.word) = 1))) WHERE score >= 7.88 AND total / a::DOUBLE > b / ab::DOUBLE)"""


@query(f"""WITH {_LEARNT} SELECT lang, 'abbreviation' AS kind, word AS item, k::BIGINT AS n, round(score, 6) AS score FROM short UNION ALL SELECT lang, 'starter', next, ab::BIGINT, round(score, 6) FROM starters
 UNION ALL SELECT lang, 'collocation', word || ' ' || next, ab::BIGINT, round(score, 6) FROM tied""")
def sentence_model(spark, d):
    return S.learn(table(spark, d, "documents")).withColumn("score", F.round("score", 6))


_WORD, _NEXT = _kind("x"), _kind("y")


@query(rf"""WITH {_LEARNT}, m AS (SELECT lang, list(word) AS short FROM short GROUP BY 1), n AS (SELECT lang, list(next) AS starters FROM starters GROUP BY 1), o AS (SELECT lang, list(word || ' ' || next) AS tied FROM tied GROUP BY 1),
 q AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(lang, '') AS lang, regexp_extract_all(text, '{_SPACED_TOK}') AS ps FROM documents),
 u AS (SELECT nr, lang, i, ps[i] AS part, regexp_extract(ps[i], '^{_TOK}') AS x, regexp_extract(ps[i + 1], '^{_TOK}') AS y FROM (SELECT nr, lang, ps, unnest(range(1, len(ps) + 1)) AS i FROM q)),
 k AS (SELECT nr, i, part, regexp_matches(x, '{_ENDS}') AND y IS NOT NULL AND CASE WHEN {_form("x")} LIKE '%.' THEN CASE WHEN NOT (coalesce(list_contains(short, {_WORD}), false) OR {_WORD} = '##' OR length({_WORD}) = 1) THEN true
   WHEN coalesce(list_contains(tied, {_WORD} || ' ' || {_NEXT}), false) THEN false WHEN {_WORD} = '##' THEN NOT regexp_matches(y, '^[^\p{{L}}\p{{N}}]*\p{{Ll}}') ELSE regexp_matches(y, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}') AND coalesce(list_contains(starters, {_NEXT}), false) END ELSE true END AS ends
  FROM u LEFT JOIN m USING (lang) LEFT JOIN n USING (lang) LEFT JOIN o USING (lang)),
 g AS (SELECT nr, part, i, count(*) FILTER (ends) OVER (PARTITION BY nr ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM k),
 z AS (SELECT nr, s, regexp_replace(string_agg(part, '' ORDER BY i), '[\x09-\x0D\x20]+$', '') AS sentence FROM g GROUP BY 1, 2)
 SELECT doc_id, s::INT AS pos, sentence FROM z JOIN q USING (nr) WHERE sentence <> ''""")
def learnt_sentences(spark, d):
    docs = table(spark, d, "documents")
    model = storage.table(spark, S.learn(docs), "sentence-model")
    # An outer explode: an inner one would have the sentences made again for a filter of its own.
    return S.split(docs, model).select("doc_id", F.posexplode_outer("sentences").alias("pos", "sentence")).filter("sentence is not null")
