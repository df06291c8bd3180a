"""Table functions called from SQL: the rows that the DataFrame forms give."""

from __future__ import annotations

from ..functions import tables
from ..operators import mentions as M
from . import _sql, corpus, query, sql_over, table, texts, work  # noqa: F401  their SQL is used


@query(_sql["json_leaves"])
def table_leaves(spark, d):
    tables.register(spark)
    sql = """SELECT event_id, l.pos, array_join(l.path, '/') AS path, l.value FROM (SELECT event_id, concat('{"items": [', props, ', "text"], "none": null}') AS tree FROM events), LATERAL json_leaves(tree) l"""
    return sql_over(spark, d, sql, "events")


@query(f"""WITH c AS ({_sql["claim_parse"]}) SELECT e.event_id, e.event_type, c.claim_id, c.claim, c.subclaims, c.citations, c.supported FROM events e LEFT JOIN c ON c.event_id = e.event_id AND e.event_id % 5 > 0""")
def table_claims(spark, d):
    """A table of any form with the claims of a column; every fifth response is none."""
    tables.register(spark)
    sql_over(spark, d, f"SELECT e.event_id, e.event_type, CASE WHEN e.event_id % 5 > 0 THEN r.response END AS response FROM events e JOIN ({texts._CLAIMED}) r ON r.event_id = e.event_id", "events").createOrReplaceTempView("lattica_responses")
    return spark.sql("""SELECT event_id, event_type, CAST(claim_id AS long) AS claim_id, claim_string AS claim, array_join(subclaims, ',') AS subclaims, array_join(CAST(citations AS array<string>), ',') AS citations, supported
     FROM with_claims(TABLE(SELECT event_id, event_type, response FROM lattica_responses), 'response')""")


@query(_sql["text_mentions"])
def table_mentions(spark, d):
    """Of the longest mentions of the openings of documents at each word those that don't overlap, by a table function that Spark deals by document; what they mean is joined then."""
    tables.register(spark)
    docs = table(spark, d, "documents")
    terms = M.terms_of(work._openings(docs))
    M.spans(docs, "text", terms, ["doc_id"], "longest").createOrReplaceTempView("lattica_mentions")
    return M.named(spark.sql("SELECT * FROM unlapped(TABLE(lattica_mentions), 'doc_id')"), terms, ["doc_id"])
