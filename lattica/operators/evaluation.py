"""Evaluations from end to end: factuality of statements, judges over shards, and samples for reviewers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unique_id, without_text
from . import corpus, ontology, pairs, prompts, shards, verdicts

#: Domains as reviewers know them.
DOMAINS = {"Nursing": "Nursing", "ECG": "ECG", "Radiology": "Radiology", "Physician": "Physician"}


def statements_of_extractions(df: DataFrame, key: str, text: str, column: str, method: str, concepts: DataFrame, values_only: bool = True) -> DataFrame:
    """id, context and statement for every concept of the maps in a column; empty concepts are left out."""
    rows = pairs.rows_of_maps(df, [key, text], {column: method}).filter(F.col("concept_id") != "")
    named = ontology.labels(rows, concepts, "concept_id", "label")
    statement = F.col("value") if values_only else F.concat_ws(" : ", "label", "value")
    return named.select(F.col(key).alias("id"), "concept_id", F.col(text).alias("context"), statement.alias("statement"))


def statements_of_summaries(df: DataFrame, key: str, text: str, summary: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).alias("context"), F.col(summary).alias("statement"))


def factuality(df: DataFrame, provider_factory: Callable[[], shards.Provider], one_shot: dict[str, str | bool] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (context, statement, ...) with text, output and the parsed verdict, and one row of how many statements there were, were null or not.

    ``one_shot`` has context, statement, label and explanation of an example that stands before every sample, and is
    taken out of the text again once it has been answered.
    """
    kept, seen = corpus.counted(df, F.col("statement").isNotNull())
    asked = prompts.sample(F.col("context"), F.col("statement"))
    if one_shot is not None:
        example = prompts.sample(F.lit(one_shot["context"]), F.lit(one_shot["statement"]), F.lit(one_shot["label"]), F.lit(one_shot["explanation"]))
        asked = prompts.one_shot(example, asked)
    done = shards.infer(kept.withColumn("prompt", asked), "prompt", provider_factory)
    text = without_text(F.col("prompt"), F.concat(example, F.lit("\n"))) if one_shot is not None else F.col("prompt")
    done = done.withColumn("text", text)
    return done.withColumn("verdict", verdicts.parse(F.col("output"), F.concat(F.col("text"), F.lit("\n")))).select("*", "verdict.*").drop("verdict"), seen


def review_sample(notes: DataFrame, entries: DataFrame, summaries: DataFrame, key: str, note: str, order: str, text: str, label: str, value: str) -> DataFrame:
    """Rows for reviewers: id, notes, admission_id, structured_summary, structure, summary, method, domain.

    notes: (key, order, text). entries: (key, method, domain, note, order, label, value) of pruned extractions.
    summaries: (key, method, domain, summary). Rows whose summary or structured summary is empty or null are left out.
    """
    texts = prompts.group_texts(notes, [key], order, text, "notes")
    group = F.struct(key, "method", "domain").alias("__g")
    structured = prompts.group_entries(entries.select(group, note, order, label, value), "__g", note, order, label, value, distinct=True, bullet="- ", into="structured_summary", structure="structure")
    structured = structured.select(f"__g.{key}", "__g.method", "__g.domain", "structured_summary", "structure")
    joined = summaries.join(texts, key).join(structured, [key, "method", "domain"])
    kept = joined.filter((F.length("summary") > 0) & (F.length("structured_summary") > 0))
    return kept.select(unique_id(F.col(key), F.col("method"), F.col("domain")).alias("id"), "notes", F.col(key).alias("admission_id"), "structured_summary", "structure", "summary", "method", "domain")


def review_sheets(sample: DataFrame, domain_concepts: DataFrame, concepts: DataFrame, questions: list[str], least: int = 0, most: int = 5) -> DataFrame:
    """The content of the reviewers' workbooks: domain, id, sheet, row and text; a workbook is an id, in the folder of its domain.

    Sheets: notes, summary and structured summary; the concepts of the domain by rank, with their labels; the scale of each question.
    """
    body = F.array(*(F.struct(F.lit(s).alias("sheet"), F.lit(0).alias("row"), F.col(c).alias("text")) for s, c in (("Notes", "notes"), ("Summary", "summary"), ("Structured summary", "structured_summary"))))
    asked = F.array(*(F.struct(F.lit("Evaluation").alias("sheet"), F.lit(i).alias("row"), F.lit(f"{q} ({least}-{most})").alias("text")) for i, q in enumerate(questions)))
    own = sample.select("domain", "id", F.explode(F.concat(body, asked)).alias("e")).select("domain", "id", "e.*")
    named = ontology.labels(domain_concepts, concepts, "concept_id", "label").select("domain", F.lit("Domain concepts").alias("sheet"), F.col("rank").alias("row"), F.concat(F.col("label"), F.lit(" ("), F.col("concept_id"), F.lit(")")).alias("text"))
    return own.unionByName(sample.select("domain", "id").join(named, "domain").select("domain", "id", "sheet", "row", "text"))
