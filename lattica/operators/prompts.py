"""Prompts and chats from groups of rows. Templates are Python format strings with named slots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WITH_CONTEXT = "Context:\n{context}\n\nStatement: {statement}\n\nIs the statement factual?"
WITHOUT_CONTEXT = "Statement: {statement}\n\nIs the statement factual?"
ANSWERED = "\n### Factual: {label}\n### Explanation: {explanation}"
JUDGE = "Instruction: {instruction}\nResponse A: {a}\nResponse B: {b}\nRubric: {rubric}\nSay which response is better, ending in [RESULT] A or B."
CLAIM = "<context>\n{context}\n</context>\n\n<claims>\n{claim}\n</claims>"  # fixed value: the classifier's format
CONCEPT = "{note}\n\nWhat does the note say about {label}?{properties}"
PROPERTIES = "\n{label} has these properties:\n- {list}\n"
VALID_VALUE = "Note:\n{note}\n\nIs it right that {label} : {value}? Answer yes or no."
PRESENT = "Note:\n{note}\n\nDoes the note speak of {label}? Answer yes or no."
ENTAILS = "Premise: {premise}\nHypothesis: {hypothesis}\n\nDoes the hypothesis follow from the premise? Answer yes or no."
SUMMARISE = "Summarise the user's note in at most 250 words and write nothing else."
#: Prompts for validators of generated rows, by data set.
VALIDATORS = {
    "notes": "Note: {note}\nExtraction: {output}\n\nIs the extraction factual? Answer YES or NO only.",
    "choices": "Question: {question}\nAnswer: {answer}\nStatement: {output}\n\nDoes the statement say what the answer says? Answer YES or NO only.",
    "cases": "Context: {context}\nQuestion: {question}\nAnswer: {answer}\nStatement: {output}\n\nDoes the statement say what the answer says? Answer YES or NO only.",
    "papers": "First: {sentence}\nSecond: {output}\n\nDo the sentences contradict each other? Answer YES or NO only.",
}
RUBRICS = ("factuality", "relevance")


def render(template: str, **slots: Column | str) -> Column:
    """A template with columns in its slots; a slot that lacks is an error, a null slot is an empty text."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(slots[m[1]].cast("string"), F.lit("")) if isinstance(slots[m[1]], Column) else F.lit(slots[m[1]])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def numbered(texts: Column, title: str = "### Clinical note ", between: str = "\n\n") -> Column:
    """An array of texts under titles numbered from 1."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit(title), (i + 1).cast("string"), F.lit("\n"), x)), between)


def group_texts(df: DataFrame, group: list[str], order: str, text: str, into: str = "prompt", template: str = "{notes}", most: int | None = None) -> DataFrame:
    """The texts of every group in order, numbered, in a template. ``most`` caps the texts of a group, the first in order."""
    df = df.filter(F.col(text).isNotNull())
    if most:  # before they are collected
        df = df.withColumn("__nr", F.row_number().over(Window.partitionBy(*group).orderBy(order, text))).filter(F.col("__nr") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    return df.groupBy(*group).agg(render(template, notes=numbered(texts)).alias(into))


def group_entries(df: DataFrame, group: str, note: str, order: str, label: str, value: str, distinct: bool = False, bullet: str = "", into: str = "prompt", structure: str | None = None) -> DataFrame:
    """Entries (label, value) of the notes of every group as numbered text; 'N/A' for a group without any.

    Values 'N/A' are left out; with ``distinct`` so are values that a note had before, whatever their
    case and outer white space. ``structure`` adds a column of that name with a map from label to value for each note;
    of a label's values the last in order counts, and an entry without a label is in neither text nor map.
    """
    kept = df.filter(F.col(value).isNotNull() & (F.col(value) != "N/A"))
    if distinct:
        from ..functions.text import utrim
        from .pairs import first_seen

        kept = first_seen(kept.withColumn("__norm", F.lower(utrim(F.col(value)))), [group, note, "__norm"], [order])
    line = F.concat(F.lit(bullet), F.col(label), F.lit(" : "), F.col(value), F.lit("\n"))
    entry = F.struct(F.col(order).alias("o"), line.alias("t"))
    joined = lambda entries: F.array_join(F.transform(F.array_sort(entries), lambda x: x["t"]), "")
    if structure:
        values = kept.groupBy(group, note, label).agg(F.collect_list(entry).alias("__l"), F.min(order).alias("__o"), F.max_by(value, F.struct(order, value)).alias("__v"))
        pairs = F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col("__o").alias("o"), F.col(label).alias("k"), F.col("__v").alias("v")))))
        map_ = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], x["v"])))
        notes = values.groupBy(group, note).agg(joined(F.flatten(F.collect_list("__l"))).alias("__text"), F.to_json(map_).alias("__map"))
    else:
        notes = kept.groupBy(group, note).agg(joined(F.collect_list(entry)).alias("__text")).withColumn("__map", F.lit(None).cast("string"))
    inner = F.array_sort(F.collect_list(F.struct(F.col(note).alias("o"), F.col("__text").alias("t"), F.col("__map").alias("m"))))
    made = notes.groupBy(group).agg(inner.alias("__n"))
    made = made.select(group, numbered(F.transform("__n", lambda x: x["t"]), between="\n").alias(into), *([F.transform("__n", lambda x: F.from_json(x["m"], "map<string,string>")).alias(structure)] if structure else []))
    return df.select(group).distinct().join(made, group, "left").withColumn(into, F.coalesce(into, F.lit("N/A")))


def for_domains(df: DataFrame, domains: list[str], into: str = "domain") -> DataFrame:
    """Every row for every domain."""
    return df.select("*", F.explode(F.array(*(F.lit(d) for d in domains))).alias(into))


def sample(context: Column, statement: Column, label: Column | None = None, explanation: Column | None = None, eos: str = "") -> Column:
    """Text of one sample: without a label for inference; with it and an end mark for training."""
    bare = context.isNull() | context.isin("None", "")
    asked = F.when(bare, render(WITHOUT_CONTEXT, statement=statement)).otherwise(render(WITH_CONTEXT, context=context, statement=statement))
    if label is None:
        return asked
    yes_no = F.when(label, F.lit("YES")).otherwise(F.lit("NO"))
    return F.concat(asked, render(ANSWERED, label=yes_no, explanation=F.coalesce(explanation, F.lit(""))), F.lit(eos))


def one_shot(example: Column, asked: Column) -> Column:
    return F.concat(example, F.lit("\n"), asked)


def chat(system: Column, user: Column, answer: Column, asked: Column) -> Column:
    """Four messages: instruction, an example of both sides, the question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", system), message("user", user), message("assistant", answer), message("user", asked))


def chat_text(messages: Column, system_role: bool = True) -> Column:
    """A chat as text; models without a system role get the instruction before the first question."""
    if not system_role:
        joined = F.concat(F.get(messages, F.lit(0))["content"], F.lit("\n\n"), F.get(messages, F.lit(1))["content"])
        first = F.struct(F.lit("user").alias("role"), joined.alias("content"))
        messages = F.when(F.get(messages, F.lit(0))["role"] == "system", F.concat(F.array(first), F.slice(messages, 3, F.size(messages)))).otherwise(messages)
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"])), "\n")


def judge(instruction: Column, a: Column, b: Column, rubric: str) -> Column:
    if rubric not in RUBRICS:
        raise ValueError(f"rubric must be one of {RUBRICS}")
    return render(JUDGE, instruction=instruction, a=a, b=b, rubric=rubric)


def properties_block(label: Column, texts: Column) -> Column:
    """The properties of a concept as a list under its label; empty without any."""
    return F.when(F.coalesce(F.trim(F.array_join(texts, "")), F.lit("")) == "", F.lit("")).otherwise(render(PROPERTIES, label=label, list=F.array_join(texts, "\n- ")))


def concept_question(note: Column, label: Column, texts: Column) -> Column:
    return render(CONCEPT, note=note, label=label, properties=properties_block(label, texts))


def claim_check(context: Column, claim: Column) -> Column:
    """For the classifier of claims."""
    return render(CLAIM, context=context, claim=claim)


def claim_generator(context: Column, request: Column, answer: Column) -> Column:
    """For the generator of claims: numbered sentences of context and answer around the request."""
    from ..functions.text import annotate, sentences, utrim

    # The generator's marks.
    return F.concat(F.lit("<|context|>"), annotate(sentences(context), "s"), F.lit("<end||context><|request|><"), utrim(request), F.lit("><end||request><|response|>"), annotate(sentences(answer), "r"), F.lit("<end||response>"))


def validation(kind: str, **slots: Column) -> Column:
    """A validator's prompt for a data set; papers are compared in lower case."""
    if kind == "papers":
        slots = {k: F.lower(v) for k, v in slots.items()}
    return render(VALIDATORS[kind], **slots)


def entailment_judge(premise: Column, hypothesis: Column, rubric: str = "factuality") -> Column:
    """A judge's prompt on whether a premise entails a hypothesis, with the answers Yes and No to choose from."""
    return judge(render(ENTAILS, premise=premise, hypothesis=hypothesis), F.lit("Yes"), F.lit("No"), rubric)


def one_shot_chats(df: DataFrame, examples: DataFrame, concept: str, system: str, asked: Column, into: str = "chat") -> DataFrame:
    """A chat for each row with the example (concept, user, assistant) of its concept; a concept without one gets nulls in its place."""
    named = examples.select(F.lower("concept").alias("__c"), F.col("user").alias("__u"), F.col("assistant").alias("__a"))
    joined = df.join(named, F.lower(F.col(concept)) == F.col("__c"), "left")
    return joined.withColumn(into, chat(F.lit(system), F.col("__u"), F.col("__a"), asked)).drop("__c", "__u", "__a")


def summary_chat(note: Column) -> Column:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(SUMMARISE)), message("user", note))
