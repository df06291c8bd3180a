"""Extraction of concepts from notes: prompts guided by what a note mentions or by a domain, answers, and maps by note."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions.text import normalize_answer
from . import dcf, ontology, pairs, prompts, shards

#: Concepts of a domain up to which they are sent to every executor to meet the notes.
MOST_CONCEPTS = 100_000

# The decoding configurations by name: boost factors (hierarchy, property, groundedness), whether the
# property score reads the context, and the kind of search.
CONFIGS = {
    "hps": (1.0, 1.0, 1.0, True, "ontology"), "hp": (1.0, 1.0, 0.0, True, "ontology"), "hs": (1.0, 0.0, 1.0, True, "ontology"), "ps": (0.0, 1.0, 1.0, True, "ontology"),
    "h": (1.0, 0.0, 0.0, True, "ontology"), "p": (0.0, 1.0, 0.0, True, "ontology"), "s": (0.0, 0.0, 1.0, True, "ontology"), "pn": (0.0, 1.0, 0.0, False, "ontology"),
    "beam": (0.0, 0.0, 0.0, False, "beam"), "normal": (0.0, 0.0, 0.0, False, "greedy"),
}


# What every configuration shares, and the beams and groups by the kind of search.
SHARED = {"max_length": 2048, "max_new_tokens": 128, "window_size": 5, "kept": 1, "diversity_penalty": 1.0, "model_weight": 0.5, "boost_weight": 0.5}
BEAMS = {"ontology": (10, 2), "beam": (10, 2), "greedy": (1, 1)}


def configs(spark, names: list[str] | None = None, full: bool = False) -> DataFrame:
    """The decoding configurations as a table; an unknown name is an error. ``full``: with lengths, beams, groups, window and the weights of scores too."""
    if lost := set(names or ()) - set(CONFIGS):
        raise ValueError(f"unknown configurations: {sorted(lost)}")
    rows = [(k, *v) for k, v in CONFIGS.items() if names is None or k in names]
    own = spark.createDataFrame(rows, "config_name string, h double, p double, s double, uses_context boolean, search string")
    if not full:
        return own
    beams = F.create_map(*(F.lit(x) for k, (n, _) in BEAMS.items() for x in (k, n)))
    groups = F.create_map(*(F.lit(x) for k, (_, n) in BEAMS.items() for x in (k, n)))
    return own.withColumns({"beams": beams[F.col("search")], "beam_groups": groups[F.col("search")], **{k: F.lit(v) for k, v in SHARED.items()}})


def _asked(wanted: DataFrame, notes: DataFrame, concepts: DataFrame, properties: DataFrame, note: str, text: str) -> DataFrame:
    """note, concept_id and prompt; a note without concepts has one row of empty texts."""
    said = ontology.property_texts(properties).select(F.col("id").alias("concept_id"), "texts")
    known = ontology.labels(wanted, concepts, "concept_id", "label").join(said, "concept_id", "left")
    joined = notes.select(note, text).join(known, note, "left")
    prompt = prompts.concept_question(F.col(text), F.col("label"), F.col("texts"))
    none = F.col("concept_id").isNull()
    return joined.select(note, F.coalesce("concept_id", F.lit("")).alias("concept_id"), F.when(none, "").otherwise(prompt).alias("prompt"))


def guided(notes: DataFrame, mentions: DataFrame, up: DataFrame, concepts: DataFrame, properties: DataFrame, k: int, roots: list[str], note: str = "note_id", text: str = "text") -> DataFrame:
    """Prompts for the k concepts that a note is most about."""
    best = dcf.note_concepts(mentions, up, k, roots, note).select(note, "concept_id")
    return _asked(best, notes, concepts, properties, note, text)


def of_domain(notes: DataFrame, allowed: DataFrame, concepts: DataFrame, properties: DataFrame, mentions: DataFrame | None = None, up: DataFrame | None = None, roots: list[str] | None = None, note: str = "note_id", text: str = "text") -> DataFrame:
    """Prompts for the concepts (id) of a domain: all of them for every note, or with mentions those that the note is about."""
    if mentions is not None:
        return _asked(dcf.domain_concepts(mentions, up, roots or [], allowed, note), notes, concepts, properties, note, text)
    ids = allowed.select(F.col("id").alias("concept_id")).distinct()
    if ids.limit(MOST_CONCEPTS + 1).count() > MOST_CONCEPTS:
        raise ValueError(f"a domain of more than {MOST_CONCEPTS} concepts for every note")
    return _asked(notes.select(note).crossJoin(F.broadcast(ids)), notes, concepts, properties, note, text)


def answered(asked: DataFrame, provider_factory: Callable[[], shards.Provider], **more) -> DataFrame:
    """Adds ``value``: the normalised answer; empty for a row without a prompt."""
    got = shards.infer(asked.withColumn("__ask", F.when(F.col("prompt") != "", F.col("prompt"))), "__ask", provider_factory, output="__out", **more)
    return got.withColumn("value", F.when(F.col("prompt") == "", "").otherwise(normalize_answer(F.col("__out")))).drop("__ask", "__out")


def by_note(rows: DataFrame, note: str = "note_id") -> DataFrame:
    """A map from concept to value for each note; a note without concepts has an empty one."""
    maps = pairs.maps_of_rows(rows.filter(F.col("concept_id") != ""), note, "concept_id", "value", "value")
    none = F.create_map().cast("map<string,string>")
    return rows.select(note).distinct().join(maps, note, "left").withColumn("extraction", F.coalesce("extraction", none))


def variants(asked: DataFrame, providers: dict[str, Callable[[], shards.Provider]], note: str = "note_id") -> DataFrame:
    """Extractions of the same prompts by several decoders or configurations: note, config_name, extraction. The prompts are made once."""
    asked, out = storage.table(asked.sparkSession, asked, "asked"), None
    for name, factory in providers.items():
        one = by_note(answered(asked, factory), note).withColumn("config_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def verbalised(entries: DataFrame, group: str, note: str, order: str, label: str, value: str, column: str, provider_factory: Callable[[], shards.Provider]) -> DataFrame:
    """Prompts of what was pruned for each group, and a model's text from them, in the columns of one method and domain."""
    asked = prompts.group_entries(entries, group, note, order, label, value, into=f"{column}_verbalizer_prompt")
    return shards.infer(asked, f"{column}_verbalizer_prompt", provider_factory, output=f"{column}_verbalized")


def evaluator_rows(notes: DataFrame, processed: DataFrame, key: str, category: str, domains: list[str], order: list[str], length: Column, most: int, each: int | None = None) -> DataFrame:
    """Notes of some domains that aren't processed yet, the first of each domain, no longer than so many tokens. A domain that no note has is an error."""
    from . import corpus

    have = {r[0] for r in notes.filter(F.col(category).isin(*domains)).select(category).distinct().collect()}
    if lost := set(domains) - have:
        raise ValueError(f"no notes of {sorted(lost)}")
    rows = corpus.without(notes.filter(F.col(category).isin(*domains)), processed, key)
    rows = corpus.first_k(rows, category, order, each) if each is not None else rows
    return corpus.within_length(rows, length, most)


def summarised(notes: DataFrame, text: str, provider_factory: Callable[[], shards.Provider], into: str = "SUMMARY") -> DataFrame:
    """Notes with a model's summary, asked for in a chat."""
    asked = notes.withColumn("__chat", prompts.chat_text(prompts.summary_chat(F.col(text))))
    return shards.infer(asked, "__chat", provider_factory, output=into).drop("__chat")
