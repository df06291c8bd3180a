"""Verdicts of a fact checker, and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import text_scores
from ..functions.text import mask_domains, utrim

# Patterns of verdicts, applied to lower-cased text.
STRICT = r"(?i)Factual(?::)?(?:\n| |\*)*(YES|NO)"
BOUNDED = STRICT + r"\b"
EXPLANATION = r"(?i)### Explanation([\s\S]+)"
YES = r"(?iU)(?:Factual)?(?:\s|:)(?:\[)?(?:yes|is factual)(?:\])?(?:\s|:)?"
NO = r"(?iU)(?:Factual)?(?:\s|:)(?:\[)?(?:no|not factual)(?:\])?(?:\s|:)?"
TASKS = {"acm": "Information Extraction", "medmcqa": "Question-Answering", "medqa": "Question-Answering", "mednli": "NLI", "sumpubmed": "Summarization"}


def parse(output: Column, prompt: Column | None = None, bounded: bool = False) -> Column:
    """Struct (valid, prediction, explanation_gen) of a model's text.

    The strict form wins; failing it, a loose yes or no decides if only one of them is there. A null
    or empty text is not valid. ``prompt`` is put before the text, ``bounded`` asks for whole words.
    """
    text = F.lower(F.concat(prompt, output) if prompt is not None else output)
    strict_pattern = BOUNDED if bounded else STRICT
    none = output.isNull() | text.isNull() | (text == "")
    strict = text.rlike(strict_pattern)
    yes, no = text.rlike(YES), text.rlike(NO)
    told = F.when(text.rlike(EXPLANATION), F.regexp_extract(text, EXPLANATION, 1)).otherwise(text)
    return F.struct(
        F.when(none, False).when(strict, True).otherwise(yes != no).alias("valid"),
        F.when(none, False).when(strict, F.lower(F.regexp_extract(text, strict_pattern, 1)) == "yes").otherwise(yes).alias("prediction"),
        F.when(none, "").when(strict, utrim(told)).otherwise(text).alias("explanation_gen"))


def confusion(df: DataFrame, label: Column, prediction: Column, by: list[str] | None = None) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, precision, recall and f1; ratios without a base are null."""
    yes, said = label, prediction
    base = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return base.withColumns({"accuracy": d(tp + tn, F.col("n")), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def by_task(df: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``task`` by the source; null for unknown ones."""
    return df.withColumn("task", F.try_element_at(F.create_map(*(F.lit(x) for kv in TASKS.items() for x in kv)), F.col(source)))


def f1_table(frames: dict[str, DataFrame], tasks: list[str]) -> DataFrame:
    """A row a model with the F1 of each task, 0 where it has none."""
    rows = None
    for name, df in frames.items():
        one = confusion(df.filter("valid"), F.col("label"), F.col("prediction"), ["task"]).select(F.lit(name).alias("model"), "task", "f1")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("model").pivot("task", tasks).agg(F.first("f1")).na.fill(0.0, tasks)


def accuracy_by(df: DataFrame, category: str, label: Column, prediction: Column) -> DataFrame:
    """total, and percent correct and incorrect by category."""
    right = (label == prediction).cast("double")
    got = df.groupBy(category).agg(F.count(F.lit(1)).alias("total"), (F.avg(right) * 100).alias("correct_pct"))
    return got.withColumn("incorrect_pct", 100 - F.col("correct_pct"))


def explanation_scores(df: DataFrame, reference: str = "explanation", made: str = "explanation_gen", stemmed: bool = True) -> DataFrame:
    """Mean ROUGE-1, ROUGE-2 (of stems, or of words as they are) and BLEU of the explanations of false statements found false."""
    kept = df.filter((F.col("label") == F.col("prediction")) & ~F.col("label"))
    scored = kept.select(text_scores(F.col(reference), F.col(made), stemmed).alias("t")).select("t.*")
    return scored.agg(*(F.avg(c).alias(c) for c in ("rouge1", "rouge2", "bleu")))


def metrics(df: DataFrame, reference: str = "explanation", made: str = "explanation_gen") -> DataFrame:
    """One row: the confusion figures of the valid rows, the means of the explanations' scores, and how many rows were not valid."""
    valid = df.filter("valid")
    dropped = df.agg(F.count_if(~F.col("valid")).alias("n_invalid"))
    return confusion(valid, F.col("label"), F.col("prediction")).join(explanation_scores(valid, reference, made)).join(dropped)


def entailment(df: DataFrame, note: str, score: str) -> DataFrame:
    """Mean score of every note and the sum behind it."""
    return df.groupBy(note).agg(F.avg(score).alias("mean_score"), F.sum(score).alias("sum_score"))


def macro_mean(df: DataFrame, group: str, score: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(score).alias("m")).agg(F.avg("m").alias("macro_mean"))


def boost(h: Column, p: Column, s: Column, factors: tuple[float, float, float]) -> Column:
    """Hierarchy, property and groundedness scores in one."""
    return factors[0] * h + factors[1] * p + factors[2] * s


def rerank(df: DataFrame, group: str, beam: str, boosts: str, weights: tuple[float, float], into: str = "mixed") -> DataFrame:
    """Adds log(w0 e^beam + w1 (softmax of the boosts in the group, less its least)): the least boosted beam of a group gains nothing."""
    w = Window.partitionBy(group)
    soft = F.exp(F.col(boosts)) / F.sum(F.exp(F.col(boosts))).over(w)
    rows = df.withColumn("__soft", soft)
    share = F.col("__soft") - F.min("__soft").over(w)
    return rows.withColumn(into, F.log(weights[0] * F.exp(F.col(beam)) + weights[1] * share)).drop("__soft")


def domain_fit(df: DataFrame, text: str, domain: str, classify: Callable[[Column], Column], names: list[str], labels: dict[str, str]) -> DataFrame:
    """Mean probability of the expected label of each domain, its texts' domain names masked, and the mean over domains under 'average'.

    classify: gives a text's map from label to probability. labels: the label expected of each domain.
    """
    rows = df.filter(F.col(text).isNotNull() & F.col(domain).isNotNull())
    wanted = F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.col(domain))
    scored = rows.select(F.col(domain).alias("domain"), F.try_element_at(classify(mask_domains(F.col(text), names, ignore_case=True)), wanted).alias("score"))
    by = scored.groupBy("domain").agg(F.avg("score").alias("score"))
    return by.unionByName(by.agg(F.lit("average").alias("domain"), F.avg("score").alias("score")))
