"""Pairwise judgements: decisions, win matrices, outcome shares, pairs of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of decisions.
DECISION = r"(?i)(?:\[?Result\]?:?)\s*(N/A|A|B)\s*(or|and)?\s*(A|B)?"
STRICT = r"(?i)\[RESULT\]:?\s*(N/A|A|B)\b\s*(or|and)?\s*\b(A|B)?\b"


def decision(result: Column, strict: bool = False, strict_ties: bool = False) -> Column:
    """'a', 'b', 'tie' or 'parsing_error' of a judge's text: its first result.

    A tie is an upper-case N/A; with ``strict_ties`` also two different letters. ``strict`` asks for
    the bracketed tag and whole letters.
    """
    pattern = STRICT if strict else DECISION
    first, last = F.regexp_extract(result, pattern, 1), F.regexp_extract(result, pattern, 3)
    tie = first == "N/A"
    if strict_ties:
        tie = tie | ((last != "") & (F.lower(first) != F.lower(last)))
    return F.when(result.isNull() | ~result.rlike(pattern), "parsing_error").when(tie, "tie").otherwise(F.lower(first))


def win_matrix(df: DataFrame) -> DataFrame:
    """Rows (a, b, decision) as method, opponent and counts both ways; rates are null without a base."""
    win = lambda letter: (F.col("decision") == letter).cast("long")
    both = F.array(
        F.struct(F.col("a").alias("method"), F.col("b").alias("opponent"), win("a").alias("w")),
        F.struct(F.col("b").alias("method"), F.col("a").alias("opponent"), win("b").alias("w")))
    rows = df.select("decision", F.explode(both).alias("e")).select("decision", "e.*")
    counted = rows.groupBy("method", "opponent").agg(
        F.sum("w").alias("wins"), F.count_if(F.col("decision") == "tie").alias("ties"), F.count_if(F.col("decision") == "parsing_error").alias("parsing_errors"), F.count(F.lit(1)).alias("total"))
    counted = counted.withColumn("effective", F.col("total") - F.col("ties") - F.col("parsing_errors"))
    rate = lambda base: F.try_divide(F.col("wins") * 100.0, F.col(base).cast("double"))
    return counted.withColumns({"win_rate": rate("total"), "effective_win_rate": rate("effective")})


def head_to_head(matrix: DataFrame) -> DataFrame:
    """Adds the share of wins in percent without ties; errors count."""
    return matrix.withColumn("head_to_head", F.try_divide(F.col("wins") * 100.0, (F.col("total") - F.col("ties")).cast("double")))


def opponents_beaten(matrix: DataFrame, above: float = 50.0) -> DataFrame:
    return matrix.groupBy("method").agg(F.count_if(F.col("effective_win_rate") > above).alias("beaten"))


def versus(matrix: DataFrame, baseline: str) -> DataFrame:
    return matrix.filter(F.col("opponent") == baseline)


def outcome(a: Column, b: Column, result: Column) -> Column:
    """Why a row has the decision it has: model_na, no_concepts_found, identical_generations, not_enough_tokens or correct_generations."""
    from ..functions.text import utrim

    same = F.lower(utrim(a)) == F.lower(utrim(b))
    return F.when(a.isNull() | b.isNull(), "model_na").when(result.isNull(), "no_concepts_found").when(same, "identical_generations").when(~result.rlike(DECISION), "not_enough_tokens").otherwise("correct_generations")


def method_pairs(long: DataFrame, keys: list[str], different_only: bool = False) -> DataFrame:
    """Rows (keys, method, value) as ordered pairs of methods of one key: a, b, a_result, b_result."""
    left = long.select(*keys, F.col("method").alias("a"), F.col("value").alias("a_result"))
    right = long.select(*keys, F.col("method").alias("b"), F.col("value").alias("b_result"))
    pairs = left.join(right, keys).filter(F.col("a") != F.col("b"))
    return pairs.filter(F.col("a_result") != F.col("b_result")) if different_only else pairs


def dataset_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Answers of two datasets to the same keys, each way round; keys that only one has are left out."""
    x, y = left.select(*keys, F.col("value").alias("x")), right.select(*keys, F.col("value").alias("y"))
    row = lambda m, n, p, q: F.struct(F.lit(m).alias("a"), F.lit(n).alias("b"), F.col(p).alias("a_result"), F.col(q).alias("b_result"))
    return x.join(y, keys).select(*keys, F.explode(F.array(row(a, b, "x", "y"), row(b, a, "y", "x"))).alias("e")).select(*keys, "e.*")


def config_pairs(long: DataFrame, keys: list[str], baseline: str | None = None) -> DataFrame:
    """Rows (keys, method, value) of configurations as ordered pairs of them over all keys that one of the two has, 'N/A' for the other;
    with a baseline only pairs with it, both ways round. Empty concepts (the last key) are left out."""
    rows = long.filter(F.col(keys[-1]) != "")
    names = rows.select(F.col("method").alias("a")).distinct()
    pairs = names.crossJoin(names.withColumnRenamed("a", "b")).filter("a <> b")  # of configurations, which are few
    if baseline is not None:
        pairs = pairs.filter((F.col("a") == baseline) | (F.col("b") == baseline))
    both = pairs.select("a", "b", F.explode(F.array(F.col("a"), F.col("b"))).alias("method"))
    got = rows.join(F.broadcast(both), "method").groupBy(*keys, "a", "b").agg(
        F.max(F.when(F.col("method") == F.col("a"), F.col("value"))).alias("a_result"), F.max(F.when(F.col("method") == F.col("b"), F.col("value"))).alias("b_result"))
    return got.fillna("N/A", ["a_result", "b_result"])


def matrix_cells(matrix: DataFrame, effective: bool = True) -> DataFrame:
    """Cells of a square of methods: rate, wins by it and base of every pair, 0 for a method against itself; rows in the order of
    opponents beaten, most first, then by name."""
    rate, base = ("effective_win_rate", "effective") if effective else ("win_rate", "total")
    beaten = matrix.groupBy("method").agg(F.count_if(F.col(rate) > 50).alias("beaten"))
    names = beaten.select("method", "beaten", F.row_number().over(Window.orderBy(F.desc("beaten"), "method")).alias("place"))  # few rows
    square = names.crossJoin(names.select(F.col("method").alias("opponent"), F.col("place").alias("opponent_place")))
    cells = square.join(matrix.select("method", "opponent", F.col(rate).alias("rate"), F.col(base).alias("base")), ["method", "opponent"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cells.select("method", "opponent", "place", "opponent_place", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce(F.round(F.col("rate") * F.col("base") / 100).cast("long"), F.lit(0)).alias("wins"), zero("base"))


def outer_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Answers of two configurations by key, 'N/A' where one has none; empty concepts are left out."""
    x, y = left.withColumnRenamed("value", "a_result"), right.withColumnRenamed("value", "b_result")
    both = x.join(y, keys, "full").filter(F.col(keys[-1]) != "")
    na = lambda c: F.coalesce(c, F.lit("N/A")).alias(c)
    return both.select(*keys, F.lit(a).alias("a"), F.lit(b).alias("b"), na("a_result"), na("b_result"))


def sample_win(df: DataFrame, method: str, key: str, seed: str = "42") -> DataFrame:
    """One row that the method won with a different answer, by a seeded hash."""
    won = df.filter(((F.col("a") == method) & (F.col("decision") == "a")) | ((F.col("b") == method) & (F.col("decision") == "b"))).filter(F.col("a_result") != F.col("b_result"))
    return won.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(1)
