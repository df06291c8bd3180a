"""Table functions that ``spark.sql`` can call once ``register`` has named them to a session.

``json_leaves(text)`` and ``tagged_claims(text)`` give rows for one text, for use with LATERAL: the leaves of a JSON document
(pos, path, value) and the claims of a tagged response (claim_id, claim_string, subclaims, citations, rationale, supported).
``with_claims(TABLE(t), 'column')`` gives the rows of a table of any form with the claims of one of its columns, rows without a claim once with nulls.
``unlapped(TABLE(t), 'key', ...)`` gives those mentions of a table (start, n_words, anything else) that don't overlap one
of the same keys that starts before, or there and is longer; Spark deals the rows by the keys and sorts them.

A null text and one that isn't JSON have no leaves; a null response has no claims. A column that is missing, or whose name one of the claims' columns
has, is an error of the analysis.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .trees import claims_of, leaves_of

_CLAIM = ["claim_id", "claim_string", "subclaims", "citations", "rationale", "supported"]


def _columns(table: AnalyzeArgument, *names: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    for name in names:
        if name not in table.dataType.fieldNames():
            raise ValueError(f"the table has no column {name}")
    return table.dataType


def _constant(argument: AnalyzeArgument) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str):
        raise ValueError("a column is named by a constant text")
    return argument.value


class JsonLeaves:
    def eval(self, text: str) -> Iterator[tuple]:
        for leaf in leaves_of(text) or []:
            yield leaf["pos"], leaf["path"], leaf["value"]


class TaggedClaims:
    def eval(self, text: str) -> Iterator[tuple]:
        for claim in claims_of(text) or []:
            yield tuple(claim[c] for c in _CLAIM)


class WithClaims:
    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        given = _columns(table, _constant(column))
        for name in given.fieldNames():
            if name.lower() in _CLAIM:
                raise ValueError(f"a column of the claims is named {name} too")
        out = StructType(list(given.fields))
        for name, kind in zip(_CLAIM, [IntegerType(), StringType(), ArrayType(StringType()), ArrayType(IntegerType()), StringType(), BooleanType()], strict=True):
            out = out.add(name, kind)
        return AnalyzeResult(schema=out)

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        for claim in claims_of(row[column]) or [dict.fromkeys(_CLAIM)]:
            yield (*row, *(claim[c] for c in _CLAIM))


class Unlapped:
    """What is kept of a group is the last span, so that a group of any size takes the same memory."""

    @staticmethod
    def analyze(table: AnalyzeArgument, *keys: AnalyzeArgument) -> AnalyzeResult:
        names = [_constant(k) for k in keys]
        if not names:
            raise ValueError("at least one key tells texts apart")
        given = _columns(table, "start", "n_words", *names)
        quoted = [f"`{n.replace('`', '``')}`" for n in names]
        return AnalyzeResult(schema=given, partitionBy=[PartitioningColumn(n) for n in quoted], orderBy=[OrderingColumn("start"), OrderingColumn("n_words", ascending=False)])

    def __init__(self) -> None:
        self.span, self.end = None, 0

    def eval(self, row: Row, *keys: str) -> Iterator[tuple]:
        own = (row["start"], row["n_words"])
        if own[0] >= self.end:
            self.span, self.end = own, sum(own)
        if own == self.span:  # all concepts of a span
            yield tuple(row)


def register(spark: SparkSession) -> None:
    """Names the functions to a session."""
    spark.udtf.register("json_leaves", udtf(JsonLeaves, returnType="pos int, path array<string>, value string", useArrow=False))
    spark.udtf.register("tagged_claims", udtf(TaggedClaims, returnType="claim_id int, claim_string string, subclaims array<string>, citations array<int>, rationale string, supported boolean", useArrow=False))
    spark.udtf.register("with_claims", udtf(WithClaims, useArrow=False))
    spark.udtf.register("unlapped", udtf(Unlapped, useArrow=False))
