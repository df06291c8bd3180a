"""Named queries over the synthetic tables, each with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def put(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Spark SQL over some of the tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"lattica_{name}")
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name}", f"{word} lattica_{name}")
    return spark.sql(sql)


#: DuckDB's form of ``functions.text.choice`` before the remainder is taken.
CHOICE = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import corpus, evaluation, files, flows, ontology, tables, texts, values, work  # noqa: F401

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
