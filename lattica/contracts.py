"""Schema contracts and the column grammar {method}_{domain}[_suffix]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required columns of the typed datasets.
CONTRACTS = {
    "notes": ("ROW_ID", "HADM_ID", "CHARTDATE", "CHARTTIME", "CATEGORY", "DESCRIPTION", "TEXT"),
    "nli": ("internal_id", "context", "statement", "factual", "dataset"),
    "judge_results": ("a", "b", "concept", "a_result", "b_result", "result"),
    "human_evaluation": ("id", "notes", "admission_id", "structured_summary", "summary", "method", "domain"),
    "statements": ("id", "context", "statement", "label", "explanation", "inner_id", "source", "synthetic"),
    "comparison": ("normal", "beam", "constrained"),
}
METHODS = ("normal", "beam", "constrained")

# Texts that a reader of CSV takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class ContractError(ValueError):
    """A dataset lacks what its contract asks for."""


def validate(df: DataFrame, contract: str | tuple[str, ...]) -> DataFrame:
    """The frame itself if it has the contract's columns."""
    wanted = CONTRACTS[contract] if isinstance(contract, str) else contract
    if lost := [c for c in wanted if c not in df.columns]:
        raise ContractError(f"missing columns: {', '.join(lost)}")
    return df


def validate_same_schema(frames: list[DataFrame]) -> None:
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema] != first:
            raise ContractError("schemas differ")


def normalize_na(c: Column) -> Column:
    """Null for the texts that stand for a missing value; exact, so ' N/A ' and 'na' stay."""
    return F.when(c.isin(*MISSING), None).otherwise(c)


def split_column(name: str, suffix: str = "") -> tuple[str, str]:
    """(method, domain) of a column name that follows the grammar."""
    if suffix and not name.endswith(suffix):
        raise ContractError(f"{name} doesn't end in {suffix}")
    method, mark, domain = name.removesuffix(suffix).partition("_")
    if method not in METHODS or not mark or not domain:
        raise ContractError(f"{name} isn't method_domain{suffix}")
    return method, domain


def from_wide(df: DataFrame, suffix: str, prompt_suffix: str | None = None) -> DataFrame:
    """Columns {method}_{domain}{suffix} as rows (method, domain, value); null values are left out.

    With ``prompt_suffix``, a value whose prompt is missing is null, too. Other columns are carried
    along unless their name has 'prompt' in it.
    """
    values = [c for c in df.columns if c.endswith(suffix) and (not prompt_suffix or not c.endswith(prompt_suffix))]
    others = [c for c in df.columns if c not in values and "prompt" not in c]

    def entry(c: str) -> Column:
        method, domain = split_column(c, suffix)
        value = F.col(c)
        if prompt_suffix and (p := c.removesuffix(suffix) + prompt_suffix) in df.columns:
            value = F.when(normalize_na(F.col(p)).isNull(), None).otherwise(value)
        return F.struct(F.lit(method).alias("method"), F.lit(domain).alias("domain"), value.alias("value"))

    rows = df.select(*others, F.explode(F.array(*map(entry, values))).alias("e")).select(*others, "e.*")
    return rows.filter(F.col("value").isNotNull())


def to_wide(df: DataFrame, keys: list[str], names: list[tuple[str, str]], suffix: str) -> DataFrame:
    """Rows (method, domain, value) as one row a key with a column for each of ``names``."""
    pick = lambda m, d: F.max(F.when((F.col("method") == m) & (F.col("domain") == d), F.col("value"))).alias(f"{m}_{d}{suffix}")
    return df.groupBy(*keys).agg(*(pick(m, d) for m, d in names))


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Without the index columns that a CSV writer leaves behind."""
    return df.drop(*(c for c in df.columns if c.startswith("Unnamed") or c.startswith("_c")))


def union_all(frames: list[DataFrame], fill: bool = False) -> DataFrame:
    """Frames one after the other by column name; with ``fill``, missing columns are null."""
    if not fill:
        validate_same_schema(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)
