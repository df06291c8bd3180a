"""Readers and writers. Row order, where it matters, is an explicit column ``_pos``."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import storage
from ..contracts import drop_unnamed, normalize_na
from . import csv_ranges


def with_pos(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_pos``, the 0-based place in a total order of columns.

    Ranges are sorted in parallel and numbered from the sizes of those before them, so that no task
    sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    ranged = storage.table(df.sparkSession, ranged, "placed")  # places stay, whatever executors are lost
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_in").alias("first")).orderBy("_part").collect()
    starts, at = [], 0
    for r in parts:
        starts.append((r["_part"], at - r["first"]))
        at += r["n"]
    shift = df.sparkSession.createDataFrame(starts, "_part int, _shift long")
    return ranged.join(F.broadcast(shift), "_part").withColumn("_pos", F.col("_in") + F.col("_shift")).drop("_part", "_in", "_shift")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, range_bytes: int = csv_ranges.RANGE) -> DataFrame:
    """Quoted, multi-line CSV with every usual text for a missing value read as null.

    Plain files in a mounted folder are read in ranges, by several tasks each; compressed files and those of other stores by one task each. Quotes stand only around
    fields, and doubled inside them; files of one table have the same columns.
    """
    options = {"quote": '"', "escape": '"', "emptyValue": ""}
    found = csv_ranges.files(spark, path)
    names = csv_ranges.header(found[0][0]) if found else []
    if names and all(names) and len({n.lower() for n in names}) == len(names):
        fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        df = csv_ranges.records(spark, found, range_bytes).select(F.from_csv("value", fields, options).alias("r")).select("r.*")
    else:
        df = spark.read.csv(path, header=True, multiLine=True, nullValue=None, **options)
    df = drop_unnamed(df).select(*(normalize_na(F.col(f"`{c}`")).alias(c) for c in drop_unnamed(df).columns))
    if schema is None:
        return df
    wanted = spark.createDataFrame([], schema).schema
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted))


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_split(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    """A Parquet table partitioned by ``split``; all splits, or some of them."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split").isin(splits)) if splits else df


def read_any(spark: SparkSession, path: str, **more) -> DataFrame:
    """By suffix: CSV, JSON lines, else a Parquet folder."""
    if path.endswith(".csv"):
        return read_csv(spark, path, **more)
    if re.search(r"\.jsonl?$", path):
        return read_json_lines(spark, path, **more)
    return read_split(spark, path, **more)


def write_csv(df: DataFrame, path: str) -> None:
    text = [f.name for f in df.schema if not isinstance(f.dataType, StringType) and f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in text}).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Leaves a table that is there as it is, unless told otherwise."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def write_domains(df: DataFrame, path: str, domain: str = "domain") -> None:
    """One folder for each domain, named by its slug."""
    from ..functions.text import slug

    df.withColumn("domain_slug", slug(F.col(domain))).write.mode("overwrite").partitionBy("domain_slug").parquet(path)


def write_config_result(df: DataFrame, path: str, config: str) -> bool:
    """Writes the result of one configuration unless it is there; says whether it wrote."""
    spark = df.sparkSession
    at = f"{path}/config_name={config}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    df.write.mode("overwrite").parquet(at)
    return True


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_without(df: DataFrame, path: str, wide: str = "clinical_note") -> None:
    """Keeps the wide text column out of the stored copy."""
    df.drop(wide).write.mode("overwrite").parquet(path)


def write_factual(df: DataFrame, path: str, label: str = "factual") -> None:
    """Rows that are true and rows that are false in folders of their own; rows without a label are in neither."""
    for name, side in (("positive", F.col(label)), ("negative", ~F.col(label))):
        df.filter(side).write.mode("overwrite").parquet(f"{path}/{name}")


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """A table from lists by column; lists of unequal length are an error."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns of unequal length")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema)


def from_column_dicts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from rows of columns: each row of ``df`` holds a list for each of ``columns``, whose n-th values make a row with the other fields.

    Lists of unequal length, or a null one beside others, are an error; rows of only null or empty lists give none.
    """
    sizes = F.array(*(F.coalesce(F.size(c), F.lit(-1)) for c in columns))
    equal = F.array_min(sizes) == F.array_max(sizes)
    zipped = F.when(equal, F.arrays_zip(*columns)).otherwise(F.raise_error("columns of unequal length"))
    return df.select(*(c for c in df.columns if c not in columns), F.inline(zipped))


def from_pandas(spark: SparkSession, frame, schema: str | None = None) -> DataFrame:
    """A table from a pandas frame; NaN in columns of texts becomes null."""
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), schema)


def expand(value):
    """Environment variables in strings, at any depth."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def read_config(path: str, defaults: dict[str, dict], required: tuple[tuple[str, str], ...] = ()) -> tuple[dict[str, dict], list[str]]:
    """``parse_config`` of a file."""
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read(), defaults, required)


def parse_config(text: str, defaults: dict[str, dict], required: tuple[tuple[str, str], ...] = ()) -> tuple[dict[str, dict], list[str]]:
    """Sections in YAML (or JSON) over defaults, and warnings about what there is beyond them.

    A required key that stays None is an error.
    """
    try:
        import yaml

        found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
    except ImportError:
        import json

        found = json.loads(text)
    out, warnings = {s: dict(v) for s, v in defaults.items()}, []
    for section, values in found.items():
        if section not in out:
            warnings.append(f"unknown section {section}")
            continue
        for key, value in (values or {}).items():
            if key in out[section]:
                out[section][key] = expand(value)
            else:
                warnings.append(f"unknown key {section}.{key}")
    for section, key in required:
        if out[section].get(key) is None:
            raise ValueError(f"{section}.{key} is required")
    return out, warnings


def parsed_configs(df: DataFrame, text: str, defaults: dict[str, dict], required: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """section, name, value and n_warnings of each value that ``parse_config`` finds in each row's text, with the other fields of the row; a null text has the defaults.

    A table of texts is small for its work, and often one piece of a file, so rows are dealt to all cores first.
    """

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                found, warnings = parse_config(row.pop(text) or "{}", defaults, required)
                out += [row | {"section": s, "name": k, "value": None if v is None else str(v), "n_warnings": len(warnings)} for s, own in found.items() for k, v in own.items()]
            yield pd.DataFrame(out, columns=names)

    kept = [f for f in df.schema.fields if f.name != text]
    names = [*(f.name for f in kept), "section", "name", "value", "n_warnings"]
    spread = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "section string, name string, value string, n_warnings int"]))
