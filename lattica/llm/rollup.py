"""Token counts as rollups kept up to date by signed changes.

A change inserts, deletes or revises a document's count; what a batch adds to the totals by source,
language and tokenizer version is summed before anything is shuffled widely, and committed as one
Parquet folder named by the batch. A folder counts once Spark has marked it complete, and a batch
that was committed is not committed again, so a job can repeat any batch safely; other changes under a name that is
taken are an error, told by a digest of what the batch adds. Totals are sums.
``compact`` folds all complete batches into one base, which lists them, so they stay committed.

Edge cases: null sources or languages are groups of their own; a change with a null count adds 0
tokens; a change whose op is none of the three, or null, fails its batch; a batch without changes is committed
empty; a group of which nothing is left has no row, but one with tokens or characters left over shows them, so
that a wrong old count doesn't vanish; equal rows in one batch are separate changes; extra columns are never read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
OPS = ("insert", "delete", "revise")


def deltas(changes: DataFrame) -> DataFrame:
    """What changes add: rows (op, source, lang, tokenizer, n_tokens, old_tokens, n_chars, old_chars) with op
    'insert', 'delete' or 'revise'. An insert ignores the old figures, a delete takes them away."""
    named = F.coalesce(F.col("op").cast("string"), F.lit("null"))
    op = F.when(named.isin(*OPS), named).otherwise(F.raise_error(F.concat(F.lit("no such change: "), named)))
    changes = changes.withColumn("op", op.cast("string"))
    is_ = lambda name: F.col("op") == name
    new = lambda c: F.when(is_("delete"), 0).otherwise(F.coalesce(c, F.lit(0)))
    old = lambda c: F.when(is_("insert"), 0).otherwise(F.coalesce(c, F.lit(0)))
    return changes.groupBy(*KEYS).agg(
        F.sum(F.when(is_("insert"), 1).when(is_("delete"), -1).otherwise(0)).cast("long").alias("n_docs"),
        F.sum(new("n_tokens") - old("old_tokens")).cast("long").alias("n_tokens"), F.sum(new("n_chars") - old("old_chars")).cast("long").alias("n_chars"))


def _name(batch: str) -> str:
    return "batch-" + hashlib.sha256(batch.encode()).hexdigest()[:24]


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete folders, in order; one listing, however many there are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(s.getPath().getParent().getName() for s in found or [])


def _base(names: list[str]) -> str | None:
    """The newest base; its number has a fixed width."""
    return max((n for n in names if n.startswith("base-") and not n.endswith("-list")), default=None)


def _folded(spark: SparkSession, folder: str, base: str | None) -> DataFrame:
    """batch, digest: the batches that a base holds."""
    return spark.read.schema("batch string, digest string").parquet(f"{folder}/{base}-list") if base else spark.createDataFrame([], "batch string, digest string")


def _digest(added: DataFrame) -> str:
    """Of what a batch adds, in any order."""
    n, total = added.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*KEYS, *SUMS).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{n}-{int(total)}"


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """Of batches that no base holds yet, from the names of empty folders."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.digest.*")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return dict(s.getPath().getName().split(".digest.") for s in found or [])


def _committed(spark: SparkSession, folder: str, name: str) -> tuple[bool, str | None]:
    """Whether a batch is, and its digest where it is known."""
    names = _complete(spark, folder)
    folded = _folded(spark, folder, _base(names)).filter(F.col("batch") == name).first()
    if folded:
        return True, folded.digest
    return name in names, _digests(spark, folder).get(name) if name in names else None


def commit(spark: SparkSession, folder: str, batch: str, changes: DataFrame) -> bool:
    """Commit a batch; False if it was committed before, an error if that was with other changes. What a failed attempt left is overwritten."""
    name = _name(batch)
    added = shared.table(spark, deltas(changes), "deltas")  # a row for each group
    digest = _digest(added)
    done, had = _committed(spark, folder, name)
    if done:
        if had not in (None, digest):
            raise ValueError(f"batch {batch!r} was committed with other changes")
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in fs.globStatus(path(f"{folder}/{name}.digest.*")) or []:
        fs.delete(old.getPath(), True)
    fs.mkdirs(path(f"{folder}/{name}.digest.{digest}"))  # before the batch counts
    added.write.mode("overwrite").parquet(f"{folder}/{name}")
    return True


def _rows(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], str | None]:
    """All that counts: the newest base and the batches that aren't in it; their names; the base."""
    names = _complete(spark, folder)
    base = _base(names)
    batches = [n for n in names if n.startswith("batch-")]
    held = spark.createDataFrame([(n,) for n in batches], "batch string").join(_folded(spark, folder, base).select("batch"), "batch", "left_anti") if batches and base else None
    fresh = sorted(r.batch for r in held.collect()) if held is not None else batches  # as many as batches since the base
    paths = [f"{folder}/{n}" for n in ([base] if base else []) + fresh]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA), fresh, base


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """Sums over all complete batches, for groups that have documents, tokens or characters left."""
    rows, _, _ = _rows(spark, folder)
    summed = rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
    return summed.filter(" or ".join(f"{c} <> 0" for c in SUMS))


def compact(spark: SparkSession, folder: str) -> None:
    """Fold all complete batches into a new base and remove them. The base counts once it and its list are
    complete; until then the old folders do, and batches that it lists are left out where they are still there."""
    had = [n for n in _complete(spark, folder) if n.startswith("batch-")]  # those that aren't fresh were left by a fold that died
    rows, fresh, base = _rows(spark, folder)
    if not fresh:
        return
    new = f"base-{int(base.split('-')[1]) + 1 if base else 0:09d}"
    digests = _digests(spark, folder)
    listed = _folded(spark, folder, base).unionByName(spark.createDataFrame([(n, digests.get(n)) for n in fresh], "batch string, digest string"))
    listed.write.mode("overwrite").parquet(f"{folder}/{new}-list")
    rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.mode("overwrite").parquet(f"{folder}/{new}")
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [*{*fresh, *had}, *(f"{n}.digest.{digests[n]}" for n in fresh if n in digests), *([base, f"{base}-list"] if base else [])]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
