"""Resumable work: shards, progress, merging of results, and model calls in Arrow batches."""

from __future__ import annotations

import asyncio
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from . import mentions


def bounds(n: int, size: int | None = None, count: int | None = None, most: int | None = None, legacy: bool = False) -> list[tuple[int, int]]:
    """[start, end) of the shards of n rows, by size or by count.

    ``legacy`` gives bounds that leave out the remainder by count, add an empty shard where the size
    divides n, and look at the cap only after a shard.
    """
    if (size is None) == (count is None):
        raise ValueError("give either a size or a count")
    if legacy:
        count, size = (n // size + 1, size) if size else (count, n // count)
        out: list[tuple[int, int]] = []
        for i in range(count):
            out.append((i * size, min(n, (i + 1) * size)))
            if most is not None and sum(b - a for a, b in out) > most:
                break
        return out
    n = min(n, most) if most is not None else n
    size = size or max(1, -(-n // count))
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def bounds_table(spark: SparkSession, n: int, size: int) -> DataFrame:
    """shard_id, shard_start and shard_end of the shards of n rows, made where they are needed."""
    k = F.col("id")
    return spark.range(-(-n // size)).select(k.alias("shard_id"), (k * size).alias("shard_start"), F.least(F.lit(n).cast("long"), (k + 1) * size).alias("shard_end"))


def shard_id(pos: Column, size: int) -> Column:
    return F.floor(pos / size).cast("long")


def progress(work: DataFrame, results: DataFrame, size: int, key: str = "_pos") -> DataFrame:
    """total, done, pending and percent of every shard."""
    joined = work.join(results.select(key, F.col("result").alias("__r")), key, "left")
    got = joined.groupBy(shard_id(F.col(key), size).alias("shard_id")).agg(F.count(F.lit(1)).alias("total"), F.count("__r").alias("done"))
    return got.withColumns({"pending": F.col("total") - F.col("done"), "percent": F.col("done") * 100.0 / F.col("total")})


def incomplete(state: DataFrame, k: int | None = None) -> DataFrame:
    """Shards with work left, in order; the first k, or all."""
    left = state.filter("pending > 0").orderBy("shard_id")
    return left.limit(k) if k else left


def unprocessed(work: DataFrame, results: DataFrame, key: str = "_pos") -> DataFrame:
    return work.join(results.filter(F.col("result").isNotNull()).select(key), key, "left_anti")


def merge(work: DataFrame, results: DataFrame, into: str, key: str = "_pos") -> DataFrame:
    """Work with its results, null where there is none; nested results become JSON."""
    kind = results.schema["result"].dataType.typeName()
    value = F.to_json("result") if kind in ("map", "array", "struct") else F.col("result")
    return work.join(results.select(key, value.alias(into)), key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str = "_pos") -> DataFrame:
    """New results over old ones: running a batch again changes nothing."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def clear(results: DataFrame, where: Column) -> DataFrame:
    """Results without those that meet a condition: their work is to be done again."""
    return results.filter(~F.coalesce(where, F.lit(False)))


def report(state: DataFrame) -> DataFrame:
    """A line of text for every shard's progress."""
    line = F.format_string("shard %d: %d of %d (%.1f %%)", F.col("shard_id"), F.col("done"), F.col("total"), F.col("percent"))
    return state.select("shard_id", line.alias("line"))


def repair(work: DataFrame, results: DataFrame, broken: list[int], size: int, key: str = "_pos") -> tuple[DataFrame, DataFrame]:
    """Results without those of broken shards, and the work that is left then."""
    kept = results.filter(~shard_id(F.col(key), size).isin(*broken))
    return kept, unprocessed(work, kept, key)


def resume_index(df: DataFrame, output: str, key: str = "_pos") -> DataFrame:
    """resume_at: the first place without an output; the number of rows if all have one."""
    return df.agg(F.coalesce(F.min(F.when(F.col(output).isNull(), F.col(key))), F.count(F.lit(1))).alias("resume_at"))


class Provider(Protocol):
    """Answers a batch of prompts; None for one that failed."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


class Annotator(Protocol):
    """Finds concepts: from rows (key, text) to mentions (key, concept_id, start)."""

    def __call__(self, df: DataFrame, text: str) -> DataFrame: ...


class Builder(Protocol):
    """Makes a data set: its rows, and the prompts that are answered to complete them."""

    def load(self) -> DataFrame: ...

    def prompts(self, df: DataFrame) -> DataFrame: ...


def retrying(provider: Provider, retries: int = 2, wait: float = 1.0) -> Provider:
    """Tries a batch again with growing waits; after that its answers are null."""

    def call(prompts: list[str]) -> list[str | None]:
        for attempt in range(retries + 1):
            try:
                return provider(prompts)
            except Exception:  # noqa: BLE001  whatever a provider raises
                if attempt < retries:
                    time.sleep(wait * 2**attempt)
        return [None] * len(prompts)

    return call


def aborting(provider: Provider, retries: int = 2, wait: float = 1.0) -> Provider:
    """As ``retrying``, but after the first batch that fails for good nothing more is asked: all other answers are null."""
    dead = False

    def call(prompts: list[str]) -> list[str | None]:
        nonlocal dead
        if dead:
            return [None] * len(prompts)

        dead = True

        def noting(batch: list[str]) -> list[str | None]:
            nonlocal dead
            got = provider(batch)
            dead = False
            return got

        return retrying(noting, retries, wait)(prompts)

    return call


def blocking(one: Callable[[str], str | None]) -> Provider:
    """A provider from a plain function for one prompt; a failure is a null."""

    def call(prompts: list[str]) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(one(p))
            except Exception:  # noqa: BLE001  whatever a provider raises
                out.append(None)
        return out

    return call


def chatting(ask: Callable[[list[dict]], str | None], system: str | None = None) -> Provider:
    """A provider from a function of messages: each prompt becomes a chat."""
    lead = [{"role": "system", "content": system}] if system else []
    return blocking(lambda p: ask([*lead, {"role": "user", "content": p}]))


def classify(df: DataFrame, text: str, model_factory: Callable[[], Callable[[list[str]], list[list[float]]]], names: list[str], batch: int = 16, into: str = "probabilities") -> DataFrame:
    """Adds a map from label to probability by a model that is made once in each task; null for null texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in frames:
            out: list[dict | None] = [None] * len(frame)
            places = frame[text].notna().to_numpy().nonzero()[0].tolist()
            for k in range(0, len(places), batch):
                part = places[k : k + batch]
                for place, row in zip(part, model([frame[text].iloc[p] for p in part]), strict=True):
                    out[place] = dict(zip(names, map(float, row), strict=True))
            yield frame.assign(**{into: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{into}` map<string,double>")


def infer_shards(work: DataFrame, results: DataFrame, prompt: str, provider_factory: Callable[[], Provider], shards: list[int] | DataFrame, size: int, key: str = "_pos", **more) -> DataFrame:
    """Results with the answers for what is unprocessed in some shards, a list or a table of shard_id, put over them."""
    if not isinstance(shards, DataFrame):
        shards = work.sparkSession.createDataFrame([(s,) for s in shards], "shard_id long")
    own = work.withColumn("shard_id", shard_id(F.col(key), size)).join(shards.select("shard_id"), "shard_id", "left_semi").select(*work.columns)
    todo = unprocessed(own, results, key)
    new = infer(todo, prompt, provider_factory, output="result", **more).filter(F.col("result").isNotNull()).select(key, "result")
    return upsert(results.select(key, "result"), new, key)


def answers(spark: SparkSession, folder: str, key_type: str = "long", key: str = "_pos") -> DataFrame:
    """What the waves in a folder have answered so far: key and result."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/wave-*/_SUCCESS")
    done = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    schema = f"`{key}` {key_type}, result string, asked boolean"
    rows = spark.read.schema(schema).parquet(*(s.getPath().getParent().toString() for s in done)) if done else spark.createDataFrame([], schema)
    return rows.filter("result is not null").select(key, "result")


def infer_in_waves(work: DataFrame, prompt: str, provider_factory: Callable[[], Provider], folder: str, size: int, per_wave: int, key: str = "_pos", **more) -> bool:
    """Asks for all that is unprocessed, ``per_wave`` shards at a time, and commits each wave to ``folder``; whether everything was answered.

    After a wave in which a prompt stayed without an answer no other begins, whatever task it was in: ``aborting`` keeps each task of that
    wave from asking on. What was answered is kept, and another run asks for what is left, the failed prompts first by their places.
    """
    spark = work.sparkSession
    kind = work.schema[key].dataType.simpleString()
    left = storage.table(spark, unprocessed(work.filter(F.col(prompt).isNotNull()), answers(spark, folder, kind, key), key).withColumn("__shard", shard_id(F.col(key), size)), "unprocessed")
    pending, last = storage.table(spark, left.select("__shard").distinct(), "pending"), -1
    while True:
        wave = [r[0] for r in pending.filter(F.col("__shard") > last).orderBy("__shard").limit(per_wave).collect()]
        if not wave:
            return True
        own = left.filter(F.col("__shard").between(wave[0], wave[-1])).drop("__shard", "result")  # the shards between have nothing left
        path, last = f"{folder}/wave-{uuid.uuid4().hex}", wave[-1]
        infer(own, prompt, provider_factory, output="result", **more).select(key, "result", F.lit(True).alias("asked")).write.parquet(path)
        if not spark.read.parquet(path).filter("result is null").isEmpty():
            return False


def concurrent(one: Callable[[str], object]) -> Provider:
    """A provider from an async function for one prompt: a batch runs at once, a failure is a null."""

    def call(prompts: list[str]) -> list[str | None]:
        async def run():
            return await asyncio.gather(*(one(p) for p in prompts), return_exceptions=True)

        return [None if isinstance(x, BaseException) else x for x in asyncio.run(run())]

    return call


def infer(df: DataFrame, prompt: str, provider_factory: Callable[[], Provider], batch: int = 200, most_length: int | None = None, output: str = "output") -> DataFrame:
    """Adds a model's answers. The provider is made once in each task; rows with an output keep it, rows
    whose prompt is null or too long get null, and none is lost."""
    had = output in df.columns
    rows = df if had else df.withColumn(output, F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = provider_factory()
        for frame in frames:
            todo = frame[output].isna() & frame[prompt].notna()
            if most_length:
                todo &= frame[prompt].str.len() <= most_length
            places = frame.index[todo].tolist()
            answers = frame[output].astype(object).where(frame[output].notna(), None)
            for k in range(0, len(places), batch):
                part = places[k : k + batch]
                for place, text in zip(part, provider(frame.loc[part, prompt].tolist()), strict=True):
                    answers.at[place] = text
            yield frame.assign(**{output: answers})

    return rows.mapInPandas(run, rows.schema)


def annotate(df: DataFrame, text: str, terms: DataFrame, key: str, overlapping: bool = True) -> DataFrame:
    """Mentions (key, concept_id, term, start in words, n_words, start_char, end_char) of terms (term, concept_id) in texts, whole words in any case;
    all of them, or of overlapping ones the leftmost and longest. ``key`` tells texts apart."""
    return mentions.find(df, text, terms, [key], "all" if overlapping else "apart")
