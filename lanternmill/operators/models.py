"""Models as operators: loaded once a worker, asked in batches, tried again, remembered by content.

A model is given as a function that loads it and returns a function of a list of prompts. What it was asked is kept in a
table, so a prompt is asked once, whatever the number of rows, runs and recomputed tasks; what it failed on is a column.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternmill.operators.retrieval import RERANK_DEPTH
from lanternmill.session import shared_path

Answers = Callable[[list[str]], list[str | None]]
_loaded: dict[str, Answers] = {}


@dataclass(frozen=True)
class Model:
    """name tells models apart, in a worker and in the cache: another version needs another name. pause is the first wait
    in seconds before a try is repeated; it doubles."""

    name: str
    load: Callable[[], Answers] = field(compare=False)
    batch: int = 32
    tries: int = 3
    pause: float = 0.2


def _answered(model: Model, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt. A batch that fails every time is asked prompt by prompt, so that one bad prompt
    costs itself alone."""
    error = ""
    for k in range(model.tries):
        try:
            if model.name not in _loaded:
                _loaded[model.name] = model.load()
            answers = _loaded[model.name](prompts)
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(None if a is None else str(a), None if a is not None else "no answer") for a in answers]
        except Exception as e:  # whatever a model raises is its failure
            error = f"{type(e).__name__}: {e}"
            if k + 1 < model.tries:
                time.sleep(model.pause * 2**k)
    if len(prompts) > 1:
        return [x for p in prompts for x in _answered(model, [p])]
    return [(None, error)]


ANSWERS = "key string, answer string, error string"


def ask(texts: DataFrame, model: Model, cache: str | None = None) -> DataFrame:
    """key, answer, error of texts (key, prompt): each key once; a null prompt is an empty one.

    Answers are kept in the table at `cache`, in a folder a model, and taken from there; failures are not kept, so a later
    run asks again. Without a cache the answers of this call are a new table. The model is asked before this returns:
    what reads the result later reads the table.
    """
    spark = texts.sparkSession
    wanted = texts.groupBy("key").agg(F.min(F.coalesce("prompt", F.lit(""))).alias("prompt"))
    known = _kept(spark, cache, model) if cache else None
    missing = wanted.join(known, "key", "left_anti") if known is not None else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, model.batch):
                part = batch.slice(at, model.batch)
                found = _answered(model, part["prompt"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["key"], pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["key", "answer", "error"])

    new = shared_path(spark, "answers")
    missing.mapInArrow(run, ANSWERS).write.parquet(new)
    fresh = spark.read.schema(ANSWERS).parquet(new)
    if not cache:
        return fresh
    fresh.where("error is null").withColumn("model", F.lit(model.name)).write.mode("append").partitionBy("model").parquet(cache)
    return wanted.select("key").join(_kept(spark, cache, model).unionByName(fresh.where("error is not null")), "key")


def _kept(spark: SparkSession, cache: str, model: Model) -> DataFrame:
    """The answers in a cache; a key that two runs asked at a time counts once."""
    spark.createDataFrame([], f"{ANSWERS}, model string").write.mode("ignore").partitionBy("model").parquet(cache)
    rows = spark.read.schema(f"{ANSWERS}, model string").parquet(cache).where(F.col("model") == model.name)
    return rows.groupBy("key").agg(F.min("answer").alias("answer")).withColumn("error", F.lit(None).cast("string"))


def _pair(question: Column, text: Column) -> Column:
    return F.to_json(F.array(F.coalesce(question, F.lit("")), F.coalesce(text, F.lit(""))))


def rerank(candidates: DataFrame, model: Model, n: int = RERANK_DEPTH, cache: str | None = None) -> DataFrame:
    """query_id, id, rerank_score, rerank_position, error of the n best of each query's candidates (query_id, id, position,
    question, text), by the score that the model gives a pair, the JSON array [question, text].

    Where the model fails on one of a query's pairs, or gives no number, the query keeps its first n candidates by
    position, without scores and with the error. Ties go to the earlier position, then the smaller id.
    """
    pairs = candidates.select("query_id", "id", "position", _pair(F.col("question"), F.col("text")).alias("prompt")).withColumn("key", F.sha2("prompt", 256))
    said = ask(pairs.select("key", "prompt"), model, cache)
    score = F.expr("try_cast(answer AS double)")
    rated = pairs.drop("prompt").join(said, "key").select("query_id", "id", "position", score.alias("rerank_score"), F.coalesce("error", F.when(score.isNull(), F.lit("not a number"))).alias("error"))
    failed = F.max("error").over(Window.partitionBy("query_id"))
    rated = rated.withColumn("error", failed).withColumn("rerank_score", F.when(F.col("error").isNull(), F.col("rerank_score")))
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "position", "id")
    return rated.withColumn("rerank_position", F.row_number().over(best).cast("long")).where(F.col("rerank_position") <= n).select("query_id", "id", "rerank_score", "rerank_position", "error")
