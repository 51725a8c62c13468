"""Answers to prompts, asked for once each, that outlive the run that asked.

A prompt is known by its batch and its text. Answers are rows of an
append-only table; what has one is anti-joined before anything is asked. The
work is done in a fixed number of waves, by a hash of the batch, each of which
adds its answers when it ends: a run that is stopped loses one wave at the
most, and the next run asks for the rest alone. A changed prompt is a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.storage import stored

KEY = ["batch_id", "prompt_hash"]
SCHEMA = "batch_id string, prompt_hash string, attempt long, answer string, error string"


def _keyed(prompts: DataFrame) -> DataFrame:
    return prompts.select(F.col("batch_id").cast("string").alias("batch_id"), F.coalesce("prompt", F.lit("")).alias("prompt")).distinct().withColumn("prompt_hash", F.sha2("prompt", 256))


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """One row a prompt: its answer if there is one, else its last error."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy(*KEY).agg(F.max(F.struct(F.col("answer").isNotNull().alias("got"), "attempt", "answer", "error")).alias("m")).select(*KEY, "m.attempt", "m.answer", "m.error")


def _same(a: DataFrame, b: DataFrame):
    return a["prompt_hash"].eqNullSafe(b["prompt_hash"]) & a["batch_id"].eqNullSafe(b["batch_id"])


def ask(prompts: DataFrame, provider: Callable[[str], str], path: str, attempt: int = 1, waves: int = 4, tasks: int | None = None) -> None:
    """Ask ``provider`` for an answer to every prompt (``batch_id, prompt``) that has none in the table at ``path``.

    An exception of the provider is kept as the ``error`` of the attempt; a
    later run tries again. ``tasks`` bounds the calls at a time. A task that
    Spark runs twice, after the loss of an executor, calls twice but leaves
    one answer.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for batch, prompt, key in zip(pdf["batch_id"], pdf["prompt"], pdf["prompt_hash"], strict=True):
                try:
                    out.append((batch, key, attempt, provider(prompt), None))
                except Exception as e:  # whatever a provider of the user raises is this prompt's error
                    out.append((batch, key, attempt, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["batch_id", "prompt_hash", "attempt", "answer", "error"])

    asked = stored(_keyed(prompts).withColumn("wave", F.pmod(F.xxhash64(*KEY), F.lit(waves))), "prompts")
    for wave in range(waves):
        known = _latest(spark, path).filter("answer is not null").select(*KEY)
        now = asked.filter(F.col("wave") == wave)
        now = now.join(known, _same(now, known), "left_anti")
        now = now.repartition(tasks or spark.sparkContext.defaultParallelism, *KEY)
        now.mapInPandas(call, SCHEMA).write.mode("append").parquet(path)


def answered(prompts: DataFrame, path: str) -> DataFrame:
    """``batch_id, prompt, attempt, answer, error`` of every different prompt; nulls for one that was never asked."""
    asked, known = _keyed(prompts), _latest(prompts.sparkSession, path)
    return asked.join(known, _same(asked, known), "left").select(asked["batch_id"], "prompt", "attempt", "answer", "error")


def split_answers(rows: DataFrame, record: str) -> dict[str, DataFrame]:
    """``records`` and a ``report`` of answered prompts, both from one staged pass.

    ``record`` is the type of an object in an answer, as DDL. The report has
    a row a prompt: ``batch_id, status, problem, diagnostics, record_count``;
    ``problem`` is PROVIDER_ERROR, NOT_ASKED or what is wrong with the answer.
    """
    problem = F.when(F.col("attempt").isNull(), "NOT_ASKED").when(F.col("answer").isNull(), "PROVIDER_ERROR").otherwise(text.answer_problem(F.col("answer")))
    parsed = rows.select("batch_id", problem.alias("problem"), F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(text.answer_diagnostics(F.col("answer"))).alias("diagnostics"), F.when(problem.isNull(), F.from_json(text.json_candidate(F.col("answer")), f"array<{record}>")).alias("records"))
    parsed = stored(parsed, "answers")
    report = parsed.select("batch_id", F.when(F.col("problem").isNull(), "completed").otherwise("failed").alias("status"), "problem", "diagnostics", F.coalesce(F.size("records"), F.lit(0)).alias("record_count"))
    return {"records": parsed.select("batch_id", F.explode("records").alias("r")).select("batch_id", "r.*"), "report": report}
