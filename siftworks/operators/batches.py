"""Batches of an import, their results and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp

RESULT = ["batch_id", "status", "started_ms", "ended_ms", "cost_usd", "warnings", "errors"]


def batch_number(row_number: Column, batch_size: int) -> Column:
    if batch_size <= 0:
        raise ValueError("the batch size must be positive")
    return F.floor((row_number - 1) / batch_size) + 1


def assign_batches(rows: DataFrame, batch_size: int, import_id: str = "import") -> DataFrame:
    """``batch_index`` and ``batch_id`` from row numbers; a projection."""
    n = batch_number(F.col("row_number"), batch_size).cast("long")
    return rows.withColumn("batch_index", n).withColumn("batch_id", F.concat(F.lit(f"{import_id}-batch-"), n.cast("string")))


def reconcile(batches: DataFrame, results: DataFrame) -> DataFrame:
    """A result for every row of ``batches`` (``batch_id, record_count``): its own, or one that says it was cancelled.

    ``results`` has the columns ``RESULT``, one row a batch; those of unknown
    batches are left out. A batch without a result took no time, cost
    nothing and has the one error ``BATCH_CANCELLED``.
    """
    got = results.select(F.col("batch_id").alias("_batch"), *(c for c in RESULT if c != "batch_id"))
    out = batches.join(got, F.col("batch_id") == F.col("_batch"), "left").drop("_batch")
    none = F.array().cast("array<string>")
    return out.withColumns({
        "errors": F.when(F.col("status").isNull(), F.array(F.lit("BATCH_CANCELLED"))).otherwise(F.coalesce("errors", none)),
        "warnings": F.coalesce("warnings", none),
        "status": F.coalesce("status", F.lit("cancelled")),
    })


def outcome(batches: DataFrame, records: DataFrame) -> dict[str, DataFrame]:
    """What an import came to, of reconciled ``batches`` and the validated ``records`` of all of them.

    ``approved, needs_review, rejected, skipped``: the records of completed
    batches, split by decision. ``failed``: the batches that didn't complete.
    ``issues``: ``batch_id, severity, code`` of all that the batches reported.
    Records of a batch that failed stand in none of the four.
    """
    done = records.join(batches.filter("status = 'completed'").select("batch_id"), "batch_id", "left_semi")
    split = {s: done.filter(F.col("approval_status") == s) for s in ("approved", "needs_review", "rejected", "skipped")}
    tagged = lambda column, severity: F.transform(column, lambda x: F.struct(F.lit(severity).alias("severity"), x.alias("code")))
    listed = F.concat(tagged("warnings", "warning"), tagged("errors", "error"))
    issues = batches.select("batch_id", F.explode(listed).alias("i")).select("batch_id", "i.severity", "i.code")
    return {**split, "failed": batches.filter("status <> 'completed'"), "issues": issues}


def execution_metrics(results: DataFrame, workers: int) -> DataFrame:
    """Totals over reconciled batches: utilization, throughput, progress, time left.

    ``remaining_ms`` supposes that the batches still to come take as long as
    those that are through; null before the first is.
    """
    elapsed = F.max("ended_ms") - F.min("started_ms")
    busy = F.sum(F.col("ended_ms") - F.col("started_ms"))
    out = results.agg(
        F.count(F.lit(1)).alias("batch_count"),
        F.count_if(F.col("status") == "completed").alias("completed_count"),
        F.count_if(F.col("status") != "completed").alias("failed_count"),
        F.count_if(F.col("ended_ms").isNotNull()).alias("ended_count"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast("long").alias("record_count"),
        F.sum("cost_usd").alias("cost_usd"),
        F.coalesce(elapsed, F.lit(0)).cast("long").alias("elapsed_ms"),
        F.coalesce(busy, F.lit(0)).cast("long").alias("busy_ms"),
    )
    e, n, ended = F.col("elapsed_ms"), F.col("batch_count"), F.col("ended_count")
    return out.withColumns({
        "utilization": F.when(e > 0, clamp(F.col("busy_ms") / (e * workers))).otherwise(0.0),
        "records_per_second": F.when(e > 0, F.col("record_count") / (e / 1000)).otherwise(0.0),
        "percent_complete": F.when(n > 0, F.col("completed_count") / n * 100).otherwise(0.0),
        "remaining_ms": F.when(ended > 0, e / ended * (n - ended)),
    })
