"""Summaries of an import that grow batch by batch.

Each batch leaves one row of partial sums, keyed by the batch, in an
append-only table. A batch that is run again adds a row of a later version,
or one equal to its own; reading takes each batch's latest. So batches may
come in any order, late, or more than once, and the sums, which are integers
and decimals, are those of one pass over everything. A write that is killed
leaves no visible row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATUSES = ("approved", "needs_review", "rejected", "skipped")
COUNTS = ["record_count", *(f"{s}_count" for s in STATUSES), "repair_count", "quality_sum"]
SCHEMA = "batch_id string, version long, " + ", ".join(f"{c} long" for c in COUNTS) + ", confidence_sum decimal(38,15)"


def partials(validated: DataFrame, version: int) -> DataFrame:
    """One row of sums for every ``batch_id`` of validated records (null: a batch of its own)."""
    rows = validated.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("record_count"), *(F.count_if(F.col("approval_status") == s).alias(f"{s}_count") for s in STATUSES),
        F.coalesce(F.sum("repair_count"), F.lit(0)).cast("long").alias("repair_count"), F.coalesce(F.sum("quality_score"), F.lit(0)).cast("long").alias("quality_sum"),
        F.coalesce(F.sum(F.col("record_confidence").cast("decimal(18,15)")), F.lit(0)).cast("decimal(38,15)").alias("confidence_sum"),
    )
    return rows.select("batch_id", F.lit(version).cast("long").alias("version"), *COUNTS, "confidence_sum")


def record_batches(validated: DataFrame, path: str, version: int = 1) -> None:
    """Add the partial sums of all batches in ``validated`` to the table at ``path``."""
    partials(validated, version).write.mode("append").parquet(path)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The partial sums that count: one row a batch, that of its highest version."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = F.struct(*COUNTS, "confidence_sum")
    return rows.groupBy("batch_id").agg(F.max(F.struct("version", sums.alias("s"))).alias("m")).select("batch_id", "m.version", "m.s.*")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write the rows that count to a new table."""
    latest(spark, path).write.mode("errorifexists").parquet(into)


def merged_summary(parts: DataFrame) -> DataFrame:
    """What ``trust_summary`` says of all records, from one row of sums a batch."""
    out = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS), F.sum("confidence_sum").alias("confidence_sum"))
    share = lambda c: F.when(F.col("record_count") > 0, F.col(c).cast("double") / F.col("record_count")).otherwise(0.0)
    return out.select("record_count", *(f"{s}_count" for s in STATUSES), share("confidence_sum").alias("average_confidence"), share("quality_sum").alias("average_quality"), "repair_count")


def summarize_stream(validated: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Partial sums of every micro-batch of a stream of validated records, under ``name-<number>``.

    A micro-batch that is replayed after a failure writes the row it would
    have written: with the checkpoint, every record counts once.
    """

    def take(rows: DataFrame, number: int) -> None:
        record_batches(rows.withColumn("batch_id", F.lit(f"{name}-{number}")), path)

    return validated.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
