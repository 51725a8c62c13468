"""What an import came to, written in one pass and visible all at once.

Records by decision, failed batches and issues are rows of one table, each
under its ``part``, so one job writes them all and what made the records runs
once. A run writes into a folder of its own; it counts from the moment its
one-row commit is there. So a run that is killed, even while its files are
being moved, leaves nothing a reader sees, and of two runs of one import
readers see the later version, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

STATUSES = ("approved", "needs_review", "rejected", "skipped")
PARTS = (*STATUSES, "other", "failed", "issues")
COMMIT = "import_id string, version long, run string"
ISSUE = "struct<batch_id:string,severity:string,code:string>"


def _rows(batches: DataFrame, records: DataFrame) -> DataFrame:
    """``part`` and one of ``record``, ``batch`` and ``issue``, the others null."""
    done = records.join(batches.filter("status = 'completed'").select("batch_id"), "batch_id", "left_semi").select(*records.columns)
    status = F.col("approval_status")
    of_records = done.select(F.when(status.isin(*STATUSES), status).otherwise("other").alias("part"), F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"))
    none = F.array().cast("array<string>")
    listed = lambda column, severity: F.transform(F.coalesce(F.col(column), none), lambda x: F.struct(F.lit("issues").alias("part"), F.lit(None).cast(batches.schema).alias("batch"), F.struct(F.col("batch_id").cast("string").alias("batch_id"), F.lit(severity).alias("severity"), x.alias("code")).alias("issue")))
    own = F.struct(F.lit("failed").alias("part"), F.struct(*(F.col(f"`{c}`") for c in batches.columns)).cast(batches.schema).alias("batch"), F.lit(None).cast(ISSUE).alias("issue"))
    lost = F.filter(F.array(own), lambda _: ~F.col("status").eqNullSafe("completed"))
    of_batches = batches.select(F.inline(F.concat(lost, listed("warnings", "warning"), listed("errors", "error"))))
    return of_records.unionByName(of_batches, allowMissingColumns=True).select("part", "record", "batch", "issue")


def write_outcome(batches: DataFrame, records: DataFrame, path: str, import_id: str, version: int = 1) -> str:
    """Write the outcome of reconciled ``batches`` and validated ``records``; returns the name of the run.

    The parts are those of ``batches.outcome``: records of completed batches
    by ``approval_status`` (``other``: none of the four, null included), the
    batches that ``failed`` (null status included) and all ``issues``.
    ``version`` says which run of an import counts: the highest.
    """
    spark, run = records.sparkSession, uuid.uuid4().hex
    _rows(batches, records).write.partitionBy("part").mode("errorifexists").parquet(f"{path}/rows/run={run}")
    spark.createDataFrame([(import_id, version, run)], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return run


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``import_id, version, run``: of each import the run that counts."""
    found = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    return found.groupBy("import_id").agg(F.max(F.struct("version", "run")).alias("m")).select("import_id", "m.version", "m.run")


def read_part(spark: SparkSession, path: str, part: str, schema: T.StructType | str) -> DataFrame:
    """One part of all imports, with ``import_id``; ``schema`` is that of the records, or of the batches for ``failed``.

    The part and the runs that count are folders, so no other file is read.
    """
    if part not in PARTS:
        raise ValueError(f"no part {part!r}")
    name = "issue" if part == "issues" else "batch" if part == "failed" else "record"
    inner = T._parse_datatype_string(ISSUE if part == "issues" else schema) if part == "issues" or isinstance(schema, str) else schema
    whole = T.StructType([T.StructField(name, inner), T.StructField("run", T.StringType()), T.StructField("part", T.StringType())])
    rows = spark.read.schema(whole).parquet(f"{path}/rows").filter(F.col("part") == part)
    return rows.join(runs(spark, path).select(F.col("import_id").alias("_import"), "run"), "run").select(F.col("_import").alias("import_id"), f"{name}.*")


def write_stream(records: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """The outcome of every micro-batch of validated records, each a batch and an import ``name-<number>``.

    A micro-batch that is replayed after a failure commits a second run of
    its import, of which readers see one.
    """

    def take(rows: DataFrame, number: int) -> None:
        own = f"{name}-{number}"
        batch = rows.sparkSession.createDataFrame([(own, "completed", [], [])], "batch_id string, status string, warnings array<string>, errors array<string>")
        write_outcome(batch, rows.withColumn("batch_id", F.lit(own)), path, own)

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
