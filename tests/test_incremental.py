"""Summaries by batches: any order, replays, corrections, streams."""

import random

from pyspark.sql import functions as F

from siftworks.operators import incremental, trust

SCHEMA = "batch_id string, approval_status string, repair_count int, quality_score long, record_confidence double"


def records(n):
    draw = random.Random(n)
    return [(f"b{i % 7}" if i % 7 else None, draw.choice(incremental.STATUSES), draw.randrange(5), draw.randrange(101), draw.random()) for i in range(n)]


def plain(rows):
    return tuple(round(x, 9) for x in trust.trust_summary(rows).first())


def merged(spark, path):
    return tuple(round(x, 9) for x in incremental.merged_summary(incremental.latest(spark, path)).first())


def test_any_order_replays_and_corrections(spark, tmp_path):
    rows = spark.createDataFrame(records(500), SCHEMA)
    own = lambda b: rows.filter(F.col("batch_id").eqNullSafe(b))
    for run, order in enumerate(([None, "b1", "b2", "b3", "b4", "b5", "b6"], ["b6", "b2", "b2", None, "b1", "b5", "b3", "b4", None])):
        path = str(tmp_path / f"t{run}")
        incremental.record_batches(own("b2").withColumn("repair_count", F.lit(99)), path, version=0)
        for b in order:
            incremental.record_batches(own(b), path)
        assert merged(spark, path) == plain(rows)
        incremental.record_batches(own("b3").limit(1), path, version=5)
        assert merged(spark, path) == plain(rows.filter("batch_id is null or batch_id <> 'b3'").unionByName(own("b3").limit(1)))
        incremental.compact(spark, path, path + "-compact")
        assert spark.read.parquet(path + "-compact").count() == 7 and merged(spark, path + "-compact") == merged(spark, path)


def test_no_batches(spark, tmp_path):
    incremental.record_batches(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert merged(spark, str(tmp_path / "none")) == (0, 0, 0, 0, 0, 0.0, 0.0, 0)


def test_stream_counts_every_record_once(spark, tmp_path):
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = spark.createDataFrame(records(300), SCHEMA)
    for part in range(2):
        rows.filter(F.pmod(F.hash("record_confidence"), F.lit(2)) == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        incremental.summarize_stream(stream, path, state).awaitTermination()
    assert merged(spark, path) == plain(rows)
    replayed = spark.read.parquet(path).filter("batch_id = 'stream-1'")  # a micro-batch that ran twice
    replayed.select(*spark.read.parquet(path).columns).write.mode("append").parquet(path)
    assert merged(spark, path) == plain(rows)
