"""One-pass writes of an import's parts: whole, versioned, unseen until committed."""

import random

import pytest
from pyspark.sql import functions as F

from siftworks.operators import batches, ledger

RECORD = "row_number long, batch_id string, approval_status string, part string"
BATCH = "batch_id string, status string, warnings array<string>, errors array<string>, record_count long"


def made(spark, n=60):
    draw = random.Random(n)
    rows = [(i, f"b{i % 6}" if i % 11 else None, draw.choice([*ledger.STATUSES, None, "odd"]), "own") for i in range(n)]
    b = [("b0", "completed", ["W"], []), ("b1", "failed", [], ["E", "F"]), ("b2", "completed", None, None), ("b3", "cancelled", ["W"], ["E"]), ("b4", None, [], []), ("b5", "completed", [], [])]
    return spark.createDataFrame([(*x, 10) for x in b], BATCH), spark.createDataFrame(rows, RECORD)


def test_parts_are_those_of_outcome(spark, tmp_path):
    b, r = made(spark)
    path = str(tmp_path)
    ledger.write_outcome(b, r, path, "one")
    want = batches.outcome(b.fillna({"status": "lost"}), r)
    rows = lambda df: sorted(map(repr, df.collect()))
    for part in ledger.STATUSES:
        assert rows(ledger.read_part(spark, path, part, RECORD).drop("import_id")) == rows(want[part].select(*r.columns))
    assert rows(ledger.read_part(spark, path, "issues", "").drop("import_id")) == rows(want["issues"])
    assert rows(ledger.read_part(spark, path, "failed", b.schema).select("batch_id")) == rows(want["failed"].select("batch_id"))
    other = r.filter("batch_id in ('b0', 'b2', 'b5') and (approval_status is null or approval_status = 'odd')")
    assert rows(ledger.read_part(spark, path, "other", RECORD).drop("import_id")) == rows(other)
    with pytest.raises(ValueError):
        ledger.read_part(spark, path, "x", RECORD)


def test_killed_writes_and_reruns(spark, tmp_path):
    b, r = made(spark)
    path = str(tmp_path)
    count = lambda: ledger.read_part(spark, path, "approved", RECORD).groupBy("import_id").count().collect()
    n = ledger.write_outcome(b, r, path, "one") and dict(count())
    ledger.write_outcome(b, r, path, "one")  # a replay
    assert dict(count()) == n
    broken = r.withColumn("approval_status", F.when(F.col("row_number") == 59, F.raise_error(F.lit("killed"))).otherwise(F.col("approval_status")))
    with pytest.raises(Exception, match="killed"):
        ledger.write_outcome(b, broken, path, "one", version=3)
    ledger._rows(b, r).write.partitionBy("part").parquet(f"{path}/rows/run=neverdone")  # its files are there, its commit isn't
    assert dict(count()) == n
    ledger.write_outcome(b, r.filter("row_number < 30"), path, "one", version=2)
    ledger.write_outcome(b, r, path, "two")
    assert dict(count())["two"] == n["one"] and dict(count())["one"] < n["one"]


def test_an_empty_import(spark, tmp_path):
    b, r = made(spark)
    ledger.write_outcome(b.limit(0), r.limit(0), str(tmp_path), "none")
    assert ledger.read_part(spark, str(tmp_path), "approved", RECORD).count() == 0
    assert ledger.runs(spark, str(tmp_path)).count() == 1


def test_stream(spark, tmp_path):
    _, r = made(spark)
    source, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in range(2):
        r.filter(F.col("row_number") % 2 == part).write.mode("append").parquet(source)
        ledger.write_stream(spark.readStream.schema(RECORD).parquet(source), path, state).awaitTermination()
    assert ledger.read_part(spark, path, "approved", RECORD).count() == r.filter("approval_status = 'approved'").count()
    assert ledger.runs(spark, path).count() == 2
