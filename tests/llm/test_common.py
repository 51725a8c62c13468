"""Joins of hot keys, staged folders."""

import os

import pytest
from pyspark.sql import functions as F

from siftworks.llm import common


def test_lookup_join_of_a_hot_key(spark):
    rows = spark.range(3000).select((F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id"))).alias("k"), "id")
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = common.join_lookup(rows, lookup, "k", "n", ["id"]).collect()
    assert sorted((r.id, r.k, r.v) for r in got) == [(i, i if i % 3 == 0 else 7, 2 * (i if i % 3 == 0 else 7)) for i in range(3000)]
    assert common.join_lookup(rows.limit(0), lookup.limit(0), "k", "n", ["id"]).count() == 0


def test_staged_tables_are_cleared(spark):
    df = common.staged(spark.range(5), "some")
    (folder,) = {os.path.dirname(f.removeprefix("file://")) for f in df.inputFiles()}
    assert df.count() == 5 and os.path.isdir(folder)
    assert common.clear_staged(spark) > 0 and not os.path.exists(folder)


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_unused_names(spark):
    df = spark.range(1).selectExpr("id as _A", "id as __a", "id as b")
    assert common.unused(df, "_a", "b", "c") == ["___a", "_b", "c"]
