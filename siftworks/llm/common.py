"""Helpers shared by the operators: shared storage, tokenizer files, words."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 pattern of one word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_staged: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else that of ``setCheckpointDir``.

    Only a local session may go without: it gets a temporary folder. On a
    cluster no executor could read what another wrote there, so that is an
    error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a shared folder when the master is {master}")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="siftworks-")
    return _own[app]


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, remembered for ``clear_staged``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage at a place that every executor can read, so losing
    an executor never recomputes what lies before it, and a result used twice
    is computed once.
    """
    path = staged_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> int:
    """Delete what this application staged; call it once results are written. Returns the number of folders."""
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: str, spread: list[str]) -> DataFrame:
    """``rows`` joined with the one row of ``lookup`` for their ``key``, neither key null.

    ``count``, a column of ``lookup``, says how many rows have the key. A key
    of more rows than a partition's mean is cut into ways: its rows go by a
    hash of their ``spread`` columns, its lookup row to each way. The ways
    of all such keys are at most as many as partitions, so their list, of
    keys alone, is broadcast; ``lookup`` should be staged, it is read twice.
    """
    spark = rows.sparkSession
    total = lookup.agg(F.sum(count)).first()[0] or 0
    mean = max(64, -(-total // partitions(spark)))
    ways = lookup.filter(F.col(count) > mean).select(F.col(key).alias("_hot"), F.ceil(F.col(count) / mean).cast("int").alias("_ways"))
    cut = lambda df, way: df.join(F.broadcast(ways), F.col(key) == F.col("_hot"), "left").withColumn("_way", F.coalesce(way, F.lit(0))).drop("_hot", "_ways")
    left = cut(rows, F.pmod(F.xxhash64(*spread), F.col("_ways")).cast("int"))
    right = lookup.drop(count).join(F.broadcast(ways), F.col(key) == F.col("_hot"), "left").withColumn("_way", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_hot", "_ways")
    return left.join(right, [key, "_way"]).drop("_way")


def bounded_batches(df: DataFrame, rows: int = 2048, size: int = 4 << 20) -> DataFrame:
    """``df``, with Arrow batches held to ``rows`` and ``size`` bytes, so that batches of long texts stay small.

    Spark reads these limits from the session when a plan runs, so they are
    lowered there for good; limits that are already lower stay.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def partitions(spark: SparkSession) -> int:
    """The deployment's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; ``SIFTWORKS_TOKENIZERS`` names another folder."""
    folder = os.environ.get("SIFTWORKS_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A single-threaded fast tokenizer without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_unseen(tok, units: list[str], budget: int = 1 << 16):
    """Encode distinct units in batches of about ``budget`` bytes, longest first.

    Yields ``(unit, ids)``. Sorting by length keeps each batch of even cost.
    """
    size = lambda u: (len(u) if u.isascii() else len(u.encode())) + 8
    units.sort(key=len, reverse=True)
    at = 0
    while at < len(units):
        end, held = at, 0
        while end < len(units) and (held == 0 or held + size(units[end]) <= budget):
            held += size(units[end])
            end += 1
        batch = units[at:end]
        for unit, enc in zip(batch, tok.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            yield unit, enc.ids
        at = end
