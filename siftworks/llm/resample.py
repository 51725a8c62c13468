"""Importance resampling of documents towards the distribution of a target.

Documents and target texts are bags of hashed word n-grams. A bucket's gain
is the rounded log ratio of its share of the target to its share of the
documents, a document's weight the sum of the gains of its features, and the
documents of the highest weights plus Gumbel noise of their own are a sample
without replacement whose features are distributed like the target's.

Features and weight depend on the text alone: identical texts collapse first,
by grouping the full text, each is read once, and its counts are multiplied by
the number of its copies. The weights are joined back to the documents by a
digest of the text before each document gets its own noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_lookup, staged, unused
from .mixing import running

#: Letters and digits of ASCII, A-Z as a-z, and all bytes of other characters are parts of words; the rest separates.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def feature_buckets(text: bytes, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> tuple[int, np.ndarray]:
    """The number of words and the bucket of each run of ``ngrams[0]`` to ``ngrams[1]`` words, joined by a space."""
    words = text.translate(_WORDS).split()
    sums = list(map(zlib.crc32, words))
    found: list[int] = []
    for n in range(1, ngrams[1] + 1):
        if n > 1:  # a run's checksum goes on from that of its beginning
            sums = [zlib.crc32(b" " + w, s) for s, w in zip(sums, words[n - 1 :], strict=False)]
        if n >= ngrams[0]:
            found += sums
    return len(words), np.array(found, np.int64) % buckets


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def collapsed_features(texts: DataFrame, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """``key, copies, n_words, n_features, bucket, count`` of every distinct ``text``; the last two are packed 32-bit integers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                n, found = feature_buckets(text.encode(), ngrams, buckets)
                bucket, count = np.unique(found, return_counts=True)
                rows.append((n, len(found), bucket.astype("<i4").tobytes(), count.astype("<i4").tobytes()))
            yield pd.concat([pdf[["key", "copies"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_words", "n_features", "bucket", "count"])], axis=1)

    rows = texts.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("text", text_key(F.col("text")).alias("key"), "copies")
    return bounded_batches(rows).mapInPandas(run, "key binary, copies long, n_words long, n_features long, bucket binary, count binary")


def bucket_totals(features: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: all features of all copies, by bucket; a task sends at most one row a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for copies, bucket, count in zip(pdf["copies"], pdf["bucket"], pdf["count"], strict=True):
                total[np.frombuffer(bucket, "<i4")] += np.frombuffer(count, "<i4").astype(np.int64) * copies
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    parts = features.select("copies", "bucket", "count").mapInPandas(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, gain`` of every bucket from the totals of both sides: ``floor(1000 ln of the ratio of the smoothed shares)``."""
    side = lambda df, name: df.select("bucket", F.col("n").alias(name))
    both = documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(side(documents, "s"), "bucket", "left").join(side(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = staged(both, "resample-buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c, more: (c + more).cast("double")
    ratio = d(F.col("t"), 1) * d(F.lit(all_s), buckets) / (d(F.col("s"), 1) * d(F.lit(all_t), buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def resample_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null where it isn't drawn.

    ``docs`` has ``doc_id, text``, ``target`` has ``text``; other columns are
    ignored, whatever their names. Of the rows with at least ``least_words``
    words, ``percent`` in a hundred are drawn, the highest scores first, ties
    to the smaller id (null last), then to the smaller weight and number of
    features. Null text has no words, as has an empty one; both weigh 0 and
    are never drawn. A null id takes its noise from the seed alone, repeated
    ids have equal noise, repeated rows are rows of their own. Without
    documents there are no rows, without target texts all its shares are
    equal.

    Only the gains, one integer for each of ``buckets``, pass the driver. A
    text held by many documents is one row of counts; its documents are dealt
    to many tasks for the join. The order of all documents is that of
    ranges, each sorted by itself. Options: ``percent, least_words, ngrams``
    (the lengths of runs of words, both included), ``buckets, seed``.
    """
    return _ranked(docs, target, **options).drop("key")


def _ranked(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    features = staged(collapsed_features(docs.select("text"), ngrams, buckets), "resample-features")
    aim = staged(collapsed_features(target.select("text"), ngrams, buckets), "resample-target")
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(bucket_totals(features, buckets), bucket_totals(aim, buckets), buckets).collect():
        gains[row["bucket"]] = row["gain"]

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weight = [int(gains[np.frombuffer(b, "<i4")] @ np.frombuffer(c, "<i4").astype(np.int64)) for b, c in zip(pdf["bucket"], pdf["count"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "copies": pdf["copies"], "n_words": pdf["n_words"], "n_features": pdf["n_features"], "weight": np.array(weight, np.int64)})

    weights = staged(features.mapInPandas(weigh, "key binary, copies long, n_words long, n_features long, weight long"), "resample-weights")
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    narrow = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.monotonically_increasing_id().alias("salt")), "resample-docs")
    rows = join_lookup(narrow, weights, "key", "copies", ["salt"])
    rows = staged(rows.select("doc_id", "key", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("long_enough")), "resample-scores")
    drawn = (rows.filter("long_enough").count() * percent) // 100
    order = [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    ranked = running(rows, order, [], "resample-ranks")
    rank = F.when(F.col("_rank") <= drawn, F.col("_rank").cast("long"))
    return ranked.select("doc_id", "key", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with the columns of ``docs``; rows equal in id and text to a drawn one come with it."""
    drawn, key = unused(docs, "_drawn", "_key")
    chosen = _ranked(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias(drawn), F.col("key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(drawn)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(chosen, same, "left_semi")
