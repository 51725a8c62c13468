"""The closest term of a vocabulary of any size, within some edits.

A term that is ``most`` edits away keeps one of ``most + 1`` segments whole,
moved by no more than ``most`` places. So terms are indexed by their segments
and values look up their substrings at such places: a join by equality admits
the pairs, ``levenshtein`` decides them. Terms too short for that are indexed
by what is left of them after deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect


def plain_text(value: Column) -> Column:
    """As values are compared: lower case, trimmed, with underscores for blanks and hyphens."""
    return F.regexp_replace(F.lower(detect.trim(value)), r"(?U)[\s-]+", "_")


def _segment(length: str, i: str, k: int) -> tuple[str, str]:
    """Place (from 0) and size of segment ``i`` of ``k`` of a text of ``length``, as SQL; the last ones are the longer."""
    size = f"({length} div {k} + if({i} >= {k} - {length} % {k}, 1, 0))"
    return f"({i} * ({length} div {k}) + greatest(0, {i} - ({k} - {length} % {k})))", size


def _term_keys(most: int) -> str:
    place, size = _segment("n", "i", most + 1)
    return f"transform(sequence(0, {most}), i -> named_struct('n', n, 'i', i, 'part', substring(t, {place} + 1, {size})))"


def _value_keys(most: int) -> str:
    """The keys of all terms of more than ``most`` characters that a value ``t`` of ``n`` characters may be near to."""
    place, size = _segment("m", "i", most + 1)
    low, high = f"greatest(0, {place} - {most})", f"least(n - {size}, {place} + {most})"
    cut = f"if({low} <= {high}, transform(sequence({low}, greatest({low}, {high})), s -> named_struct('n', m, 'i', i, 'part', substring(t, s + 1, {size}))), array())"
    return f"array_distinct(flatten(transform(sequence(greatest({most} + 1, n - {most}), greatest({most} + 1, n + {most})), m -> flatten(transform(sequence(0, {most}), i -> {cut})))))"


def _deletions(most: int) -> Column:
    """What up to ``most`` deletions leave of ``t``, but for nothing at all."""
    out = F.array(F.col("t"))
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))))
    return F.filter(out, lambda x: x != "")


def closest_terms(values: DataFrame, vocabulary: DataFrame, most: int = 3) -> DataFrame:
    """``value, closest, distance`` for every different ``value`` of ``values``: the term at the least edit distance up to ``most``.

    ``vocabulary`` has ``term, place``; of several terms the one of the
    smallest place wins, then the smaller text. Where no term is near, both
    are null; a null value, which is near to nothing, has a row as well. The
    result is that of a comparison with every term.
    """
    if most < 1:
        raise ValueError("most must be 1 or more")
    terms = vocabulary.filter(F.col("term").isNotNull()).groupBy("term").agg(F.min("place").alias("place")).withColumn("t", F.lower("term")).withColumn("n", F.length("t"))
    asked = values.select("value").distinct().withColumn("t", plain_text(F.col("value"))).withColumn("n", F.length("t"))
    key = lambda df, keys: df.withColumn("k", F.explode(F.expr(keys) if isinstance(keys, str) else keys))

    long = key(terms.filter(F.col("n") > most), _term_keys(most)).select("k", F.col("t").alias("other"), "term", "place")
    pairs = key(asked.filter(f"n + {most} > {most}"), _value_keys(most)).select("k", "value", "t").join(long, "k")

    short = terms.filter(F.col("n") <= most)
    left = key(short, _deletions(most)).select("k", F.col("t").alias("other"), "term", "place")
    pairs = pairs.unionByName(key(asked.filter(F.col("n") <= 2 * most), _deletions(most)).select("k", "value", "t").join(left, "k").withColumn("k", F.lit(None).cast("struct<n:int,i:int,part:string>")))

    # without a letter in common the distance is the longer length: of each length the first term will do
    first = short.groupBy("n").agg(F.min(F.struct("place", "term", "t")).alias("f")).groupBy(F.lit(0).alias("one")).agg(F.collect_list("f").alias("fs"))  # most + 1 rows at the most
    plain = asked.filter(F.col("n") <= most).withColumn("one", F.lit(0)).join(F.broadcast(first), "one").select("value", "t", F.explode("fs").alias("f"))
    plain = plain.select("value", "t", F.col("f.t").alias("other"), "f.term", "f.place")

    near = pairs.select("value", "t", "other", "term", "place").unionByName(plain).withColumn("distance", F.levenshtein("t", "other", most)).filter("distance >= 0")
    best = near.groupBy("value").agg(F.min(F.struct("distance", "place", "term")).alias("b")).select(F.col("value").alias("_value"), F.col("b.term").alias("closest"), F.col("b.distance").alias("distance"))
    return asked.join(best, F.col("value") == F.col("_value"), "left").select("value", "closest", "distance")
