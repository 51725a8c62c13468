"""All aliases that are similar to a name, in a registry of any size.

Similarity is ``text.dice``: the letter pairs two texts share, repeats
counted, over the mean number of pairs. The n-th occurrence of a pair is a
token of its own, so texts are sets, and of two that are similar enough a
known number of tokens is shared. With the tokens of each text sorted by how
many aliases have them, rarest first, two such texts share one among the first
few (prefix filter), not too far back (position filter), and their numbers of
tokens aren't too different (length filter). Only pairs that pass all three
are compared. Common pairs of letters stand behind rare ones, so the tokens
that are joined are those few aliases have; where one is still hot, adaptive
execution splits its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

_SLACK = 1e-9  # far below the step of a threshold times a number of tokens, far above rounding


def _tokens(value: Column) -> Column:
    grams = text.bigrams(value)
    return F.transform(grams, lambda g, i: F.struct(g.alias("g"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).alias("nth")))


def _needed(threshold: float, tokens: Column, others: Column) -> Column:
    """Tokens that texts of so many must share."""
    return F.ceil((tokens + others) * threshold / 2 - _SLACK)


def _prefixes(tokens: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """``token, place, t, n``: the first tokens of each text ``t``, by rarity, among which a similar text has one."""
    ranked = tokens.join(counts, "token", "left").groupBy("t", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("aliases", F.lit(0)).alias("aliases"), "token"))).alias("ts"))
    n = F.col("n")
    least = F.ceil(n * threshold / (2 - threshold) - _SLACK)  # no similar text has fewer tokens
    kept = F.slice("ts", F.lit(1), (n - _needed(threshold, n, least) + 1).cast("int"))
    return ranked.select("t", "n", F.posexplode(kept).alias("place", "e")).select("e.token", "place", "t", "n")


def similar_names(names: DataFrame, aliases: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``name, alias, score`` of every pair of different ``name`` and ``alias`` values with a score of ``threshold`` or more.

    The result is that of all pairs compared. Nulls are similar to nothing;
    texts of less than two characters only to themselves.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    left = names.select(F.col("name").alias("t")).filter("t is not null").distinct()
    right = aliases.select(F.col("alias").alias("t")).filter("t is not null").distinct()
    spread = lambda df: df.filter(F.length("t") > 1).select("t", F.explode(_tokens(F.col("t"))).alias("token"), (F.length("t") - 1).alias("n"))
    mine, theirs = spread(left), spread(right)
    counts = theirs.groupBy("token").agg(F.count(F.lit(1)).alias("aliases"))
    a = _prefixes(mine, counts, threshold).toDF("token", "i", "name", "n")
    b = _prefixes(theirs, counts, threshold).toDF("token", "j", "alias", "m")
    n, m = F.col("n"), F.col("m")
    lengths = (m >= n * threshold / (2 - threshold) - _SLACK) & (n >= m * threshold / (2 - threshold) - _SLACK)
    reach = F.least(n - F.col("i"), m - F.col("j")) >= _needed(threshold, n, m)  # from the first shared token on, enough are left
    pairs = a.join(b, "token").filter(lengths & reach).select("name", "alias").distinct()
    scored = pairs.withColumn("score", text.dice(F.col("name"), F.col("alias"))).filter(F.col("score") >= threshold)
    short = left.filter(F.length("t") < 2).join(right, "t").select(F.col("t").alias("name"), F.col("t").alias("alias"), F.lit(1.0).alias("score"))
    return scored.unionByName(short)
