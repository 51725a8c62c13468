"""Mixing sources to target weights by Sainte-Lague apportionment, natively.

Targets come from weights by water-filling under the cap of ``most`` times a
source's size. The house has one seat for every ``seat`` words of the corpus;
the parties are the sources, their votes the targets, and the seats go to the
highest quotients ``votes / (2 s - 1)``. Nearly all of them are won at any
divisor that the house may end with; only those between the two bounds of the
divisor, some two a source, are listed and ranked. A source's words, its
seats times their size, are then dealt to its shards as integer quotas, by
running totals, so that the quotas sum to it exactly. In a shard documents
stand in the order of a hash; a seeded stride over blocks of equal size says
which of them fill the quota.

Orders over all sources or shards are ranges with their own running totals
and one row a range that says what lies before it: no window has a single
group that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, partitions, staged

#: Stride of the choice of blocks, a prime above any number of blocks in a shard.
STRIDE = 2147483629


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: list[str], label: str) -> DataFrame:
    """``rows`` with ``_rank`` (from 1) and, for each of ``sums``, ``_before_<name>``: its total over the rows before.

    The rows are dealt by ranges of ``order``, which must be total. Each
    range ranks its own; what lies before a range follows from one row a
    range, so that the one window over all has no more rows than partitions.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    dealt = staged(dealt, label)
    ranges = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranges = ranges.select("_range", first("_n").alias("_n0"), *(first(f"_sum_{c}").alias(f"_sum0_{c}") for c in sums))
    own = W.partitionBy("_range").orderBy(*order)
    earlier = own.rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(ranges), "_range").withColumn("_rank", F.col("_n0") + F.row_number().over(own))
    out = out.withColumns({f"_before_{c}": F.col(f"_sum0_{c}") + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})
    return out.drop("_range", "_n0", *(f"_sum0_{c}" for c in sums))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``sizes`` (``source, source_size``) with ``place, target`` and the words of the sources before.

    Sources stand by code point, null last, and take the weights in turn.
    Of the total, shares go by weight; a share above ``most`` times its
    source's size stops there and the excess is shared again.
    """
    placed = running(sizes, [F.col("source").isNull(), F.col("source")], ["source_size"], "mixing-places")
    placed = placed.withColumnsRenamed({"_rank": "place", "_before_source_size": "words_before"})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    capped = placed.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most})
    filled = running(capped, [F.col("cap") / F.col("weight"), F.col("place")], ["cap", "weight"], "mixing-fill")
    words, shares = sizes.agg(F.sum("source_size")).first()[0] or 0, capped.agg(F.sum("weight")).first()[0] or 0
    rate = (F.lit(words) - F.col("_before_cap")).cast("double") / (F.lit(shares) - F.col("_before_weight")).cast("double")
    filled = filled.withColumn("rate", rate).withColumn("free", F.col("cap").cast("double") > F.col("rate") * F.col("weight"))
    level = filled.filter("free").agg(F.min_by("rate", "_rank")).first()[0]
    target = F.when(F.col("free"), F.lit(level).cast("double") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return filled.withColumn("target", target).drop("_rank", "_before_cap", "_before_weight", "rate", "free", "weight")


def apportioned(parties: DataFrame, house: int, total: float) -> DataFrame:
    """``parties`` (``place, target``; the targets sum to ``total``) with the ``seats`` of each by highest quotients.

    With ``n`` parties the divisor lies between ``total / (house + n / 2)``
    and ``total / (house - n / 2)``. What a party has at the upper one is
    won, what it hasn't at the lower one is lost; the seats between are
    ranked by quotient, of equal ones the first party's first.
    """
    n = parties.count()
    at = lambda seats: F.floor(F.col("target") * F.lit(float(max(0, seats))) / F.lit(float(total or 1)) + 0.5)
    bounds = parties.withColumns({"won": at(house - n / 2 - 1), "upto": at(house + n / 2 + 1)})
    bounds = staged(bounds, "mixing-bounds")
    left = house - (bounds.agg(F.sum("won")).first()[0] or 0)
    open_ = bounds.filter("upto > won").select("place", "target", F.explode(F.sequence(F.col("won") + 1, F.col("upto"))).alias("s"))
    open_ = open_.select("place", "s", (F.col("target") / (2 * F.col("s") - 1).cast("double")).alias("quotient"))
    ranked = running(open_, [F.col("quotient").desc(), F.col("place"), F.col("s")], [], "mixing-seats")
    more = ranked.filter(F.col("_rank") <= left).groupBy("place").agg(F.count(F.lit(1)).alias("more"))
    return bounds.join(more, "place", "left").withColumn("seats", F.col("won") + F.coalesce("more", F.lit(0))).drop("won", "upto", "more")


def _narrow(docs: DataFrame) -> list[Column]:
    """Source, size and hash of each row; id and text make the hash, so null and repeated ids are spread, too."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col("text"), F.lit("")))
    return [F.col("source").alias("source"), word_count(F.col("text")).alias("size"), F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long").alias("hash")]


def _mixed(rows: DataFrame, narrow: DataFrame, seed: int, seat: int, block: int, shard_words: int, shard_rows: int, weights: tuple[int, ...], most: int) -> DataFrame:
    """``rows`` (``source, size, hash`` and more) with ``source_size, target, whole, extra, taken``.

    All words of a row are taken ``whole`` times, those of ``extra``
    (``first, words``) once more. ``narrow`` holds the same rows, staged.
    """
    sums = staged(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mixing-sources")
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    parties = apportioned(source_targets(sums, weights, most), (total + seat // 2) // seat, total)
    shards = F.greatest(F.lit(1), F.expr(f"(source_size + {shard_words - 1}) div {shard_words}"), F.expr(f"(n + {shard_rows - 1}) div {shard_rows}"))
    words = F.least(F.col("seats") * seat, F.col("source_size") * most)
    plan = staged(parties.select(F.col("source").alias("_source"), "place", "source_size", "target", "words_before", words.alias("words"), shards.alias("shards")), "mixing-plan")
    dealt = lambda df: df.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.col("hash") % F.col("shards"))

    sizes = dealt(narrow).groupBy("place", "shard").agg(F.sum("size").alias("held"), F.first("words_before").alias("words_before"), F.first("words").alias("words"), F.first("source_size").alias("source_size"))
    sizes = running(sizes, [F.col("place"), F.col("shard")], ["held"], "mixing-shards")
    share = lambda x: f"cast(cast({x} as decimal(19,0)) * cast(words as decimal(19,0)) div greatest(source_size, 1) as long)"
    quota = F.expr(f"{share('(_before_held - words_before + held)')} - {share('(_before_held - words_before)')}")
    quotas = sizes.select(F.col("place").alias("_place"), F.col("shard").alias("_shard"), "held", quota.alias("quota"))

    run = W.partitionBy("place", "shard").orderBy("hash", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = dealt(rows).join(quotas, (F.col("place") == F.col("_place")) & (F.col("shard") == F.col("_shard"))).drop("_place", "_shard", "words_before", "words", "shards")
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0)))
    rows = rows.withColumns({"whole": F.expr("quota div greatest(held, 1)"), "rest": F.expr("quota % greatest(held, 1)"), "blocks": F.expr(f"held div {block}")})
    rows = rows.withColumns({"full": F.expr(f"rest div {block}"), "cut": F.expr(f"rest % {block}")})
    # of block k: all words, the first few, or none
    turn = f"(k * {STRIDE} + place * 104729 + shard * 7919 + {seed}) % greatest(blocks, 1)"
    part = f"case when k < blocks then case when {turn} < full then {block} when {turn} = full then cut else 0 end when full = blocks then cut else 0 end"
    pieces = f"""
        filter(
          transform(sequence(start div {block}, (start + size - 1) div {block}),
                    k -> named_struct('first', greatest(k * {block}, start) - start,
                                      'words', greatest(0, least(k * {block} + {part}, start + size) - greatest(k * {block}, start)))),
          b -> b.words > 0)
    """
    rows = rows.withColumn("extra", F.expr(f"if(size > 0 and rest > 0, {pieces}, array())"))
    taken = F.expr("whole * size + aggregate(extra, 0L, (sum, b) -> sum + b.words)")
    return rows.withColumn("taken", taken).drop("held", "quota", "start", "rest", "blocks", "full", "cut", "place", "shard")


def _options(seed: int = 7, seat: int = 8, block: int = 64, shard_words: int = 1 << 16, shard_rows: int = 1 << 13, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> dict:
    return dict(seed=seed, seat=seat, block=block, shard_words=shard_words, shard_rows=shard_rows, weights=weights, most=most)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    ``docs`` has ``doc_id, source, text``; other columns are ignored,
    whatever their names. Null text has size 0, nulls form a source of their
    own, equal rows are separate documents, null and repeated ids are spread
    over shards by a hash of id and text. An empty table gives an empty one.
    The words are counted once, into a narrow table in the shared folder.
    Options: ``seed`` of the choice of blocks, words a ``seat`` and a
    ``block``, bounds of a shard (``shard_words, shard_rows`` on average),
    ``weights`` and ``most``, how often a word is taken at the most.
    """
    rows = staged(docs.select("doc_id", *_narrow(docs)), "mixing-sizes")
    return _mixed(rows, rows, **_options(**options)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: up to ``most`` rows a document.

    A document taken ``whole`` times has as many rows like it was, and one
    more with the words taken once more, each with the white space that
    follows it. ``n_chars``, if present, is that of the new text.
    """
    narrow = staged(docs.select(*_narrow(docs)), "mixing-sizes")
    rows = docs.select(F.struct("*").alias("doc"), *_narrow(docs))  # own columns stand apart from those of docs
    rows = _mixed(rows, narrow, **_options(**options)).filter("taken > 0").select("doc", "whole", "extra")
    # the words are cut once a document, before the generator, and only where some are left out
    words = F.when(F.size("extra") > 0, F.regexp_extract_all(F.col("doc.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("turn", F.explode(F.sequence(F.lit(1), (F.col("whole") + F.when(F.size("extra") > 0, 1).otherwise(0)).cast("int"))))
    piece = F.expr("array_join(transform(extra, b -> array_join(slice(words, cast(b.first + 1 as int), cast(b.words as int)), '')), '')")
    rows = rows.select("doc", F.when(F.col("turn") <= F.col("whole"), F.col("doc.text")).otherwise(piece).alias("text"))
    value = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(value.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))
