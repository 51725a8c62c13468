"""Chat formatting: cumulative-snapshot collapse, then rendering, natively.

A chat that is logged after every turn leaves snapshots, each a prefix of the
next. Every turn gets the rolling hash of all turns up to it: sums over
hashes of (position, role, text), so the hash of a prefix is a running sum.
A conversation whose whole hash is the hash of a proper prefix elsewhere is
anti-joined away; of equal ones the smallest id stays. What is left is
rendered turn by turn.

Running sums are made in two levels, over stretches of ``span`` turn numbers
and over the stretches of a conversation, so that a conversation of any
length is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged

_SUMS = ["_a", "_b", "_c", "_d"]
_CELL = ["_id", "_cell"]


def _rolling(turns: DataFrame, span: int) -> DataFrame:
    """``turns`` with ``position`` (from 0), ``n_turns`` of the conversation and the rolling sums ``_a.._d``.

    The turns are dealt once, by conversation and stretch; all that is said
    of a stretch comes to them by the same key.
    """
    ident = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = turns.withColumns({"_id": ident, "_cell": F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / span)}).repartition(*_CELL)
    whole = W.partitionBy("_id")
    before = whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*_CELL).orderBy("turn", "role", "text")
    sizes = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*_CELL, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("n_turns"))
    rows = rows.withColumn("_row", F.row_number().over(order)).join(sizes, _CELL).withColumn("position", F.col("_base") + F.col("_row") - 1)
    said = [F.col("position"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    one, two = F.xxhash64(*said), F.xxhash64(F.lit("second"), *said)
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    rows = rows.withColumns(dict(zip(_SUMS, [low(one), F.shiftrightunsigned(one, 32), low(two), F.shiftrightunsigned(two, 32)], strict=True)))
    totals = rows.groupBy(*_CELL).agg(*(F.sum(c).alias(c) for c in _SUMS))
    totals = totals.select(*_CELL, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c + "0") for c in _SUMS))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(upto) for c in _SUMS}).join(totals, _CELL)
    return rows.withColumns({c: F.col(c) + F.col(c + "0") for c in _SUMS}).drop("_base", "_row", *(c + "0" for c in _SUMS))


def collapse_snapshots(turns: DataFrame, span: int = 256) -> DataFrame:
    """The turns of the maximal conversations: ``conv_id, position, turn, role, text, n_turns``.

    Turns stand by number, then role and text, nulls first; a null role or
    text equals only another null; rows with a null ``conv_id`` are one
    conversation. Repeated rows are turns of their own. Other columns are
    ignored. An empty table gives an empty one. A conversation of any length
    is dealt by stretches of ``span`` turn numbers.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = staged(_rolling(rows, span), "chat-rolling")
    ends = rows.filter(F.col("position") + 1 == F.col("n_turns"))
    wholes = ends.groupBy("n_turns", *_SUMS).agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "_id"))["_id"].alias("_id"))
    prefixes = rows.filter(F.col("position") + 1 < F.col("n_turns")).select((F.col("position") + 1).alias("n_turns"), *_SUMS).distinct()
    kept = wholes.join(prefixes, ["n_turns", *_SUMS], "left_anti").select("_id")
    # the stretches of the kept conversations, by which their turns are found
    cells = rows.select(*_CELL).distinct().join(kept, "_id")
    return rows.join(cells, _CELL).select("conv_id", "position", "turn", "role", "text", "n_turns")


def render(turns: DataFrame, template: str = "<|%s|>\n%s\n", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each turn as a training segment: ``segment`` and whether it is ``learned``.

    Segments of a conversation, joined by position, are its text; they stay
    rows of their own, so a conversation of any length fits. A null role
    renders as ``user``, a null text as empty.
    """
    role = F.coalesce(F.col("role"), F.lit("user"))
    return turns.withColumn("segment", F.format_string(template, role, F.coalesce(F.col("text"), F.lit("")))).withColumn("learned", role.isin(*learn))
