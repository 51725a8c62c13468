"""SimHash near-duplicates with pivot distance tables; near-duplicates by exact Jaccard similarity.

Equal fingerprints collapse first. Two fingerprints that differ in at most
``radius`` bits agree in some set of blocks of bits; rows with an equal such
set meet in one bucket. A bucket's table holds the Hamming distances of its
fingerprints to many reference fingerprints. By the triangle inequality a
pair within the radius differs by no more than it in any coordinate: rows
stand by the first coordinate, only a strip of that width is looked at, the
other coordinates discard most of what is left, and the survivors are
verified bit by bit. Of a bucket only a spanning forest of its links is
emitted, so a group of thousands makes as many rows, not their square. Large
buckets are cut into strips of the first coordinates.

Similar texts (``similar_components``) are another matter: fingerprints three
bits apart don't tell a similarity of 0.8, so their links are those of the
exact n-gram join (``ngrams``). ``drop_near_duplicates`` takes the links of
both where it is given a radius: none of either is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import bounded_batches, join_lookup, staged, unused
from .components import forest, roots

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (of bytes) have each bit set; sums of 255 rows fit in a byte."""
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 255):
        ones += np.add.reduce(np.unpackbits(rows[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return ones


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text; 0 where it has no words."""
    words = [w for w in text.translate(_FOLD).split(b" ") if w]
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=False)), np.uint64, n)
    ones = bit_counts(hashes.astype(">u8").view(np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.fromiter((simhash(t.encode(), shingle, seed) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def pivot_links(fps: np.ndarray, pivots: np.ndarray, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links of distinct fingerprints."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    upto = np.searchsorted(table[:, 0], table[:, 0].astype(np.int64) + radius, side="right")
    spans = upto - np.arange(n) - 1
    root = np.arange(n)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(np.cumsum(spans[at:]), block, side="right")) + at)
        left = np.repeat(np.arange(at, end), spans[at:end])
        first = np.concatenate([[0], np.cumsum(spans[at:end])[:-1]])
        right = np.arange(len(left)) - np.repeat(first, spans[at:end]) + left + 1
        for k in range(1, table.shape[1]):
            near = np.abs(table[left, k] - table[right, k]) <= radius
            left, right = left[near], right[near]
            if len(left) < 4096:
                break
        near = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        if near.any():
            root = roots(n, np.concatenate([np.arange(n), left[near]]), np.concatenate([root, right[near]]))
        at = end
    child = np.flatnonzero(root != np.arange(n))
    return order[child], order[root[child]]


def near_links(distinct: DataFrame, radius: int = 3, blocks: int = 6, pivots: int = 16, large: int = 512, seed: int = 5) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fp`` within ``radius`` bits of each other.

    ``blocks`` of bits; a pair agrees in at least ``blocks - radius`` of them,
    so every choice of so many blocks is a set of buckets and no pair is
    missed. Buckets of more than ``large`` rows are cut into strips of the
    pivot coordinates, each of which also gets the rows that the next one
    may need: exact at any size.
    """
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    keep = np.array([sum(masks[i] for i in pick) for pick in combinations(range(blocks), max(1, blocks - radius))], np.uint64)
    draw = np.random.default_rng(seed)
    refs = draw.integers(0, 1 << 64, pivots, dtype=np.uint64)
    width = radius + 1

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            for i, mask in enumerate(keep):
                yield pd.DataFrame({"pick": np.full(len(fp), i, np.int32), "part": (fp & mask).view(np.int64), "fp": pdf["fp"].to_numpy()})

    def strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of a large bucket goes to its own strip of each of two coordinates and to the one below."""
        for pdf in batches:
            fp = pdf["fp"].to_numpy().view(np.uint64)
            cells = [np.bitwise_count(fp ^ refs[i]).astype(np.int64) // width for i in (0, 1)]
            for dx in (0, 1):
                for dy in (0, 1):
                    cell = (cells[0] - dx + 1) * 100 + cells[1] - dy + 1
                    some = np.ones(len(fp), bool) if not (dx or dy) else pdf["big"].to_numpy()
                    yield pd.DataFrame({"pick": pdf["pick"], "part": pdf["part"], "cell": np.where(pdf["big"], cell, 0).astype(np.int32), "fp": pdf["fp"]})[some]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def bucket(fp: np.ndarray) -> pd.DataFrame:
            a, b = pivot_links(fp.view(np.uint64), refs, radius)
            return pd.DataFrame({"a": fp[a], "b": fp[b]})

        for pdf in batches:  # sorted: only the last bucket of a batch may go on in the next
            pdf = pd.concat([*held, pdf]) if held else pdf
            key = pdf[["pick", "part", "cell"]].to_numpy()
            fp = pdf["fp"].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            edges = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([edges, [len(fp)]]))
            out = [bucket(fp[a : a + n]) for a, n in zip(edges[:-1].tolist(), sizes[:-1].tolist(), strict=True) if n > 1]
            held = [pdf.iloc[edges[-1] :]]
            if out:
                yield pd.concat(out)
        if held and len(held[0]) > 1:
            yield bucket(held[0]["fp"].to_numpy())

    bucketed = distinct.select("fp").mapInPandas(spread, "pick int, part long, fp long")
    sizes = bucketed.groupBy("pick", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = bucketed.join(sizes, ["pick", "part"]).select("pick", "part", "fp", (F.col("n") > large).alias("big"))
    cut = kept.mapInPandas(strips, "pick int, part long, cell int, fp long")
    keys = ["pick", "part", "cell"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(n, *keys).sortWithinPartitions(*keys, "fp").mapInPandas(solve, "a long, b long").distinct()


def near_components(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, **options) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    The component is the smallest id reachable over links of fingerprints
    that differ in ``radius`` bits or fewer. Null text counts as empty, texts
    without words have fingerprint 0 and link like any other; a null id stays
    null and names no component unless all of its component are null.
    Repeated rows give repeated rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs, shingle, seed).withColumn("salt", F.monotonically_increasing_id()), "simhash-prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    root = forest(near_links(distinct, radius, **options))
    known = staged(distinct.join(root, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = staged(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("fps")), "simhash-components")
    named = staged(join_lookup(known.select("fp", "n", "root"), least, "root", "fps", ["fp"]).select("fp", "n", "component_id"), "simhash-named")
    return join_lookup(prints, named, "fp", "n", ["salt"]).select("doc_id", "fp", "component_id")


def _row_digest(docs: DataFrame) -> Column:
    """A digest of id, text and the other columns: equal only for equal rows. Maps, which have no hash, count by their JSON."""
    quoted = lambda f: F.col("`" + f.name.replace("`", "``") + "`")
    plain = lambda f: F.to_json(F.struct(quoted(f).alias("x"))) if '"map"' in f.dataType.json() else quoted(f)
    rest = F.hex(F.xxhash64(F.lit(0), *(plain(f) for f in docs.schema.fields if f.name != "text")))
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), rest, F.lit(" "), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit(""))), 256))


def _signed(text: bytes) -> int:
    return int(np.uint64(simhash(text)).view(np.int64))


def _print_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` of the ``key`` of ``rows`` that connect all whose fingerprints, ``mark``, differ in ``radius`` bits or fewer."""
    named = staged(rows.groupBy(F.col("mark").alias("fp"), "key").agg(F.count(F.lit(1)).alias("m")), "similar-prints")
    distinct = staged(named.groupBy("fp").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("keys")), "similar-heads")
    same = join_lookup(named.select("fp", "key"), distinct, "fp", "keys", ["key"]).filter("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    head = lambda end: distinct.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = near_links(distinct, radius).join(head("a"), "a").join(head("b"), "b").filter("a_head <> b_head")
    return staged(same.unionByName(near.select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))), "similar-print-links")


def _similar_roots(docs: DataFrame, percent: int, shingle: int, radius: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, ``doc_id, row, key, salt`` (digests of row and set), and of each set ``key, m, best, root``.

    ``m`` rows have the set, ``best`` is the first of them by id and digest.
    With a ``radius``, fingerprints link too.
    """
    rows, links = ngrams.similar_sets(docs, percent, shingle, label="similar", row=_row_digest(docs), mark=None if radius is None else _signed)
    if radius is not None:
        links = links.unionByName(_print_links(rows, radius))
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = rows.groupBy("key").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("m"))
    sets = sets.join(forest(links), F.col("key") == F.col("node"), "left").select("key", "m", "best", F.coalesce("root", "key").alias("root"))
    return rows, staged(sets, "similar-roots")


def similar_components(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """``doc_id, component_id`` over links of texts with ``100 overlap >= percent union``.

    Texts are sets of ``shingle``-word shingles; equal sets, so all texts
    without words, are one. Fingerprints can't tell a similarity of 0.8, so
    the links are those of the exact n-gram join. Nulls and repeated rows as
    for ``near_components``.
    """
    rows, sets = _similar_roots(docs, percent, shingle)
    ids = staged(sets.groupBy("root").agg(F.min("best.doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets")), "similar-ids")
    named = staged(join_lookup(sets.select("key", "m", "root"), ids, "root", "sets", ["key"]).select("key", "m", "component_id"), "similar-named")
    return join_lookup(rows, named, "key", "m", ["salt"]).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, radius: int | None = None) -> DataFrame:
    """One row of ``docs`` for each component of similar texts: that of its smallest id.

    With a ``radius``, texts whose fingerprints differ in so many bits or
    fewer are linked as well, whatever share of shingles they have in common.

    Nulls come last among the ids; rows of one id go by their digest, which
    covers text and all other columns, so the choice is the same in every
    run. Other rows of that id stay or go with their own component.
    """
    _, sets = _similar_roots(docs, percent, shingle, radius)
    (row,) = unused(docs, "_row")
    kept = sets.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return docs.withColumn(row, _row_digest(docs)).join(kept, row, "left_semi").dropDuplicates([row]).select(*(f"`{c}`" for c in docs.columns))
