"""Exact Jaccard join of documents by their word n-grams: a blocked sparse matrix product.

Documents are rows, n-grams (by their 64-bit hashes) columns of a 0/1 matrix;
the product of the matrix with its transpose holds the overlap of every pair.
Equal rows collapse first. Size-derived bounds say which rows and columns
matter: a row of ``n`` n-grams has a partner only if all but ``n - ceil(t n)``
of them stand in some other row. That is tested in two steps, over the columns
of a share of the hash range first (what a row lacks there can't exceed what it
may lack in all), then over all columns of the rows that are left. These rows,
few in a corpus, are joined by the rarest columns: two partners have one in
common among the first ``n - ceil(t n) + 1`` by rising frequency, so rows fall
into clusters that no link leaves. A cluster is cut into blocks of bounded
size; the product of two blocks accumulates overlap counts tile by tile and
drops a strip of pairs once what is left of their n-grams can't reach the
bound. No pair becomes a row but the links of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_lookup, partitions, staged
from .components import forest, roots
from .words import shingle_hashes

#: Rows and n-grams of a block, on average; two blocks are multiplied in one task.
ROWS, ENTRIES = 1024, 1 << 20
#: Rows of a cluster that are compared with all of it before anything else.
PIVOTS = 16


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, owner, _ = shingle_hashes(texts, shingle)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    return [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _sets_of(pdf: pd.DataFrame, shingle: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for at in range(0, len(pdf), 256):
        out += shingle_sets([t.encode() for t in pdf["text"].iloc[at : at + 256]], shingle)
    return out


def _name(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes(), 42)


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def at_least(n, percent: int):
    """The least overlap of a set of ``n`` with a partner: ``ceil(percent n / 100)``."""
    return -(-percent * n // 100)


def near_pairs(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None, tile: int = 2048, strip: int = 256, few: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``sets`` with ``100 overlap >= percent union``, of which one at least is in ``left`` (all, if None).

    Rows stand by size, so the partners of a strip of rows are a range.
    Columns of few rows add to the pairs that hold them, the others are
    multiplied as tiles of 0/1 matrices.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), n)
    _, column, held = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    common = np.bincount(of[held[column] > 1], minlength=len(sets))
    rows = np.flatnonzero((common >= at_least(n, percent)) & (n > 0))
    rows = rows[np.argsort(n[rows], kind="stable")]
    m = len(rows)
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.full(len(sets), -1)
    place[rows] = np.arange(m)
    some = place[of] >= 0
    of, column = place[of[some]], column[some]
    held = np.bincount(column, minlength=len(held))
    some = held[column] > 1
    of, column = of[some], column[some]
    order = np.lexsort((of, column, held[column]))
    of, column = of[order], column[order]
    size = n[rows]
    need = lambda i, j: -(-percent * (size[i] + size[j]) // (100 + percent))
    upto = np.searchsorted(size, size * 100 // percent, side="right")
    shared = np.zeros((m, m), np.float32)  # counts below 2**24 are exact
    flat = shared.reshape(-1)
    count = held[column]
    for c in range(2, few + 1):  # columns of c rows each: c entries in a row
        i, j = np.searchsorted(count, (c, c + 1))
        holders = of[i:j].reshape(-1, c)
        for a in range(c):
            for b in range(a + 1, c):
                np.add.at(flat, holders[:, a] * m + holders[:, b], np.float32(1))
    at = int(np.searchsorted(count, few + 1))
    of, column = of[at:], column[at:]
    number = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    rest = np.bincount(of, minlength=m)
    strips = [(s, min(m, s + strip), int(upto[min(m, s + strip) - 1])) for s in range(0, m, strip)]
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, tile):
        i, j = np.searchsorted(number, (low, low + tile))
        has = np.zeros((m, min(tile, int(number[-1]) + 1 - low)), np.float32)
        has[of[i:j], number[i:j] - low] = 1
        rest = rest - np.bincount(of[i:j], minlength=m)
        going = []
        for s, e, u in strips:
            shared[s:e, s:u] += has[s:e] @ has[s:u].T
            most = shared[s:e, s:u] + np.minimum(rest[s:e, None], rest[None, s:u])
            if (most >= need(np.arange(s, e)[:, None], np.arange(s, u)[None, :])).any():
                going.append((s, e, u))
        strips = going
    x, y = [], []
    for s in range(0, m, strip):
        e, u = min(m, s + strip), int(upto[min(m, s + strip) - 1])
        i, j = np.nonzero(shared[s:e, s:u] >= need(np.arange(s, e)[:, None], np.arange(s, u)[None, :]))
        x.append(i + s)
        y.append(j + s)
    x, y = np.concatenate(x), np.concatenate(y)
    after = y > x
    x, y = rows[x[after]], rows[y[after]]
    if left is not None:
        some = left[x] | left[y]
        x, y = x[some], y[some]
    return x, y


def _forests(keys: list[str], percent: int):
    """Of rows sorted by ``keys``: a forest of the links of each cell; of rows with a ``role`` only those with one in it."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(x).view(np.uint64) for x in pdf["own"]]
        x, y = near_pairs(sets, percent, pdf["role"].to_numpy() if "role" in pdf else None)
        joined = roots(len(sets), x, y)
        child = np.flatnonzero(joined != np.arange(len(sets)))
        key = pdf["key"].to_numpy()
        differ = key[child] != key[joined[child]]
        return pd.DataFrame({"a": key[child][differ], "b": key[joined[child]][differ]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            at = pdf[keys].to_numpy()
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            if held and len(pdf) and (held[-1][keys].to_numpy()[-1] != at[0]).any():
                edges = np.concatenate([[0], edges])
            edges = edges.tolist()
            if not edges:
                held.append(pdf)
                continue
            yield links(pd.concat([*held, pdf.iloc[: edges[0]]], ignore_index=True))
            for i, j in zip(edges, edges[1:], strict=False):
                yield links(pdf.iloc[i:j])
            held = [pdf.iloc[edges[-1] :]]
        if held:
            yield links(pd.concat(held, ignore_index=True))

    return run


def cluster_links(rows: DataFrame, percent: int, label: str) -> DataFrame:
    """``a, b``: links of keys that connect all sets of a cluster with ``100 overlap >= percent union``.

    ``rows`` are ``cluster long, key binary, own array<long>``, staged, one
    row a key. A cluster of more than a block is cut by a hash of the key,
    and a few of its rows, the pivots, go to each of its blocks; then only
    the rows outside the largest component so far go to all blocks again.
    """
    spark = rows.sparkSession
    blocks = lambda m, e: F.greatest(F.ceil(m / ROWS), F.ceil(e / ENTRIES)).cast("int")
    sized = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("own").cast("long")).alias("e")).filter("m > 1")
    sized = staged(sized.select("cluster", "m", blocks(F.col("m"), F.col("e")).alias("blocks"), F.col("m").alias("of")), f"{label}-clusters")
    spread = lambda df, by: df.repartition(partitions(spark), *by).sortWithinPartitions(*by, "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("key", F.lit(1)), F.greatest(F.lit(1), F.expr(f"of div {PIVOTS}"))) == 0
    dealt = join_lookup(rows, sized, "cluster", "m", ["key"])
    dealt = dealt.withColumn("block", F.explode(F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block))))
    cells = spread(dealt.select("cluster", "block", "key", "own"), ["cluster", "block"])
    links = staged(bounded_batches(cells).mapInPandas(_forests(["cluster", "block"], percent), "a binary, b binary"), f"{label}-links")
    large = sized.filter("blocks > 1")
    if large.isEmpty():
        return links

    found = forest(links)
    mine = join_lookup(rows.select("cluster", "key", F.size("own").cast("long").alias("n")), large, "cluster", "m", ["key"])
    mine = mine.join(found, F.col("key") == F.col("node"), "left").select("cluster", "key", "n", "blocks", F.coalesce("root", "key").alias("root"))
    mine = staged(mine, f"{label}-large")
    main = mine.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("m"))
    outside = staged(join_lookup(mine, staged(main, f"{label}-main"), "cluster", "m", ["key"]).filter("root <> main").select("cluster", "key", "n", "blocks"), f"{label}-outside")
    left = outside.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"), F.first("blocks").alias("blocks"))
    left = staged(left.select("cluster", "m", "blocks", blocks(F.col("m"), F.col("e")).alias("strips")), f"{label}-left")
    if left.isEmpty():
        return links
    strip = F.pmod(F.xxhash64("key"), F.col("strips")).cast("int")
    every = join_lookup(rows, left, "cluster", "m", ["key"])
    first = every.join(outside.select("key"), "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", strip.alias("strip"), "block", "key", F.lit(True).alias("role"), "own")
    second = every.withColumn("block", block).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1))).select("cluster", "strip", "block", "key", F.lit(False).alias("role"), "own")
    by = ["cluster", "strip", "block"]
    more = bounded_batches(spread(first.unionByName(second), by)).mapInPandas(_forests(by, percent), "a binary, b binary")
    return links.unionByName(staged(more, f"{label}-more"))


def _candidates(docs: DataFrame, percent: int, shingle: int, share: float) -> DataFrame:
    """``sid`` of the sets of which enough n-grams in the first ``share`` of the hash range stand in another set, too; some more may pass."""
    limit = np.uint64(min(2**64 - 1, int(share * 2**64)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = {_short(_name(s)): s for s in _sets_of(pdf, shingle) if len(s)}
            if not sets:
                continue
            sid = np.fromiter(sets, np.int64, len(sets))
            n = np.fromiter(map(len, sets.values()), np.int64, len(sets))
            low = [s[: np.searchsorted(s, limit)] for s in sets.values()]
            some = np.fromiter(map(len, low), np.int64, len(sets))
            need = np.maximum(0, some - (n - at_least(n, percent)))
            # what two sets of a batch hold is shared: two of them say so, the others count it here
            of, column = np.repeat(np.arange(len(sets)), some), np.concatenate(low)
            order = np.argsort(column, kind="stable")
            of, column = of[order], column[order]
            new = np.ones(len(column) + 1, bool)
            new[1:-1] = column[1:] != column[:-1]
            sent = new[:-1] | new[1:]
            counted = np.bincount(of[~sent], minlength=len(sets))
            yield pd.DataFrame({"at": column[sent].view(np.int64), "sid": sid[of[sent]], "n": 0})
            yield pd.DataFrame({"at": sid, "sid": sid, "n": (-1 - need).astype(np.int32)})
            yield pd.DataFrame({"at": sid, "sid": sid, "n": counted.astype(np.int32)})[counted > 0]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by ``at, sid``: the last column's rows may go on in the next batch, of it two rows say all."""
        at0, sid0, told0 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for pdf in batches:
            done = pdf[pdf["n"] != 0]
            if len(done):
                yield pd.DataFrame({"sid": done["sid"], "shared": done["n"].clip(lower=0), "need": -1 - done["n"].clip(upper=-1)})
            pdf = pdf[pdf["n"] == 0]
            if not len(pdf):
                continue
            at, sid = np.concatenate([at0, pdf["at"].to_numpy()]), np.concatenate([sid0, pdf["sid"].to_numpy()])
            told = np.concatenate([told0, np.zeros(len(pdf), bool)])
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (sid[1:] != sid[:-1])
            at, sid, told = at[new], sid[new], told[new]
            edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            many = np.repeat(np.diff(edges, append=len(at)) > 1, np.diff(edges, append=len(at)))
            found, times = np.unique(sid[many & ~told], return_counts=True)
            yield pd.DataFrame({"sid": found, "shared": times, "need": 0})
            at0, sid0, told0 = at[edges[-1] :][-2:], sid[edges[-1] :][-2:], many[edges[-1] :][-2:]

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    sent = bounded_batches(docs.select(text)).mapInPandas(send, "at long, sid long, n int")
    met = sent.repartition(partitions(docs.sparkSession), "at").sortWithinPartitions("at", "sid").mapInPandas(count, "sid long, shared long, need long")
    return met.groupBy("sid").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter("shared >= need").select("sid")


def similar_sets(docs: DataFrame, percent: int = 80, shingle: int = 5, share: float = 0.4, label: str = "ngrams", row: Column | None = None, mark: Callable[[bytes], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, ``doc_id, row, n, key, mark, salt``, and links ``a, b`` of keys that connect all sets that reach ``percent``; both staged.

    ``row`` is a binary column of ``docs``, null if not given; ``salt``
    differs from row to row; ``mark`` is that function of the text, null if
    not given.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = _sets_of(pdf, shingle)
            keys = list(map(_name, sets))
            marks = pd.array([None] * len(pdf) if mark is None else [mark(t.encode()) for t in pdf["text"]], "Int64")
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "said": pdf["said"], "n": list(map(len, sets)), "key": keys, "sid": list(map(_short, keys)), "mark": marks})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "sid": pdf["sid"], "own": [s.view(np.int64) for s in _sets_of(pdf, shingle)]})

    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.unhex(F.sha2(text, 256)).alias("said")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = bounded_batches(docs.select(doc_id, (F.lit(None).cast("binary") if row is None else row).alias("row"), said, text.alias("text")))
    rows = rows.mapInPandas(sign, "doc_id long, row binary, said binary, n long, key binary, sid long, mark long").withColumn("salt", F.monotonically_increasing_id())
    rows = staged(rows, f"{label}-rows")

    # the sets that may have a partner, read from one row each; a join by text and id, so that the copies of a text are dealt to many tasks
    maybe = staged(_candidates(docs, percent, shingle, share), f"{label}-maybe")
    wanted = rows.filter("n > 0").join(maybe, "sid", "left_semi").groupBy("key").agg(F.min(F.struct("said", "doc_id")).alias("one"), F.first("sid").alias("sid"))
    wanted = staged(wanted.select("key", "sid", F.col("one.said").alias("_said"), F.col("one.doc_id").alias("_id")), f"{label}-wanted")
    texts = docs.select(doc_id, said, text.alias("text")).join(wanted, (F.col("said") == F.col("_said")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = texts.dropDuplicates(["said"]).select("key", "sid", "text")
    sets = staged(bounded_batches(texts).mapInPandas(read, "key binary, sid long, own array<long>"), f"{label}-sets")

    # columns of two sets or more; rows with enough of them; the rarest columns of these rows
    entries = sets.select("sid", F.size("own").cast("long").alias("n"), F.explode("own").alias("at"))
    columns = staged(entries.groupBy("at").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").withColumn("rare", F.col("df")), f"{label}-columns")
    own = join_lookup(entries, columns, "at", "df", ["sid"]).groupBy("sid").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rare", "at"))).alias("xs"))
    need = F.expr(f"(n * {percent} + 99) div 100")
    own = own.filter(F.size("xs") >= need)  # no longer than the document
    take = (F.col("n") - need + 1 - (F.col("n") - F.size("xs"))).cast("int")
    prefix = staged(own.select("sid", F.explode(F.slice("xs", F.lit(1), take)).alias("x")).select("sid", "x.at"), f"{label}-prefix")
    heads = staged(prefix.groupBy("at").agg(F.min("sid").alias("head"), F.count(F.lit(1)).alias("m")).filter("m > 1"), f"{label}-heads")
    edges = join_lookup(prefix, heads, "at", "m", ["sid"]).filter("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b")).distinct()
    edges = staged(edges, f"{label}-edges")
    tops = edges.select(F.col("b").alias("node")).distinct()
    found = forest(edges)
    cluster = found.unionByName(tops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
    clusters = staged(sets.join(cluster, F.col("sid") == F.col("node")).select(F.col("root").alias("cluster"), "key", "own"), f"{label}-clustered")
    return rows.select("doc_id", "row", "n", "key", "mark", "salt"), cluster_links(clusters, percent, label)


def jaccard_components(docs: DataFrame, percent: int = 80, shingle: int = 5, share: float = 0.4) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A text is the set of its distinct runs of ``shingle`` words (A-Z
    lower-cased, words end at ASCII white space), or of all its words if they
    are fewer. Texts link where ``100 overlap >= percent union``; the
    component is the smallest id reachable. Texts without words, and null
    ones, have an empty set and link with nothing, not even each other.
    Repeated rows are rows of their own, a null id stays null and names no
    component unless all of its component are null; other columns are
    ignored. ``docs`` has ``doc_id, text``; without rows there are none.

    Exact up to collisions of 64-bit shingle hashes and 128-bit digests of
    sets. ``share`` of the hash range is looked at first: it changes cost, no
    result. Long texts are read whole; a passage of many documents costs a
    row a batch of texts, copies collapse before anything is compared.
    """
    rows, links = similar_sets(docs, percent, shingle, share)
    full = rows.filter("n > 0")
    sets = full.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m"))
    sets = sets.join(forest(links), F.col("key") == F.col("node"), "left").select("key", "least", "m", F.coalesce("root", "key").alias("root"))
    sets = staged(sets, "ngrams-roots")
    ids = staged(sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k")), "ngrams-ids")
    named = staged(join_lookup(sets.select("key", "m", "root"), ids, "root", "k", ["key"]).select("key", "m", "component_id"), "ngrams-named")
    out = join_lookup(full, named, "key", "m", ["salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
