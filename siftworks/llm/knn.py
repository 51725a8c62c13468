"""Exact top-k search by inner product: a Voronoi kNN join.

Pivots, a sample of the data that grows with the square root of its rows,
partition queries and data into cells. Per cell a summary holds the count and
the largest distance to the pivot. From the summaries every group of queries
gets a lower bound of its k-th best score (cells in order of their least
possible score, until they hold rows of k ids other than the query's) and an
upper bound of its score in each data cell; only cells that may reach the lower bound are sent the group.
Cells are cut into blocks of bounded size, groups into chunks; which chunk
meets which block is a table, joined on keys of bounded size. Each such pair
is solved by one matrix product, and the k best of all are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged


def quantized(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_list()).reshape(len(column), dim) if len(column) else np.zeros((0, dim), np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, block: int = 8192, chunk: int = 4096) -> DataFrame:
    """The ``k`` highest inner products of each query: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id long, vector array<long>``, none null. A query
    is an id and a vector: repeated rows of both are one query, one id with
    two vectors is two, each with ranks of its own. A query is never its own
    answer (rows with its id are not candidates), ties go to the smaller id,
    repeated data rows count each. Exact for all components up to 2**20;
    larger ones wrap as 64-bit integers do. Vectors meet only those of their
    own length, lengths are solved one by one; empty ones score 0. Only
    pivots and their summaries, by default as many as the square root of the
    rows, pass the driver.
    """
    data = staged(vectors.select("vec_id", "vector", F.size("vector").alias("dim")), "knn-data")
    asked = staged(queries.select("vec_id", "vector", F.size("vector").alias("dim")).distinct(), "knn-queries")
    dims = [r["dim"] for r in asked.select("dim").distinct().collect()]
    out = None
    for dim in dims:
        part = _one_length(data.filter(F.col("dim") == dim), asked.filter(F.col("dim") == dim), dim, k, pivots, block, chunk)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = W.partitionBy("query_id", "asked").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_length(data: DataFrame, asked: DataFrame, dim: int, k: int, pivots: int | None, block: int, chunk: int) -> DataFrame:
    spark = data.sparkSession
    many = pivots or max(16, math.isqrt(data.count()))
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).select("vector").toPandas()
    centres = np.unique(_matrix(sample["vector"], dim), axis=0).astype(np.float64)
    squares = (centres**2).sum(axis=1)

    def cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row and the distance to it, rounded up."""
        best = np.concatenate([(squares - 2 * (rows[at : at + 512] @ centres.T)).argmin(axis=1) for at in range(0, len(rows), 512)] or [np.zeros(0, np.int64)])
        return best, np.sqrt(((rows - centres[best]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, far = cells(_matrix(pdf["vector"], dim).astype(np.float64)) if len(pdf) else (np.zeros(0, np.int64), np.zeros(0))
            packed = [np.asarray(v, "<i8").tobytes() for v in pdf["vector"]]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "cell": cell.astype(np.int32), "far": far, "vector": packed})

    schema = "vec_id long, cell int, far double, vector binary"
    rows = staged(data.select("vec_id", "vector").mapInPandas(assign, schema), "knn-cells")
    wanted = staged(asked.select("vec_id", "vector").mapInPandas(assign, schema), "knn-groups")
    summary = lambda df: df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).toPandas().sort_values("cell")
    s, q = summary(rows), summary(wanted)
    # every id counts once, in the first of its cells: of k + 1 counted ids one may be the query's own, the others' rows are candidates
    named = rows.groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("ids")).toPandas()
    s = s.merge(named, "left", "cell").fillna({"ids": 0})

    # chunks of query groups: small groups share one, large ones have several; of each group its first chunk and their number
    homes: list[tuple[int, float, int, int]] = []
    number, held = 0, 0
    for c, n, far in zip(q["cell"].tolist(), q["n"].tolist(), q["far"].tolist(), strict=True):
        parts = -(-n // chunk)
        if held and (parts > 1 or held + n > chunk):
            number, held = number + 1, 0
        homes.append((c, far, number, parts))
        number, held = (number + parts, 0) if parts > 1 else (number, held + n)
    homes = spark.createDataFrame(homes, "home int, far double, first int, parts int")
    places, radii, counts, ids_of = s["cell"].to_numpy(), s["far"].to_numpy(), s["n"].to_numpy(), s["ids"].to_numpy()
    at = centres[places]
    lengths = np.linalg.norm(at, axis=1)

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The data cells that may hold an answer to each query group."""
        for pdf in batches:
            for home, far, first, parts in pdf[["home", "far", "first", "parts"]].itertuples(index=False):
                g = centres[home]
                middle = at @ g
                spread = np.linalg.norm(g) * radii + far * lengths + far * radii + 1e-6 * (1 + np.abs(middle))
                order = np.argsort(spread - middle)
                place = int(np.searchsorted(np.cumsum(ids_of[order]), k + 1))
                bound = (middle - spread)[order][place] if place < len(order) else -np.inf
                cell = places[middle + spread >= bound]
                yield pd.DataFrame({"first": np.full(len(cell), first, np.int32), "parts": np.int32(parts), "cell": cell.astype(np.int32)})

    blocks = spark.createDataFrame([(int(c), max(1, -(-int(n) // block))) for c, n in zip(places, counts, strict=True)], "cell int, blocks int")
    pairs = homes.repartition("home").mapInPandas(need, "first int, parts int, cell int").distinct().join(blocks, "cell")
    pairs = pairs.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("chunk"), "blocks").distinct()
    pairs = staged(pairs.select("chunk", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "knn-pairs")

    # both tables of cells have a row a pivot: they may be broadcast whatever the data
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    sent = rows.join(F.broadcast(blocks), "cell").withColumn("block", part("blocks")).join(pairs, ["cell", "block"]).select("chunk", "cell", "block", "vec_id", "vector")
    asking = wanted.join(F.broadcast(homes.select("home", "first", "parts")), F.col("cell") == F.col("home")).select((F.col("first") + part("parts")).alias("chunk"), "vec_id", "vector")
    asking = asking.join(pairs, "chunk").select("chunk", "cell", "block", "vec_id", "vector")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "asked": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        ids = right["vec_id"].to_numpy()
        name = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in left["vector"]), np.uint64, len(left)).view(np.int64)
        a = np.frombuffer(b"".join(left["vector"]), "<i8").reshape(len(left), dim)
        b = np.frombuffer(b"".join(right["vector"]), "<i8").reshape(len(right), dim)
        small = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= 1 << 20 and dim <= 4096
        out = []
        for at in range(0, len(a), 256):
            own = left["vec_id"].to_numpy()[at : at + 256]
            score = (a[at : at + 256].astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if small else a[at : at + 256] @ b.T
            valid = ids[None, :] != own[:, None]
            # stable order by score: ties keep the order of ids
            m = min(k + 1, len(ids))
            floor = np.partition(np.where(valid, score, np.iinfo(np.int64).min), len(ids) - m, axis=1)[:, len(ids) - m]
            x, y = np.nonzero(valid & (score >= floor[:, None]))
            order = np.lexsort((y, -score[x, y], x))
            x, y = x[order], y[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            best = place < k
            out.append(pd.DataFrame({"query_id": own[x[best]], "asked": name[at : at + 256][x[best]], "vec_id": ids[y[best]], "score": score[x[best], y[best]]}))
        return pd.concat(out)

    keys = ["chunk", "cell", "block"]
    return asking.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(solve, "query_id long, asked long, vec_id long, score long")


def search_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, **options) -> DataFrame:
    """The ``k`` best neighbours of the rows whose ``vec_id`` is divisible by ``every``, among all rows.

    Rows whose vector is null or holds null or non-finite components, and
    rows with a null id, take no part. Empty vectors score 0 among each other.
    """
    rows = embeddings.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("vector"))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k, **options)
