"""Document fingerprints: one-permutation MinHash with optimal densification.

Every shingle is hashed once; the high bits say its bin, the rest compete for
the bin's minimum. An empty bin borrows from the first full bin in a fixed
random order of its own (2-universal draws without repetition), so estimates
stay unbiased for short texts. Of each bin only the low bits are stored, and
the likeness of two fingerprints is corrected for bits that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions
from .words import shingle_hashes


class OnePermutation:
    """Fingerprints of ``bins`` bytes: the low eight bits of every bin's minimum."""

    def __init__(self, bins: int = 256, shingle: int = 5, seed: int = 1):
        if bins < 1 or bins & (bins - 1) or bins > 4096:  # the table of orders has bins**2 entries of two bytes
            raise ValueError("bins must be a power of two up to 4096")
        self.bins, self.shingle = bins, shingle
        draw = np.random.default_rng(seed)
        self.order = np.argsort(draw.random((bins, bins)), axis=1).argsort(axis=1).astype(np.uint16)

    def signatures(self, texts: list[bytes]) -> list[bytes]:
        """One signature a text; fewer words than a shingle count as one shingle, none as no signature."""
        h, owner, counts = shingle_hashes(texts, self.shingle)
        n = len(texts)
        shift = np.uint64(64 - self.bins.bit_length() + 1)
        cell = owner * self.bins + (h >> shift).astype(np.int64)
        least = np.full(n * self.bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, cell, h & ((np.uint64(1) << shift) - np.uint64(1)))
        least = least.reshape(n, self.bins)
        full = least != np.iinfo(np.uint64).max
        low = (least & np.uint64(255)).astype(np.uint8)
        out = []
        for i in range(n):
            if not counts[i]:
                out.append(b"")
                continue
            mine = np.flatnonzero(full[i])
            if len(mine) < self.bins:
                gaps = np.flatnonzero(~full[i])
                lender = mine[self.order[np.ix_(gaps, mine)].argmin(axis=1)]
                low[i, gaps] = low[i, lender]
            out.append(low[i].tobytes())
        return out

    @staticmethod
    def likeness(a: bytes, b: bytes) -> float:
        """Estimated Jaccard similarity; two texts without words are alike, one with and one without are not."""
        if not a or not b:
            return float(a == b)
        share = float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))
        return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def fingerprint_documents(docs: DataFrame, bins: int = 256, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (hex; empty for a text without words) for every row; no shuffle.

    Null text counts as empty; equal texts have equal fingerprints.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = OnePermutation(bins, shingle)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"], "fingerprint": [s.hex() for s in maker.signatures([t.encode() for t in part["text"]])]})

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, fingerprint string")


_NONE = -(1 << 63)


def _sortable(down: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16 bytes each that sort like them."""
    both = np.stack([down, h], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def compare_with_edits(docs: DataFrame, bins: int = 256, shingle: int = 5, per_range: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edits, and the likenesses the contract asks for.

    The order is by descending id, null last, of one id by a hash of the
    text. Texts are dealt once into ranges of this order, so an id of very
    many rows goes to many tasks; the head of each range also goes to the
    range before it, so every document meets its successor in its own task.
    Of the rows only range bounds pass the driver, from ``per_range`` pairs
    of id and hash a partition, and one head a range. Null text counts as
    empty; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    down = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(down.alias("down"), F.xxhash64(text).alias("h"), text.alias("text"))
    n, keys = partitions(spark), rows.select("down", "h")
    spread, wanted, total = 1 << 30, per_range * partitions(spark), docs.count()
    below = spread if total <= 2 * wanted else int(spread * min(1.0, (1.2 * wanted + 50) / total))
    drawn = keys.filter(F.pmod(F.xxhash64("down", "h"), F.lit(spread)) < below).distinct().limit(2 * wanted + 100).toPandas()
    drawn = np.sort(_sortable(drawn["down"].to_numpy(np.int64), drawn["h"].to_numpy(np.int64)))
    cuts = np.unique(drawn[[len(drawn) * i // n for i in range(1, n)]]) if len(drawn) else drawn
    n = len(cuts) + 1
    bucket = lambda pdf: np.searchsorted(cuts, _sortable(pdf["down"].to_numpy(), pdf["h"].to_numpy()), side="right").astype(np.int32)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": bucket(pdf), "down": pdf["down"], "h": pdf["h"]})

    heads = keys.mapInPandas(number, "part int, down long, h long").groupBy("part").agg(F.min(F.struct("down", "h")).alias("head")).collect()
    heads = {r["part"]: (r["head"]["down"], r["head"]["h"]) for r in heads}
    used = sorted(heads)
    before = {heads[b]: used[i - 1] for i, b in enumerate(used)}  # the first head follows the last range

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        firsts: dict[tuple[int, int], bytes] = {}
        for pdf in batches:
            packed = [pack.compress(t.encode()) for t in pdf["text"]]
            yield pd.DataFrame({"part": bucket(pdf), "role": np.int32(0), "down": pdf["down"], "h": pdf["h"], "packed": packed})
            for key, text in zip(zip(pdf["down"].tolist(), pdf["h"].tolist(), strict=True), packed, strict=True):
                if key in before:
                    firsts[key] = min(text, firsts.get(key, text))
        yield pd.DataFrame([(before[k], 1, *k, text) for k, text in firsts.items()], columns=["part", "role", "down", "h", "packed"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker, unpack = OnePermutation(bins, shingle), zstandard.ZstdDecompressor()

        def answers(chunk: list[tuple[int, str]]) -> pd.DataFrame:
            texts = [t for _, t in chunk]
            edits = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:], strict=False)]
            coded = [t.encode() for t in texts]
            edited = [t.encode() for t in edits]
            a, b = maker.signatures(coded), maker.signatures(edited)
            return pd.DataFrame({
                "doc_id": pd.array([None if d == ~_NONE else ~d for d, _ in chunk[:-1]], dtype="Int64"),
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": [s.hex() for s in a[:-1]],
                "edited_fingerprint": [s.hex() for s in b],
                "near_edited": [maker.likeness(x, y) for x, y in zip(a, b, strict=False)],
                "near_next": [maker.likeness(x, y) for x, y in zip(a, a[1:], strict=False)],
            })

        after: tuple[int, str] | None = None
        chunk: list[tuple[int, str]] = []
        held = 0
        for pdf in batches:  # the head of the next range comes first, then the rows in order
            for row, role, packed in zip(pdf["down"].tolist(), pdf["role"].tolist(), pdf["packed"], strict=True):
                text = unpack.decompress(packed).decode()
                if role:
                    after = after or (row, text)
                    continue
                chunk.append((row, text))
                held += len(text)
                if len(chunk) > 1 and (len(chunk) > 256 or held > 4 << 20):
                    yield answers(chunk)
                    chunk, held = chunk[-1:], len(text)
        if chunk:
            yield answers([*chunk, after])

    dealt = rows.mapInPandas(deal, "part int, role int, down long, h long, packed binary")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions(F.col("role").desc(), "down", "h", "packed")
    return dealt.mapInPandas(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
