"""Token counts: batch encoding in Arrow functions that return lengths only.

Long texts are split at places where the byte-level pre-tokenizer always
starts a new piece: a single space or line feed between two characters that
are not white space. The pieces of a batch are made distinct, encoded once
in batches of even size, and only their lengths are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, encode_unseen, load_tokenizer, tokenizer_path

_DOUBLE = re.compile(r"\s\s|^\s|\s\Z")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class PieceCounter:
    """Lengths of texts under a byte-level tokenizer, by way of distinct pieces.

    ``words`` holds lengths of pieces that follow a space (the space belongs
    to them); ``starts`` those that begin a text or a line. The first
    ``most`` distinct pieces are remembered, those beyond only for their group.
    """

    _made: dict[str, PieceCounter] = {}

    def __init__(self, path: str, most: int = 500_000):
        self.tok, self.most = load_tokenizer(path), most
        self.words: dict[str, int] = {"": 0}
        self.starts: dict[str, int] = {"\n": 1}

    def _pieces(self, text: str) -> tuple[list[str], list[str]]:
        """The pieces without and with a leading space."""
        if _DOUBLE.search(text):
            first, *rest = _SAFE.split(text)
            return [first] if first else [], rest
        lines = text.split("\n")
        heads, rest = ["\n"] * (len(lines) - 1), []
        for line in lines:
            head, *tail = line.split(" ")
            if head:
                heads.append(head)
            rest += tail
        return heads, rest

    @classmethod
    def shared(cls, path: str) -> PieceCounter:
        """The one of this Python worker, which keeps its pieces from task to task."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, known: dict[str, int], units: set[str], lead: str) -> list[str]:
        """Add the lengths of new ``units``, which follow ``lead``, to ``known``; the new ones."""
        fresh = {unit[len(lead) :]: len(ids) for unit, ids in encode_unseen(self.tok, [lead + u for u in units.difference(known)])}
        known.update(fresh)
        return list(fresh)

    def count(self, texts: list[str], budget: int = 1 << 21) -> list[int]:
        """Token counts of ``texts``, taken in groups of about ``budget`` bytes."""
        out, at = [], 0
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and (not group or held + sizes[at] <= budget):
                held += sizes[at]
                group.append(self._pieces(texts[at]))
                at += 1
            full = len(self.words) + len(self.starts) > self.most
            starts = self._learn(self.starts, set().union(*(h for h, _ in group)), "")
            words = self._learn(self.words, set().union(*(r for _, r in group)), " ")
            out += [sum(map(self.starts.__getitem__, h)) + sum(map(self.words.__getitem__, r)) for h, r in group]
            if full:
                for known, fresh in ((self.starts, starts), (self.words, words)):
                    for unit in fresh:
                        del known[unit]
        return out


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null and empty texts have no tokens; a null id stays null; repeated rows
    give repeated rows; other columns are ignored. The counts are those of
    the whole text under the library's defaults, so a special token's string
    inside a text counts as that one token. No shuffle.
    """
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter.shared(path)
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": counter.count(texts)})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
