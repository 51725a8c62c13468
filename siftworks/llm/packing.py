"""Packing: bounded-space best-fit of token pieces into windows of fixed length.

Each partition keeps a fixed number of open windows. A piece goes into the
window whose gap it fills best; where none can hold it, the fullest window
is filled up with the piece's head and emitted, and the tail goes on. What a
partition leaves open, at most ``windows`` windows, is packed again with
that of others, in rounds of fewer and fewer tasks; the last rest is cut into
windows of powers of two, which need no padding either.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, encode_unseen, load_tokenizer, staged, tokenizer_path

#: Words of Latin letters and punctuation, without digits and apostrophes: cheap steps split them as the usual patterns do.
_LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:-@\[-`{-~]"
_plain = re.compile(f"{_LETTERS}+").fullmatch

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordEncoder:
    """Token ids of texts, four bytes each, by way of distinct words.

    For vocabularies whose pre-tokenizer drops white space, words between
    spaces and line feeds encode alone as they do in the text. The first
    ``most`` distinct words are remembered, those beyond only for their group.
    """

    _made: dict[tuple, WordEncoder] = {}

    def __init__(self, path: str, end: int, most: int = 200_000):
        self.tok, self.most = load_tokenizer(path), most
        self.end = end.to_bytes(4, "little")
        special = {token.content: number for number, token in self.tok.get_added_tokens_decoder().items() if token.special}
        self.mark, self.mark_id = self._sign() or max(special.items(), key=lambda x: x[1], default=("", -1))
        self.odd = re.compile("|".join(map(re.escape, {*special, self.mark.strip(" ")} - {""})) or "(?!)").search
        self.words: dict[str, bytes] = {"": b""}
        self.twin = self._twin()

    def _sign(self) -> tuple[str, int] | None:
        """A sign that, between blanks, is one token: it keeps words apart at half the cost of a special token."""
        ids = lambda text: self.tok.encode(text, add_special_tokens=False).ids
        a = ids("a")
        for sign in "|~^\\":
            if len(ids(sign)) == 1 and a.count(ids(sign)[0]) == 0 and ids(f"a {sign} a") == [*a, *ids(sign), *a]:
                return f" {sign} ", ids(sign)[0]
        return None

    def _twin(self):
        """The same model behind steps without patterns, for plain words in lower case; None unless it agrees on all pairs of their signs.

        Whether two signs stand in one token's word depends on no others there, so pairs tell.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        if not _plain(self.mark.strip(" ")):
            return None
        twin = Tokenizer.from_str(self.tok.to_str())
        twin.normalizer = None
        twin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Punctuation("contiguous"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        signs = re.findall(_LETTERS, "".join(map(chr, range(256))))
        pairs = [self.mark.join(a + b for b in signs) for a in signs]
        ids = lambda tok, texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return twin if ids(self.tok, pairs) == ids(twin, [p.lower() for p in pairs]) else None

    @classmethod
    def shared(cls, path: str, end: int, most: int) -> WordEncoder:
        """The one of this Python worker, which keeps its words from task to task."""
        if (path, end, most) not in cls._made:
            cls._made[path, end, most] = cls(path, end, most)
        return cls._made[path, end, most]

    def _learn(self, words: list[str], size: int = 4096) -> list[str]:
        """Encode new ``words``, many in one call, kept apart by a sign; words that hold it or a special token go alone."""
        odd = list(filter(self.odd, words)) if self.mark else words
        for word, ids in encode_unseen(self.tok, odd.copy()):
            self.words[word] = pack_ids(ids)
        even = ([w for w in words if not self.odd(w)] if odd else words) if self.mark else []
        easy = list(filter(_plain, even)) if self.twin else []
        rest = [w for w in even if not _plain(w)] if easy else even
        for tok, some in ((self.twin, easy), (self.tok, rest)):
            for at in range(0, len(some), size):
                part = some[at : at + size]
                line = self.mark.join(part)
                ids = np.array(tok.encode_batch_fast([line.lower() if tok is self.twin else line], add_special_tokens=False)[0].ids, "<u4")
                ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)) * 4
                packed, begin = ids.tobytes(), 0
                for word, stop in zip(part, ends.tolist(), strict=True):
                    self.words[word] = packed[begin:stop]
                    begin = stop + 4
        return words

    def encode(self, texts: list[str], budget: int = 1 << 21) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            group, held = [], 0
            while at < len(texts) and (not group or held + len(texts[at]) <= budget):
                held += len(texts[at])
                group.append(texts[at].replace("\n", " ").split(" "))
                at += 1
            full = len(self.words) > self.most
            fresh = self._learn(list(set().union(*group).difference(self.words)))
            coded = [b"".join(map(self.words.__getitem__, words)) + self.end for words in group]
            if full:
                for word in fresh:
                    del self.words[word]
            yield from coded


def pack_ids(ids: list[int]) -> bytes:
    """Unsigned little-endian four-byte integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Packer:
    """Best-fit with at most ``windows`` open windows of ``size`` tokens."""

    def __init__(self, size: int, windows: int, base: int):
        self.size, self.most, self.next = size, windows, base
        self.open: list[tuple[int, int]] = []  # (gap, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.count = 0

    def _rows(self, pieces: list[tuple], keep_ids: bool = False) -> Iterator[tuple]:
        offset, number = 0, self.next
        if not keep_ids:
            self.next += 1
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield (doc, start, n, zlib.crc32(ids), total, number, offset, ids if keep_ids else None)
            offset += n

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        """Place one piece; yields the rows of windows that became full."""
        size = self.size
        while len(ids) // 4 >= size:
            yield from self._rows([(doc, start, ids[: 4 * size], total)])
            start, ids = start + size, ids[4 * size :]
        if not ids:
            return
        n = len(ids) // 4
        at = bisect_left(self.open, (n, -1))
        if at < len(self.open):
            gap, window = self.open.pop(at)
            self.held[window].append((doc, start, ids, total))
            if gap == n:
                yield from self._rows(self.held.pop(window))
            else:
                insort(self.open, (gap - n, window))
            return
        if len(self.open) >= self.most:
            gap, window = self.open.pop(0)
            self.held[window].append((doc, start, ids[: 4 * gap], total))
            yield from self._rows(self.held.pop(window))
            start, ids = start + gap, ids[4 * gap :]
            n -= gap
        self.count += 1
        self.held[self.count] = [(doc, start, ids, total)]
        insort(self.open, (size - n, self.count))

    def leftovers(self) -> Iterator[tuple]:
        """The pieces of open windows, with their ids."""
        for pieces in self.held.values():
            yield from self._rows(pieces, keep_ids=True)
        self.held, self.open = {}, []

    def close(self) -> Iterator[tuple]:
        """Fill windows with all that is open; the last rest goes by powers of two."""
        pieces = [p for window in self.held.values() for p in window]
        self.held, self.open = {}, []
        left = sum(len(p[2]) for p in pieces) // 4
        room, taken = 0, []
        for doc, start, ids, total in pieces:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                cut = ids[: 4 * room]
                taken.append((doc, start, cut, total))
                room -= len(cut) // 4
                start, ids = start + len(cut) // 4, ids[len(cut) :]
                if not room:
                    yield from self._rows(taken)
                    taken = []


def _frames(rows: Iterable[tuple], size: int = 4096) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=names).astype({"doc_id": "Int64"})
            held = []
    if held:
        yield pd.DataFrame(held, columns=names).astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end: int = 2, size: int = 4096, windows: int = 32, fan_in: int = 16, words_kept: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All tokens of ``docs`` in sequences of at most ``size``: one row a piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Every document ends with ``end``, so null and empty texts are that one
    token. Repeated rows are packed each; null ids stay null; other columns
    are ignored; an empty table gives no rows. Sequences are full but for a
    few at the very end, whose lengths are powers of two. Documents stay in
    their own partitions, only leftovers move. ``words_kept`` distinct words
    stay encoded in each Python worker, at some 200 bytes each; it trades
    memory for time and changes no result.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            coder = WordEncoder.shared(path, end, words_kept)
            packer = Packer(size, windows, TaskContext.get().partitionId() << 32)
            for pdf in batches:
                ids = [None if pd.isna(i) else int(i) for i in pdf["doc_id"]]
                for doc, coded in zip(ids, coder.encode(pdf["text"].tolist()), strict=True):
                    yield from packer.add(doc, 0, coded, len(coded) // 4)
            yield from packer.leftovers()

        yield from _frames(rows())

    def again(level: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def rows() -> Iterator[tuple]:
                packer = Packer(size, windows, level << 56 | TaskContext.get().partitionId() << 32)
                for pdf in batches:
                    for doc, start, ids, total in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True):
                        yield from packer.add(None if pd.isna(doc) else int(doc), int(start), bytes(ids), int(total))
                yield from packer.close() if last else packer.leftovers()

            yield from _frames(rows())

        return run

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    packed = staged(rows.mapInPandas(first, _SCHEMA), "packing-0")
    done, rest, level = [packed.filter("ids is null")], packed.filter("ids is not null"), 0
    while True:
        parts, level = -(-parts // fan_in), level + 1
        moved = rest.repartition(parts, F.xxhash64("doc_id", "start", "ids_crc32")) if parts > 1 else rest.coalesce(1)
        moved = moved.sortWithinPartitions(F.col("length").desc(), "doc_id", "start", "ids_crc32")
        packed = staged(moved.mapInPandas(again(level, parts == 1), _SCHEMA), f"packing-{level}")
        done.append(packed.filter("ids is null"))
        rest = packed.filter("ids is not null")
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids")
