"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All rules are compiled into one Shift-And automaton whose states are packed
into 64-bit words. A step on one character of a URL is
``D = ((D << 1) & B[c]) | (D & L[c])``: ``B`` moves every rule on by a
literal, ``L`` keeps the states under a wildcard. NumPy makes each step for
all URLs of a block at once, so the cost is characters times words, whatever
the number of rules that match.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``.

    Both may hold ``*`` (any run of characters but ``/``) and ``?`` (one such
    character).
    """

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


class GlobAutomaton:
    """The packed automaton of a list of rules; longer rules come first."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        bits: list[tuple[set[int] | None, set[int]]] = []  # of each state: bytes that lead into it, bytes that stay in it
        self.first, self.last = [], []
        other = set(range(256)) - {ord("/")}
        for rule in self.rules:
            self.first.append(len(bits))
            bits.append((set(), set(other)))  # any labels before the dot
            for c in b"." + rule.host.lower().encode() + rule.path.encode():
                if c == ord("*"):
                    bits[-1] = (bits[-1][0], bits[-1][1] | other)
                else:
                    bits.append((set(other) if c == ord("?") else {c}, set()))
            bits[-1] = (bits[-1][0], set(range(256)))  # whatever follows
            self.last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.into = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for i, (into, stay) in enumerate(bits):
            bit = np.uint64(1 << (i % 64))
            for c in into:
                self.into[c, i // 64] |= bit
            for c in stay:
                self.stay[c, i // 64] |= bit
        self.start = np.zeros(self.words, np.uint64)
        for i in self.first:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """The index of the first rule that fits each ``.host/path``, or -1."""
        n = len(urls)
        found = np.full(n, -1, np.int64)
        if not n or not self.rules:
            return found
        lengths = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        text = np.frombuffer(b"".join(urls), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sizes = lengths[order]
        state = np.tile(self.start, (n, 1))
        active = n
        for step in range(int(sizes[0]) if n else 0):
            while active and sizes[active - 1] <= step:
                active -= 1
            c = text[begin[:active] + step]
            d = state[:active]
            moved = d << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.into[c]) | (d & self.stay[c])
        hit = np.full(n, -1, np.int64)
        for k in range(len(self.rules) - 1, -1, -1):
            i = self.last[k]
            hit[(state[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1] = k
        found[order] = hit
        return found


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", block: int = 8192) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    The longest fitting rule decides (of two as long, the one listed first);
    where none fits, ``rule`` is null and ``verdict`` is ``default``. A null
    URL or one without ``://`` has empty host and path and no rule. Repeated
    rows give repeated rows; other columns are ignored. No shuffle.
    """
    rules = list(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto = GlobAutomaton(rules)
        names = np.array([r.name for r in auto.rules] + [None], object)
        verdicts = np.array([r.verdict for r in auto.rules] + [default], object)
        for pdf in batches:
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                hit = auto.match([("." + h + p).encode() for h, p in zip(part["host"], part["path"], strict=True)])
                yield part.assign(rule=names[hit], verdict=verdicts[hit])

    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(host, upper, lower).alias("host"), path.alias("path"))
    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string")
