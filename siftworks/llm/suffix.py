"""Suffix-array dedup: a common-prefix-aware distributed merge sort.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere
else, too. The suffixes that are sorted are a sparse sample that misses no
such string: the minimizers. Of every window of ``length`` bytes the
``gram``-byte string of least hash is its anchor, so equal windows have
anchors at equal places, and the windows of one anchor, its span, are
consecutive.

1. Every group of texts counts its anchors' grams by digest. A gram that
   stands at one anchor in all has no partner and ends there.
2. The others are exchanged: every group of texts sorts the suffixes at
   their anchors, equal ones once, and front-codes the sorted run (bytes
   shared with the predecessor are not sent). Runs are dealt by gram. A gram
   of more than ``hot`` spans (the edge of a passage that stands in very
   many texts) is dealt by more of its text: its windows are cut by their
   distance to the anchor, a distance that doubles from block to block, and
   each block is a suffix of its own, dealt by all bytes that its windows
   have in common.
3. Each task merges its runs with a loser tree whose players carry their
   common prefix with the last winner, so no known prefix is compared again.
   The merged suffixes' common prefixes, and the common ends of the bytes
   before the anchors, say for each distance to the anchor which windows
   are equal; those that occur twice go.

Texts are made distinct first, written once to a bucketed table in the
shared folder, and read from there without a shuffle by every step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, join_lookup, partitions, staged, staged_path, unused

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: dict[int, np.ndarray] = {}
_ANSWER = np.dtype([("item", "<u4"), ("low", "<u2"), ("high", "<u2")])
#: Bytes that are hashed at a time; bounds the arrays of a task.
STRETCH = 1 << 17


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


class _Digests:
    """Digests of any substrings of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.sums = []
        for base in _BASES:
            s = np.zeros(n, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, n)[:-1], out=s[1:])
            self.sums.append(s)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        s, back = self.sums[which], _power(_INVERSES[which], len(self.sums[which]))
        return _mix((s[end] - s[begin]) * back[begin])

    def every(self, size: int, which: int) -> np.ndarray:
        """Those of all substrings of ``size`` bytes."""
        s = self.sums[which]
        n = len(s) - size
        return _mix((s[size:] - s[:n]) * _power(_INVERSES[which], n))


class Anchors:
    """Anchors of a group of texts; ``n``: how often each text occurs.

    Per span (``at``: anchor, ``begin``: its first window, ``count``: its
    windows; places in the joined texts), its entry among the distinct
    ``(gram, span)`` digests, which are sorted; ``multi`` says which of them
    occur twice within the group. Long groups are taken in stretches, so
    memory doesn't grow with a text; a span at a stretch's end is two.
    """

    def __init__(self, texts: list[bytes], n: np.ndarray, length: int, gram: int, stretch: int = STRETCH):
        self.length, self.width = length, gram
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        total = len(self.data)
        valid = np.zeros(total + 1, np.int32)
        some = sizes >= length
        np.add.at(valid, self.offsets[:-1][some], 1)
        np.add.at(valid, self.offsets[1:][some] - length + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for lo in range(0, max(0, total - length + 1), stretch):
            hi = min(lo + stretch, total - length + 1)
            if not valid[lo:hi].any():
                continue
            digests = _Digests(self.data[lo : hi + length - 1])
            grams = digests.every(gram, 0)
            least = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
            wide, width = least, 1
            goal = length - gram + 1
            while 2 * width <= goal:
                wide = np.minimum(wide[:-width], wide[width:])
                width *= 2
            if width < goal:
                wide = np.minimum(wide[: len(wide) - (goal - width)], wide[goal - width :])
            anchor = (wide & np.uint64(0xFFFFFF)).astype(np.int64)
            ok = valid[lo:hi]
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
            begin = np.flatnonzero(new)
            stop = ok.copy()
            stop[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
            end = np.flatnonzero(stop) + 1
            x = anchor[begin]
            parts[0].append(x + lo)
            parts[1].append(begin + lo)
            parts[2].append(end - begin)
            # anchors have small digests, so their high bits don't deal evenly: the low ones lead
            parts[3].append((grams[x] << np.uint64(40)) | (grams[x] >> np.uint64(24)))
            parts[4].append(digests.of(begin, end + length - 1, 1) ^ _mix((x - begin).astype(np.uint64)))
        join = lambda p, kind: np.concatenate(p) if p else np.zeros(0, kind)
        self.at, self.begin, self.count = (join(p, np.int64) for p in parts[:3])
        gram_of, span_of = (join(p, np.uint64) for p in parts[3:])
        order = np.lexsort((span_of, gram_of))
        g, s = gram_of[order], span_of[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
        self.gram, self.span = g[fresh], s[fresh]
        entry = np.cumsum(fresh) - 1
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = entry
        self.first = order[fresh]
        owner = np.searchsorted(self.offsets, self.begin, side="right") - 1
        self.multi = np.bincount(self.entry, n[owner], len(self.gram)) >= 2 if len(order) else np.zeros(0, bool)
        self.grams, self.of_gram, self.spans = np.unique(self.gram, return_inverse=True, return_counts=True)


#: Distances of a hot gram's windows to their anchor, by block: each from its own to the next less one.
BLOCKS = (0, 1, 2, 4, 8, 16, 32, 64, 1 << 16)


def _range(digest: np.ndarray, n: int) -> np.ndarray:
    """The range, of ``n``, that a digest is dealt to."""
    return (((digest >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


class Items:
    """What a group of texts exchanges, given the ``code`` of each of its grams: 0 nothing, 1 as it is, 2 in blocks.

    Per item its suffix's place ``at`` and the places of its first and last
    window, ``begin`` and ``last``; the range it is dealt to; ``twice``, the
    items that occur twice within the group. An item's number is its place
    in these arrays, which every step makes alike.
    """

    def __init__(self, own: Anchors, code: np.ndarray, ranges: int):
        length = own.length
        code = code[own.of_gram]
        plain = np.flatnonzero(code == 1)
        i = own.first[plain]
        at, begin, last = [own.at[i]], [own.begin[i]], [own.begin[i] + own.count[i] - 1]
        to, self.twice = [_range(own.gram[plain], ranges)], {}
        hot = own.first[np.flatnonzero(code == 2)]
        data, seen, rows = own.data, {}, []
        for x, p, q in zip(own.at[hot].tolist(), own.begin[hot].tolist(), (own.begin[hot] + own.count[hot] - 1).tolist(), strict=True):
            for low, high in zip(BLOCKS, BLOCKS[1:], strict=False):
                a, b = max(p, x - high + 1), min(q, x - low)
                if a > b:
                    continue
                text = data[a : b + length].tobytes()
                place = x - low
                number = seen.setdefault((text, place - a), len(rows))
                if number < len(rows):  # equal to a span's block elsewhere in the group
                    self.twice.setdefault(len(plain) + number, []).append((a, b))
                    continue
                # every window that this block may have holds these bytes
                common = data[place : x - min(high - 1, length - own.width) + length].tobytes()
                rows.append((place, a, b, xxhash.xxh3_64_intdigest(common, low)))
        if rows:
            cut = list(zip(*rows, strict=True))
            for held, new in zip((at, begin, last), cut[:3], strict=True):
                held.append(np.array(new, np.int64))
            to.append(_range(np.array(cut[3], np.uint64), ranges))
        self.at, self.begin, self.last, self.to = (np.concatenate(x) for x in (at, begin, last, to))

    def runs(self, own: Anchors) -> dict[int, bytes]:
        """For each range the sorted, front-coded run of its items."""
        data = own.data.tobytes()
        runs: dict[int, list] = {}
        for number, (b, x, p, q) in enumerate(zip(self.to.tolist(), self.at.tolist(), self.begin.tolist(), self.last.tolist(), strict=True)):
            runs.setdefault(b, []).append((data[x : q + own.length], data[p:x], x - q, number))
        return {b: front_coded(sorted(run)) for b, run in runs.items()}


def front_coded(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of ``(suffix, bytes before, first shift, entry)``: shared prefix, then the rest."""
    out, last = [], b""
    for suffix, before, low, number in entries:
        shared = common_prefix(last, suffix, 0)
        out.append(b"".join((number.to_bytes(4, "little"), low.to_bytes(2, "little"), shared.to_bytes(2, "little"), (len(suffix) - shared).to_bytes(2, "little"), len(before).to_bytes(2, "little"), suffix[shared:], before)))
        last = suffix
    return b"".join(out)


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int]]:
    """``(suffix, prefix shared with the one before, bytes before, first shift, entry)`` of a run."""
    at, last = 0, b""
    while at < len(blob):
        number, low, shared, rest, before = int.from_bytes(blob[at : at + 4], "little"), *(int.from_bytes(blob[at + i : at + i + 2], "little") for i in (4, 6, 8, 10))
        at += 12
        last = last[:shared] + blob[at : at + rest]
        yield last, shared, blob[at + rest : at + rest + before], low, number
        at += rest + before


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple[int, tuple, int]]:
    """``(run, item, prefix shared with the last)`` of all sorted runs, in order.

    A loser tree: each inner node holds the loser of the match played there
    with its common prefix with the winner. Of two players the one with the
    longer prefix in common with the last winner is the smaller; only at
    equal prefixes are bytes compared, from there on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    current: list[tuple | None] = [next(r, None) for r in runs] + [None] * (n - len(runs))
    shared = [0] * n
    tree = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix becomes that in common with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        p = common_prefix(x[0], y[0], shared[a])
        if p == len(x[0]) or (p < len(y[0]) and x[0][p] < y[0][p]):
            shared[b] = p
            return a, b
        shared[a] = p
        return b, a

    winners = [0] * n + list(range(n))
    for i in range(n - 1, 0, -1):
        winners[i], tree[i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[1] if n > 1 else 0
    while (item := current[best]) is not None:
        yield best, item, shared[best]
        current[best] = following = next(runs[best], None)
        shared[best] = following[1] if following else 0
        i = (best + n) // 2
        while i:
            best, tree[i] = play(best, tree[i])
            i //= 2


def repeats(merge: list[tuple[int, tuple, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of merged items: places among them, and the lowest and highest distance of runs of windows that occur twice.

    At distance ``k`` two items share a window if their suffixes share
    ``length - k`` bytes and the bytes before them end in ``k`` equal ones.
    The first is a class of the sorted suffixes, the second one of the
    sorted ends, so a window occurs twice if its pair of classes does. The
    cost is that of sorting, whatever the number of items that are alike.
    """
    n = len(merge)
    shared = np.array([p for _, _, p in merge], np.int64)
    shared[:1] = 0
    longest = np.maximum(shared, np.append(shared[1:], 0))
    low = np.fromiter((item[3] for _, item, _ in merge), np.int64, n)
    ends = [item[2][::-1] for _, item, _ in merge]
    reach = np.fromiter(map(len, ends), np.int64, n)
    order = sorted(range(n), key=ends.__getitem__)
    alike = np.fromiter((common_prefix(ends[i], ends[j], 0) for i, j in zip(order, order[1:], strict=False)), np.int64, max(0, n - 1))
    alike = np.concatenate([[0], alike])[:n]
    order = np.array(order, np.int64)
    out: list[list[np.ndarray]] = [[], [], []]
    since, going = np.zeros(n, np.int64), np.zeros(n, bool)

    def close(which: np.ndarray, k: int) -> None:
        out[0].append(which)
        out[1].append(since[which])
        out[2].append(np.full(len(which), k - 1))

    rank = np.empty(n, np.int64)
    top = int(reach.max(initial=0))
    for k in range(top + 1):
        some = np.flatnonzero((low <= k) & (reach >= k) & (longest >= length - k))
        now = np.zeros(n, bool)
        if len(some) > 1:
            rank[order] = np.cumsum(alike < k)
            pair = np.cumsum(shared < length - k)[some] * (n + 1) + rank[some]
            by = np.argsort(pair, kind="stable")
            same = pair[by][1:] == pair[by][:-1]
            now[some[by[1:][same]]] = True
            now[some[by[:-1][same]]] = True
        close(np.flatnonzero(going & ~now), k)
        since[now & ~going] = k
        going = now
    close(np.flatnonzero(going), top + 1)
    return tuple(np.concatenate(x) for x in out)


def _distinct_texts(docs: DataFrame, text_col: str, groups: int, parts: int) -> DataFrame:
    """``m, key, n, packed``: each text once, in a table bucketed by its group ``m``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, seen = zstandard.ZstdCompressor(level=3), {}
        for pdf in batches:
            fresh = []
            for i, key in enumerate(pdf["key"].tolist()):
                seen[key] = seen.get(key, 0) + 1
                if seen[key] == 1:
                    fresh.append(i)
            part = pdf.iloc[fresh]
            yield pd.DataFrame({"key": part["key"], "n": np.ones(len(part), np.int64), "packed": [pack.compress(t.encode()) for t in part["text"]]})
        more = [(k, c - 1) for k, c in seen.items() if c > 1]
        yield pd.DataFrame({"key": [k for k, _ in more], "n": np.array([c for _, c in more], np.int64), "packed": [None] * len(more)})

    spark = docs.sparkSession
    rows = bounded_batches(docs).select(_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.mapInPandas(pack, "key binary, n long, packed binary").withColumn("m", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    rows = rows.repartition(parts, "m").groupBy("m", "key").agg(F.sum("n").alias("n"), F.first("packed", ignorenulls=True).alias("packed"))
    path = staged_path(spark, "texts")
    name = path.rpartition("/")[2].replace("-", "_")
    rows.write.bucketBy(parts, "m").sortBy("m").option("path", path).option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes from the catalog; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def _key(text_col: str):
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)


def _unpacked(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], np.ndarray]:
    pdf = pdf.sort_values("key")
    unpack = zstandard.ZstdDecompressor()
    return pdf, [unpack.decompress(t) for t in pdf["packed"]], pdf["n"].to_numpy()


def _kept_texts(docs: DataFrame, text_col: str, length: int, gram: int, hot: int, as_text: bool, group_bytes: int = 32 << 20) -> DataFrame:
    """``key, n, n_bytes, n_removed, n_spans, kept`` for every distinct text, of which there are ``n``.

    ``kept`` is the SHA-256 of the bytes that stay or, ``as_text``, what they say.
    """
    parts = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(parts, -(-size // group_bytes))  # a task holds the runs of one range, and one group's texts
    texts = _distinct_texts(docs, text_col, 4 * ranges, parts)

    def anchors(pdf: pd.DataFrame) -> tuple[Anchors, pd.DataFrame]:
        pdf, unpacked, n = _unpacked(pdf)
        return Anchors(unpacked, n, length, gram), pdf

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        own, m = anchors(pdf)[0], int(pdf["m"].iloc[0])
        cut = np.searchsorted(_range(own.grams, ranges), np.arange(ranges + 1))
        spans = own.spans.astype("<u4")
        rows = [(b, m, own.grams[cut[b] : cut[b + 1]].tobytes() + spans[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut)).tolist()]
        return pd.DataFrame(rows, columns=["b", "m", "blob"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each gram of each group: 0, it stands at one anchor in all; 1, at more; 2, at more than ``hot``."""
        rows = [r for pdf in batches for r in zip(pdf["b"].tolist(), pdf["m"].tolist(), pdf["blob"], strict=True)]
        if not rows:
            return
        size = [len(r[2]) // 12 for r in rows]
        grams = np.concatenate([np.frombuffer(r[2], "<u8", n) for r, n in zip(rows, size, strict=True)])
        spans = np.concatenate([np.frombuffer(r[2], "<u4", n, 8 * n) for r, n in zip(rows, size, strict=True)])
        _, of, = np.unique(grams, return_inverse=True)
        total = np.bincount(of, spans)[of]
        code = (total >= 2).astype(np.uint8) + (total > hot).astype(np.uint8)
        cut = np.cumsum([0, *size]).tolist()
        yield pd.DataFrame({"m": np.array([r[1] for r in rows], np.int32), "kind": 0, "b": [r[0] for r in rows], "blob": [code[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]})

    counted = texts.groupBy("m").applyInPandas(count, "b int, m int, blob binary")
    codes = counted.repartitionById(ranges, F.col("b")).mapInPandas(decide, "m int, kind int, b int, blob binary")
    codes = staged(codes, "suffix-codes")

    def items_of(own: Anchors, said: pd.DataFrame) -> Items:
        said = said[said["kind"] == 0].sort_values("b")
        code = np.frombuffer(b"".join(said["blob"]), np.uint8) if len(said) else np.zeros(len(own.grams), np.uint8)
        return Items(own, code, ranges)

    def exchange(pdf: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(said):
            return pd.DataFrame({"b": [], "m": [], "blob": []})
        own, m = anchors(pdf)[0], int(pdf["m"].iloc[0])
        return pd.DataFrame([(b, m, blob) for b, blob in items_of(own, said).runs(own).items()], columns=["b", "m", "blob"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The items of each range, merged; ranges that share a task go one after the other."""
        rows = sorted((r for pdf in batches for r in zip(pdf["b"].tolist(), pdf["m"].tolist(), pdf["blob"], strict=True)), key=lambda r: r[:2])
        for b, of_range in groupby(rows, key=lambda r: r[0]):
            runs = list(of_range)
            found: dict[int, list[np.ndarray]] = {}

            def settle(merge: list) -> None:
                which, low, high = repeats(merge, length)
                run = np.fromiter((r for r, _, _ in merge), np.int64, len(merge))[which]
                got = np.empty(len(which), _ANSWER)
                got["item"], got["low"], got["high"] = np.fromiter((item[4] for _, item, _ in merge), np.int64, len(merge))[which], low, high
                order = np.argsort(run, kind="stable")
                for r, mine in zip(*_pieces(run[order], got[order]), strict=True):
                    found.setdefault(runs[r][1], []).append(mine)

            held: list = []
            for run, item, p in merged([read_run(r[2]) for r in runs]):
                if p < gram and len(held) >= 1 << 14:
                    settle(held)
                    held = []
                held.append((run, item, p))
            if held:
                settle(held)
            if found:
                yield pd.DataFrame([(m, 1, b, np.concatenate(x).tobytes()) for m, x in found.items()], columns=["m", "kind", "b", "blob"])

    sent = texts.groupBy("m").cogroup(codes.groupBy("m")).applyInPandas(exchange, "b int, m int, blob binary")
    solved = sent.repartitionById(ranges, F.col("b")).mapInPandas(solve, "m int, kind int, b int, blob binary")

    def remove(pdf: pd.DataFrame, said: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"key": [], "n": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []})
        own, pdf = anchors(pdf)
        n = pdf["n"].to_numpy()
        cover = np.zeros(len(own.data) + 1, np.int32)

        def gone(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(cover, begin, 1)
            np.add.at(cover, end, -1)

        # spans, and blocks of hot ones, that occur twice within the group
        twice = np.flatnonzero(own.multi[own.entry])
        gone(own.begin[twice], own.begin[twice] + own.count[twice] - 1 + length)
        if len(said):
            items = items_of(own, said)
            again = [(int(items.begin[i]), int(items.last[i])) for i in items.twice] + [p for places in items.twice.values() for p in places]
            for a, b in again:
                gone(np.array([a]), np.array([b + length]))
            pairs = np.frombuffer(b"".join(said["blob"][said["kind"] == 1]), _ANSWER)
            x = items.at[pairs["item"]]
            gone(x - pairs["high"], x - pairs["low"] + length)
        inside = np.cumsum(cover[:-1]) > 0
        rows = []
        for key, copies, a, b in zip(pdf["key"], n.tolist(), own.offsets.tolist(), own.offsets[1:].tolist(), strict=False):
            out = inside[a:b]
            if copies > 1 and b - a >= length:
                out = np.ones(b - a, bool)
            starts = int(out[:1].sum()) + int((out[1:] & ~out[:-1]).sum())
            kept = own.data[a:b][~out].tobytes()
            rows.append((key, copies, b - a, int(out.sum()), starts, kept.decode(errors="ignore") if as_text else hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["key", "n", "n_bytes", "n_removed", "n_spans", "kept"])

    answers = codes.unionByName(solved)
    return texts.groupBy("m").cogroup(answers.groupBy("m")).applyInPandas(remove, "key binary, n long, n_bytes long, n_removed long, n_spans long, kept string")


def _pieces(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The values of each key; keys are sorted."""
    cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()] if len(keys) else []
    return [int(keys[i]) for i in cut], [values[i:j] for i, j in zip(cut, [*cut[1:], len(keys)], strict=False)]


def dedup_report(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    Null text counts as empty; texts shorter than ``length`` lose nothing;
    of repeated texts, so of repeated rows, all lose all of it. Strings are
    judged on the input. Other columns are ignored; null ids stay null. A
    gram of more than ``hot`` spans is dealt in blocks; no result depends on it.
    """
    kept = staged(_kept_texts(docs, text_col, length, gram, hot, as_text=False).withColumnRenamed("kept", "kept_sha256"), "suffix-report")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(text_col).alias("key"))
    return join_lookup(rows, kept, "key", "n", ["doc_id"]).drop("key")


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, hot: int = 1024) -> DataFrame:
    """``docs`` without the repeated bytes of ``text``; rows that lose all are dropped.

    Bytes of a character that was cut in two are left out. ``n_chars``, if
    present, is that of the new text. A null text stays null.
    """
    key, left, null = unused(docs, "_key", "_kept", "_null")
    kept = _kept_texts(docs, "text", length, gram, hot, as_text=True).filter((F.col("n_bytes") > F.col("n_removed")) | (F.col("n_removed") == 0))
    (n,) = unused(docs, "_n")
    kept = staged(kept.select(F.col("key").alias(key), F.col("kept").alias(left), F.col("n").alias(n)), "suffix-kept")
    spread = [f"`{f.name}`" for f in docs.schema.fields if f.name not in ("text", "n_chars") and '"map"' not in f.dataType.json()]
    rows = docs.withColumns({key: _key("text"), null: F.col("text").isNull()}).drop("text", *(["n_chars"] if "n_chars" in docs.columns else []))
    rows = join_lookup(rows, kept, key, n, spread or [key]).withColumn("text", F.when(~F.col(null), F.col(left)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
