"""Language ID: a linear-chain conditional random field over words.

Words carry hashed features: affixes of one to three letters, letter pairs
and triples with word ends, and the word itself (the lexicon). A label's
score is the sum of its learned weights, neighbouring words are tied by
learned transitions, and forward-backward gives each word's posterior over
languages, also in code-switched text. A text's language is that of the
largest mean posterior.

Forward-backward runs over stretches of 64 words: the stretches' transfer
matrices are made side by side, chained within each text, and then every
stretch is filled in. So a text of any length is read whole, at a cost per
word that does not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bounded_batches, unused

_LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    words = _LETTERS.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    # fractions, circled numbers and the like are word characters, but no letters
    return ["".join(run) for w in words for letters, run in groupby(w, str.isalpha) if letters]


def _hash(slots: int, kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind + 1, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)) & np.uint64(slots - 1)


def features(words: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of all words, and where each word's begin (each word has some)."""
    n = len(words)
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])  # of the opening mark
    end = begin + size + 1  # of the closing mark
    who = np.repeat(np.arange(n), size + 2)
    own, slot = [], []
    for k in (2, 3):  # letter pairs and triples with the marks
        at = np.arange(len(text) - k + 1)
        at = at[at + k - 1 <= end[who[at]]]
        own.append(who[at])
        slot.append(_hash(slots, k, *(text[at + j] for j in range(k))))
    for k in (1, 2, 3):  # affixes
        some = np.flatnonzero(size >= k)
        own += [some, some]
        slot += [_hash(slots, 10 + k, *(text[begin[some] + 1 + j] for j in range(k))), _hash(slots, 20 + k, *(text[end[some] - 1 - j] for j in range(k)))]
    weights = (text + np.uint64(7)) * (np.arange(len(text), dtype=np.uint64) - begin[who].astype(np.uint64) + np.uint64(1)) ** np.uint64(5)
    own.append(np.arange(n))  # the lexicon
    slot.append(_hash(slots, 30, np.add.reduceat(weights, begin)))
    own, slot = np.concatenate(own), np.concatenate(slot).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return slot[order], np.searchsorted(own[order], np.arange(n))


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # slots x labels
    steps: np.ndarray  # label x label

    def scores(self, words: list[str], size: int = 8192) -> np.ndarray:
        """The words' summed weights, ``size`` words at a time, so that their features stay few."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), size):
            slot, first = features(words[at : at + size], len(self.weights))
            out[at : at + size] = np.add.reduceat(self.weights[slot], first, axis=0)
        return out

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray, stretch: int = 64) -> np.ndarray:
        """Sums over each text's words of the posterior of every label.

        ``scores`` holds the words of all texts in turn, ``lengths`` their numbers, all above 0.
        """
        k, n = len(self.labels), len(lengths)
        trans = np.exp(self.steps - self.steps.max()).astype(np.float64)
        phi = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-9
        parts = -(-lengths // stretch)
        seg0 = np.concatenate([[0], np.cumsum(parts)[:-1]])
        text = np.repeat(np.arange(n), parts)
        rank = np.arange(len(text)) - seg0[text]
        begin = (np.concatenate([[0], np.cumsum(lengths)[:-1]])[text]) + rank * stretch
        size = np.minimum(stretch, lengths[text] - rank * stretch)
        order = np.argsort(-size, kind="stable")  # full stretches first: those still going are a head
        begin, size = begin[order], size[order]
        going = [int(np.searchsorted(-size, -t, side="left")) for t in range(stretch)]
        move = np.tile(np.eye(k), (len(order), 1, 1))
        for t in range(stretch):
            if not (m := going[t]):
                break
            x = (move[:m] @ trans) * phi[begin[:m] + t][:, None, :]
            move[:m] = x / x.max(axis=(1, 2), keepdims=True)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        head, tail = np.empty((len(order), k)), np.empty((len(order), k))
        carry = np.full((n, k), 1 / k)
        long = np.argsort(-parts, kind="stable")
        alive = np.searchsorted(-parts[long], -np.arange(int(parts.max())), side="left")
        for r in range(int(parts.max())):
            who = long[: alive[r]]
            seg = place[seg0[who] + r]
            head[seg] = carry[who]
            x = (carry[who][:, None, :] @ move[seg])[:, 0]
            carry[who] = x / x.sum(axis=1, keepdims=True)
        carry = np.full((n, k), 1 / k)
        for r in range(int(parts.max()) - 1, -1, -1):
            who = long[: alive[r]]
            seg = place[seg0[who] + r]
            tail[seg] = carry[who]
            x = (move[seg] @ carry[who][:, :, None])[:, :, 0]
            carry[who] = x / x.sum(axis=1, keepdims=True)
        alpha = np.zeros((len(order), min(stretch, int(size.max())), k))
        a = head
        for t in range(alpha.shape[1]):
            m = going[t]
            x = (a[:m] @ trans) * phi[begin[:m] + t]
            a = x / x.sum(axis=1, keepdims=True)
            alpha[:m, t] = a
        total = np.zeros((len(order), k))
        beta = tail.copy()
        for t in range(alpha.shape[1] - 1, -1, -1):
            m = going[t]
            x = alpha[:m, t] * beta[:m]
            total[:m] += x / x.sum(axis=1, keepdims=True)
            y = (beta[:m] * phi[begin[:m] + t]) @ trans.T
            beta[:m] = y / y.sum(axis=1, keepdims=True)
        return np.add.reduceat(total[place], seg0, axis=0)


def train(texts: list[str], langs: list[str], slots: int = 1 << 16, length: int = 48, batch: int = 64, rate: float = 0.5, words: int = 300_000, seed: int = 3) -> Crf:
    """Fit on labelled texts by AdaGrad on the chains' log-likelihood.

    Chains are made of runs of 4 to 24 words of sampled texts; the next run of a chain comes
    from a text of any language, so the transitions learn code-switching.
    At most ``words`` are used, the same share of them for every label.
    """
    labels = sorted(set(langs))
    k = len(labels)
    draw = np.random.default_rng(seed)
    runs: list[tuple[list[str], int]] = []
    left = [words // max(1, k)] * k
    for i in draw.permutation(len(texts)).tolist():
        label = labels.index(langs[i])
        said = words_of(texts[i])[: left[label]]
        left[label] -= len(said)
        at = 0
        while at < len(said):
            n = int(draw.integers(4, 25))
            runs.append((said[at : at + n], label))
            at += n
    vocabulary: dict[str, int] = {}
    said, tags = [], []
    for i in draw.permutation(len(runs)).tolist():
        said += [vocabulary.setdefault(w, len(vocabulary)) for w in runs[i][0]]
        tags += [runs[i][1]] * len(runs[i][0])
    chains = len(said) // length
    if not chains:
        length, chains = len(said), min(1, len(said))
    model = Crf(labels, np.zeros((slots, k), np.float32), np.zeros((k, k)))
    if k < 2 or not chains:
        return model
    said, tags = np.array(said[: chains * length]).reshape(chains, length), np.array(tags[: chains * length]).reshape(chains, length)
    slot, first = features(list(vocabulary), slots)
    count = np.diff(np.concatenate([first, [len(slot)]]))
    square, square2 = np.full((slots, k), 1e-2, np.float32), np.full((k, k), 1e-2)
    eye = np.eye(k)
    for at in range(0, chains, batch):
        ids, gold = said[at : at + batch], tags[at : at + batch]
        used, back = np.unique(ids, return_inverse=True)
        back = back.reshape(ids.shape)
        sizes = count[used]
        flat = np.repeat(first[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        where, owner = slot[flat], np.repeat(np.arange(len(used)), sizes)
        u = np.add.reduceat(model.weights[where], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)[back].astype(np.float64)
        phi, trans = np.exp(u - u.max(axis=2, keepdims=True)) + 1e-9, np.exp(model.steps)
        alpha, beta = np.empty_like(u), np.empty_like(u)
        a = phi[:, 0] / phi[:, 0].sum(axis=1, keepdims=True)
        alpha[:, 0] = a
        for t in range(1, length):
            a = (a @ trans) * phi[:, t]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, t] = a
        b = np.ones_like(a) / k
        beta[:, -1] = b
        pairs = np.zeros((k, k))
        for t in range(length - 1, 0, -1):
            x = phi[:, t] * b
            joint = alpha[:, t - 1, :, None] * trans * x[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = x @ trans.T
            b /= b.sum(axis=1, keepdims=True)
            beta[:, t - 1] = b
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        miss = np.zeros((len(used), k))
        np.add.at(miss, back.ravel(), (eye[gold] - post).reshape(-1, k))
        grad = np.stack([np.bincount(where, miss[owner, j], slots) for j in range(k)], axis=1).astype(np.float32)
        square += grad**2
        model.weights += np.float32(rate) * grad / np.sqrt(square) * np.float32(0.1)
        turn = np.zeros((k, k))
        np.add.at(turn, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        square2 += (turn - pairs) ** 2
        model.steps += rate * (turn - pairs) / np.sqrt(square2)
    return model


def training_sample(docs: DataFrame, rows: int = 1200, chars: int = 4000, folds: int = 5) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled texts whose ``crc32(doc_id) % folds`` is not 0, cut to ``chars`` for fitting only.

    Each language gives its share of them, one text at least, or all it
    has, so a rare one is learned, too. A first pass counts the languages' rows; the second takes
    those whose hash falls under the share that gives a fifth more than
    needed, so a task hands over its share of the sample and no more.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    some = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold != 0))
    counts = some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return [], []
    each, spread = max(1, rows // len(counts)), 1 << 30
    below = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], spread if r["n"] <= 2 * each else int(spread * min(1.0, (1.2 * each + 50) / r["n"])))))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    drawn = some.select(F.substring("text", 1, chars).alias("text"), "lang", h.alias("h"), "doc_id").filter(F.col("h") < F.element_at(below, F.col("lang")))
    order = W.partitionBy("lang").orderBy("h", "doc_id", "text")
    got = drawn.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).orderBy("h", "doc_id", "lang", "text").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def _predict_series(batches: Iterator[pd.Series], model: Crf, most_words: int = 120_000, group: int = 40_000) -> Iterator[pd.DataFrame]:
    """Predictions for batches of texts; scores of words are remembered, up to ``most_words``."""
    kinds = len(model.labels)
    known: dict[str, int] = {}
    table = np.zeros((1 << 16, max(1, kinds)), np.float32)
    for batch in batches:
        texts = batch.tolist()
        at, pred, score = 0, [], []
        while at < len(texts):
            lists, held = [], 0
            while at < len(texts) and (not lists or held < group):
                lists.append(words_of(texts[at]))
                held += len(lists[-1])
                at += 1
            if len(known) > most_words:
                known = {}
            new = list(set().union(*lists).difference(known))
            if len(known) + len(new) > len(table):
                table = np.concatenate([table, np.zeros((max(len(table), len(new)), table.shape[1]), np.float32)])
            if new and kinds:
                table[len(known) : len(known) + len(new)] = model.scores(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            lengths = np.array([len(x) for x in lists])
            some = np.flatnonzero(lengths)
            names, values = np.full(len(lists), UNKNOWN, object), np.zeros(len(lists))
            if len(some) and kinds:
                ids = np.fromiter((known[w] for x in lists for w in x), np.int64, int(lengths.sum()))
                mass = model.posteriors(table[ids], lengths[some]) / lengths[some][:, None]
                best = mass.argmax(axis=1)
                names[some] = np.array(model.labels, object)[best]
                values[some] = np.clip(mass[np.arange(len(some)), best], 0, 1)
            pred += names.tolist()
            score += values.tolist()
        yield pd.DataFrame({"lang_pred": pred, "score": score})


def predict(docs: DataFrame, model: Crf, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, ``lang`` and ``score``, from the whole text alone; no shuffle.

    The score is the mean posterior of the language over the text's words.
    A null text, or one without a letter, is ``und`` with score 0. Columns
    of ``docs`` with these names are replaced.
    """

    @F.pandas_udf("lang_pred string, score double")
    def said(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _predict_series(texts, model)

    (both,) = unused(docs, "_said")
    rows = bounded_batches(docs).withColumn(both, said(F.coalesce(F.col("text"), F.lit(""))))
    return rows.withColumns({lang: F.col(both)["lang_pred"], score: F.col(both)["score"]}).drop(both)


def identify_language(docs: DataFrame, rows: int = 1200, chars: int = 4000, words: int = 300_000, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    The model is fitted on a bounded sample of labelled rows outside the
    held-out fold (``rows`` texts, ``chars`` of each, ``words`` in all,
    shared by all languages); prediction reads only the text, and all of it. A null id is not held out and not learned from. Without
    labelled rows every text is ``und``. Repeated rows give repeated rows;
    other columns are ignored.
    """
    model = train(*training_sample(docs, rows, chars, folds), words=words)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, words: int = 300_000, **sample) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with a mean posterior of at least ``least``."""
    model = train(*training_sample(docs, **sample), words=words)
    lang, score = unused(docs, "_lang", "_score")
    return predict(docs, model, lang, score).filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*docs.columns)
