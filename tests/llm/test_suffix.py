import hashlib
import random
from collections import defaultdict

import pytest

from siftworks.llm import suffix
from tests.llm.helpers import AWKWARD, documents


def brute(texts, length):
    """Rows by comparing every string of ``length`` bytes with every other."""
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]].append((d, i))
    gone = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    rows = []
    for b, g in zip(data, gone, strict=True):
        starts = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        rows.append((len(b), sum(g), starts, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    return rows


def run(spark, texts, **options):
    got = suffix.dedup_report(documents(spark, texts), **options).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]


def corpus(seed, n, vocabulary, passages, size=120):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 8))) for _ in range(vocabulary)]
    shared = [" ".join(draw.choice(words) for _ in range(draw.randint(30, 90))) for _ in range(passages)]
    texts = []
    for _ in range(n):
        t = [draw.choice(words) for _ in range(draw.randint(0, size))]
        for _ in range(draw.randint(0, 3)):
            t.insert(draw.randint(0, len(t)), draw.choice(shared)[draw.randint(0, 40) :])
        texts.append(" ".join(t))
    return texts + [texts[0], texts[1], texts[1]]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    texts = corpus(seed, 60, 40, 6)
    assert run(spark, texts) == brute(texts, 200)


def test_many_spans_of_one_gram(spark):
    """With a low limit nearly all grams are dealt in blocks; the result is the same."""
    texts = corpus(3, 80, 30, 2)
    want = brute(texts, 200)
    assert run(spark, texts, hot=1) == want
    assert run(spark, texts, hot=3) == want


@pytest.mark.parametrize("code", [1, 2])
def test_items_hold_every_window_once(code):
    """As they are or in blocks, items have all windows of their spans, and deal equal windows alike."""
    import numpy as np

    texts = [t.encode() for t in corpus(7, 30, 20, 2)[:30]]
    own = suffix.Anchors(texts, np.ones(len(texts), np.int64), 200, 64)
    items = suffix.Items(own, np.full(len(own.grams), code, np.uint8), 1000)
    places = [p for a, b in zip(items.begin.tolist(), items.last.tolist(), strict=True) for p in range(a, b + 1)]
    assert len(places) == len(set(places))
    windows = {own.data[p : p + 200].tobytes() for p in places}
    assert windows == {own.data[p : p + 200].tobytes() for b, c in zip(own.begin.tolist(), own.count.tolist(), strict=True) for p in range(b, b + c)}
    dealt = defaultdict(set)
    for x, a, b, to in zip(items.at.tolist(), items.begin.tolist(), items.last.tolist(), items.to.tolist(), strict=True):
        for p in range(a, b + 1):
            dealt[own.data[p : p + 200].tobytes()].add((x - p, to))
    assert all(len(v) == 1 for v in dealt.values())


def test_repeats_against_all_pairs():
    draw = random.Random(8)
    length = 12
    items = []
    for i in range(200):
        before = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 6)))
        low = draw.randint(0, len(before))
        items.append((bytes(draw.choice(b"ab") for _ in range(length - low)), before, low, i))
    blob = suffix.front_coded(sorted(items))
    merge = list(suffix.merged([suffix.read_run(blob)]))
    got = set()
    for which, low, high in zip(*(a.tolist() for a in suffix.repeats(merge, length)), strict=True):
        got |= {(merge[which][1][4], k) for k in range(low, high + 1)}
    window = lambda s, k: s[1][len(s[1]) - k :] + s[0][: length - k]
    has = lambda s, k: s[2] <= k <= len(s[1])
    want = {(s[3], k) for s in items for k in range(7) if has(s, k) and any(t is not s and has(t, k) and window(t, k) == window(s, k) for t in items)}
    assert got == want


def test_awkward_texts(spark):
    texts = [*AWKWARD, "y" * 199, "y" * 200, "z" * 201, "pq" * 300, ("line of text %\n" * 30), "é" * 150 + "tail", "é" * 150 + "other"]
    assert run(spark, texts) == brute(texts, 200)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_stretches_of_long_groups():
    """Spans cut at a stretch's end give the same windows."""
    import numpy as np

    texts = [t.encode() for t in corpus(4, 40, 20, 3)]
    n = np.ones(len(texts), np.int64)
    for stretch in (1 << 20, 700):
        own = suffix.Anchors(texts, n, 200, 64, stretch)
        windows = sorted(p for b, c in zip(own.begin.tolist(), own.count.tolist(), strict=True) for p in range(b, b + c))
        assert windows == [int(o) + i for o, t in zip(own.offsets, texts, strict=False) for i in range(len(t) - 199)]
        assert all(b <= x < b + 200 for b, x in zip(own.begin, own.at, strict=True))


def test_texts_longer_than_a_stretch(spark):
    draw = random.Random(6)
    filler = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage, at = filler(500), suffix.STRETCH
    long = filler(at - 250) + passage + filler(at - 400) + passage + filler(999) + passage[100:]
    texts = [long, filler(300) + passage[:320], filler(2 * at), "short"]
    assert run(spark, texts) == brute(texts, 200)


def test_loser_tree_merges_with_known_prefixes():
    draw = random.Random(5)
    runs = [sorted(bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 30))) for _ in range(7)]
    blobs = [suffix.front_coded([(s, b"", 0, i) for i, s in enumerate(r)]) for r in runs]
    got = list(suffix.merged([suffix.read_run(b) for b in blobs]))
    assert [g[1][0] for g in got] == sorted(s for r in runs for s in r)
    for (_, a, _), (_, b, p) in zip(got, got[1:], strict=False):
        assert p == suffix.common_prefix(a[0], b[0], 0)


def test_remove_repeats_keeps_columns(spark):
    passage = "a passage of text that stands in two documents and is longer than it may be, " * 4
    texts = ["own words first " + passage, passage + " other words last", "untouched", None, passage, "copy" * 60, "copy" * 60]
    docs = documents(spark, texts).selectExpr("*", "1 as _null", "2 as _KEY", "3 as _kept", "4 as kept", "5 as n")
    got = suffix.remove_repeats(docs)
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert kept[2] == "untouched" and kept[3] is None and 4 not in kept and 5 not in kept
    assert kept[0].startswith("own words first") and len(kept[0]) < 60
