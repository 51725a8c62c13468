"""Resampling, the divergence audit and the n-gram join against plain versions."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftworks.llm import divergence, ngrams, resample
from siftworks.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_pipeline import shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_resampling", "op12_divergence"])
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    want = con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


# resampling


def plain_sample(texts, ids, target, percent=10, least=20, sizes=(1, 1), buckets=10000, seed=2024):
    def found(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return ws, [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(ws) - n + 1)]

    own, aim = [found(t) for t in texts], Counter(b for t in target for b in found(t)[1])
    all_ = Counter(b for _, bs in own for b in bs)
    s, t = sum(all_.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((all_[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for (ws, bs), i in zip(own, ids, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = n
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_sample_is_that_of_the_definition(spark, sizes):
    draw = random.Random(5)
    words = [f"{'abcÉ'[i % 4]}{i}" for i in range(60)]
    hot = " ".join(words[:25])
    texts = [*AWKWARD, *([hot] * 60), *(" ".join(draw.choices(words, k=draw.randrange(10, 40))) for _ in range(80)), "퟿ Straße 12 x-y_z " * 12]
    ids = [None, None, *range(3, len(texts)), 3]
    texts[70] = texts[71] = texts[20]
    target = [" ".join(words[5:15]), None, "", " ".join(words[5:15]), "other words"]
    docs, aim = documents(spark, texts, ids), documents(spark, target)
    got = resample.resample_documents(docs, aim, percent=30, ngrams=sizes, buckets=500)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_sample(texts, ids, target, 30, 20, sizes, 500)
    drawn = got.filter("rank is not null").select("doc_id").distinct().count()
    kept = resample.resampled(docs, aim, percent=30, ngrams=sizes, buckets=500)
    assert kept.columns == docs.columns and kept.select("doc_id").distinct().count() == drawn


def test_sample_of_nothing(spark):
    none, some = documents(spark, ["x"]).limit(0), documents(spark, ["a b c"] * 3)
    assert resample.resample_documents(none, some).count() == 0
    assert [r.rank for r in resample.resample_documents(some, none).collect()] == [None] * 3


# divergence


def plain_audit(rows, least=10, best=10):
    terms = [(g or "", s or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for g, s, t in rows]
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for g, s, c in terms:
        held[g].update(c.keys())
        n[g, s].update(c)
        groups[g].add(s)
    out = []
    for g, sources in groups.items():
        kept = sorted((t for t, k in held[g].items() if k >= least), key=str.encode)
        counts = {s: [n[g, s][t] for t in kept] for s in sources}
        counts[None] = [sum(c) for c in zip(*counts.values(), strict=True)]
        p = {s: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c] for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            out += [(g, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            found = [(-f(x, q), t.encode(), t) for t, c, x, q in zip(kept, counts[s], p[s], p[None], strict=True) if c and x > q]
            out += [(g, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(found)[:best], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("options", [{}, {"block": 2, "width": 3}])
def test_audit_is_that_of_the_definition(spark, options):
    draw = random.Random(9)
    words = [*(f"w{chr(97 + i)}" for i in range(12)), "Ünï", "ü", "ｆ", "😀x", "é1é"]
    rows = [("en", f"s{k % 7}" if k % 3 else "hot", " ".join(draw.choices(words[: 5 + k % 12], k=9))) for k in range(220)]
    rows += [(None, None, None), ("en", None, " 12 "), ("en", "none", ""), ("", "x", "wa wb"), ("xx", "a", "only few"), ("xx", "b", None), ("one", "alone", "word " * 30)]
    rows += [("one", "alone", "word")] * 12 + [("en", "hot", "wa " * 20000)]
    texts, langs, sources = [r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows]
    got = divergence.audit_sources(documents(spark, texts, langs=langs, sources=sources), **options)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(documents(spark, ["x"]).limit(0)).count() == 0


def test_shares_are_exact():
    counts, total = np.array([0, 1, 9 * 10**14, 5]), np.array([9 * 10**14 + 6])
    assert divergence.shares(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (9 * 10**14 + 14) for c in counts]


def test_terms_of_a_task_are_flushed(spark):
    docs = documents(spark, ["a b c d", "a b", "a e"])
    rows = {(r.term, r.n, r.docs) for r in divergence.group_terms(docs, most=1).collect()}
    assert rows == {("", 0, 0), ("a", 3, 3), ("b", 2, 2), ("c", 1, 1), ("d", 1, 1), ("e", 1, 1)}


# n-gram join


def plain_components(texts, ids, percent=80):
    grams, root = [shingles(t) for t in texts], list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i, a in enumerate(grams):
            for j, b in enumerate(grams[:i]):
                if a and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    least = defaultdict(list)
    for i, r in enumerate(root):
        if ids[i] is not None:
            least[r].append(ids[i])
    return sorted(repr((ids[i], len(g), min(least[root[i]], default=None))) for i, g in enumerate(grams))


def family(draw, name, n, many, most):
    base, out = [f"{name}w{i}" for i in range(n)], []
    for _ in range(many):
        line = list(base)
        for _ in range(draw.randrange(most + 1)):
            line[draw.randrange(n)] = f"n{draw.random()}"
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize(("rows", "share"), [(1024, 0.4), (8, 0.1), (16, 1.0)])
def test_join_is_brute_force(spark, monkeypatch, rows, share):
    monkeypatch.setattr(ngrams, "ROWS", rows)
    monkeypatch.setattr(ngrams, "PIVOTS", 2)
    draw = random.Random(rows)
    passage = " ".join(f"shared{i}" for i in range(50))
    texts = [*AWKWARD]
    texts += family(draw, "a", 120, 70, 9) + family(draw, "b", 40, 30, 3) + family(draw, "c", 6, 8, 1)
    texts += [f"{' '.join(f'u{k}x{i}' for i in range(30))} {passage}" for k in range(40)]
    for p, (few, many) in enumerate([(4, 5), (12, 15), (80, 100), (3, 4), (79, 100)]):
        line = [f"p{p}w{i}" for i in range(many + 4)]
        texts += [" ".join(line), " ".join(line[: few + 4])]
    texts += [texts[30].upper().replace(" ", "\n "), *([texts[40]] * 20)]
    ids = [*range(1000, 1000 + len(texts))]
    ids[3] = ids[20] = ids[21] = None
    ids[60] = ids[61] = 7
    got = ngrams.jaccard_components(documents(spark, texts, ids), share=share)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_components(texts, ids)


def test_join_of_nothing(spark):
    assert ngrams.jaccard_components(documents(spark, ["x"]).limit(0)).count() == 0
    assert ngrams.jaccard_components(documents(spark, [None, "", "  "])).filter("component_id = doc_id and n_shingles = 0").count() == 3


@pytest.mark.parametrize(("percent", "tile", "strip", "few"), [(80, 2048, 256, 12), (80, 3, 2, 2), (50, 7, 5, 4), (95, 16, 3, 12)])
def test_products_list_the_pairs_of_the_definition(percent, tile, strip, few):
    draw = random.Random(percent + tile)
    sets = []
    for _ in range(12):
        base = [draw.getrandbits(63) for _ in range(draw.randrange(1, 40))]
        for _ in range(draw.randrange(1, 9)):
            sets.append({*draw.sample(base, draw.randrange(max(1, len(base) // 2), len(base) + 1)), *(draw.getrandbits(63) for _ in range(draw.randrange(3)))})
    sets += [set(), {1}, {1}]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    x, y = ngrams.near_pairs(arrays, percent, None, tile, strip, few)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert sorted((max(p), min(p)) for p in zip(x.tolist(), y.tolist(), strict=True)) == sorted(want)


def test_join_links_the_documents_that_counting_links(spark):
    """All pairs of real texts by counting shared shingles, links and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    grams = {r.doc_id: shingles(r.text) for r in rows}
    holders = defaultdict(list)
    for d in sorted(grams):
        for g in grams[d]:
            holders[g].append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    near = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(grams[a]) + len(grams[b]) - n)]
    least = {d: d for d in grams}
    for _ in grams:
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    got = ngrams.jaccard_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {d: (len(grams[d]), least[d]) for d in grams}
    assert len(near) > 50 and got.filter(F.col("component_id") != F.col("doc_id")).count() > 20
