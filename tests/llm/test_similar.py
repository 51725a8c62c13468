"""Near-duplicate stage: exact at the threshold, whole in large families, no row lost to its id."""

import random
from collections import Counter

import pytest

from siftworks.llm import ngrams, simhash
from tests.llm.helpers import documents
from tests.llm.test_pipeline import shingles


def brute(texts):
    """The smallest index each text reaches over links of a similarity of 0.8 or more."""
    grams, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i in range(len(texts))}


def test_links_begin_at_exactly_the_threshold(spark):
    texts, want = [], {}
    for p, (few, many) in enumerate([(4, 5), (12, 15), (20, 25), (80, 100), (160, 200), (3, 4), (12, 16), (15, 19), (79, 100), (75, 100), (150, 200)] * 20):
        line = [f"p{p}w{i}" for i in range(many + 4)]  # many shingles
        want |= {len(texts): len(texts), len(texts) + 1: len(texts) + (5 * few < 4 * many)}
        texts += [" ".join(line), " ".join(line[: few + 4])]
    assert {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, texts)).collect()} == want
    assert {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, texts)).collect()} == {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("cell", [1024, 16])
def test_large_families_are_whole(spark, monkeypatch, cell):
    monkeypatch.setattr(ngrams, "ROWS", cell)
    draw = random.Random(3)
    texts = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(90):
            line = list(base)
            for _ in range(draw.randrange(6)):
                line[draw.randrange(120)] = f"n{draw.random()}"
            texts.append(" ".join(line))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, texts)).collect()}
    assert got == brute(texts) and 5 < len(set(got.values())) < len(texts)


def test_rows_are_kept_whatever_their_ids(spark):
    base = [f"w{i}" for i in range(60)]
    copy = [*base, "more"]
    alone = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    texts = [*alone[:5], alone[0], " ".join(base), " ".join(copy), alone[5], alone[6], " ".join([*copy, "end"])]
    ids = [None, None, None, None, None, None, 3, 7, 7, 7, None]
    want = sorted([*alone[:5], " ".join(base), alone[5], alone[6]])
    docs = documents(spark, texts, ids)
    for parts in (1, 5):
        assert sorted(r.text for r in simhash.drop_near_duplicates(docs.repartition(parts)).collect()) == want


def test_the_choice_among_rows_of_one_id_is_fixed(spark):
    texts = [" ".join([*(f"w{i}" for i in range(60)), f"end{k}"]) for k in range(6)]
    docs = documents(spark, texts, [None, 4, 4, 4, 4, 9])
    got = {tuple(simhash.drop_near_duplicates(docs.repartition(n)).collect()) for n in (1, 2, 7)}
    assert len(got) == 1 and {r.doc_id for rows in got for r in rows} == {4}


def test_links_of_documents_are_those_of_exact_similarity(spark):
    """Recall and precision over real texts: every pair at 0.8 or more, by counting shared shingles."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    grams = {r.doc_id: shingles(r.text) for r in rows}
    holders = {}
    for d in sorted(grams):
        for g in grams[d]:
            holders.setdefault(g, []).append(d)
    shared = Counter((a, b) for ds in holders.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    near = [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(grams[a]) + len(grams[b]) - n)]
    none = sorted(d for d, g in grams.items() if not g)
    near += list(zip(none, none[1:], strict=False))
    least = {d: d for d in grams}
    for _ in grams:
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert len(near) > 50
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows)).collect()}
    assert got == least


def test_columns_without_a_hash_and_null_ids_of_a_hot_text(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(None, line, {"a": 1}, "x") for _ in range(300)] + [(5, line + " more", {"b": 2}, "y"), (6, "else " * 9, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, `a.b` string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [5, 6]
    assert {(r.doc_id, r.component_id) for r in simhash.similar_components(docs).collect()} == {(None, 5), (5, 5), (6, 6)}
    assert {(r.doc_id, r.component_id) for r in simhash.near_components(docs.filter("doc_id is null or doc_id = 6")).collect()} == {(None, None), (6, 6)}
