"""Packing, mixing and language ID: exact round trips, rules, held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftworks.llm import langid, mixing, packing
from siftworks.llm.common import load_tokenizer, tokenizer_path
from siftworks.llm.queries import ORACLE
from tests.llm.helpers import AWKWARD, documents

# packing


def check_packed(rows, texts, size=4096):
    tok = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at < size and at & (at - 1) == 0
    return by_seq


def test_packing_round_trip(spark, sf_dir):
    texts = [*AWKWARD, "word " * 20000, "É à ǅ İ ΑΣ ΑΣΑ", "it's 12ab'll", *(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    seqs = check_packed(rows, texts)
    short = [s for s in seqs.values() if sum(r.length for r in s) < 4096]
    assert len(short) <= 12


@pytest.mark.parametrize("windows", [1, 3])
def test_packing_in_small_windows(spark, windows):
    texts = [f"a{i} " * (i % 37) for i in range(200)]
    check_packed(packing.pack_documents(documents(spark, texts).repartition(9), size=64, windows=windows, fan_in=3).collect(), texts, 64)


def test_packing_of_little(spark):
    assert packing.pack_documents(documents(spark, [])).count() == 0
    (row,) = packing.pack_documents(documents(spark, [None], [None])).collect()
    assert (row.doc_id, row.start, row.length, row.doc_tokens, row.offset) == (None, 0, 1, 1, 0)


def test_packer_is_best_fit_and_bounded():
    packer = packing.Packer(10, 2, 0)
    ids = lambda n: b"\0\0\0\0" * n
    assert list(packer.add(1, 0, ids(4), 4)) == []
    assert list(packer.add(2, 0, ids(7), 7)) == []  # gaps 6 and 3
    full = list(packer.add(3, 0, ids(3), 3))  # fills the gap of 3, not that of 6
    assert [r[0] for r in full] == [2, 3]
    list(packer.add(4, 0, ids(9), 9))
    cut = list(packer.add(5, 0, ids(8), 8))  # no gap: the fullest takes one token
    assert [(r[0], r[1], r[2]) for r in cut] == [(4, 0, 9), (5, 0, 1)] and len(packer.open) == 2


# mixing


def oracle(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64", "text": "object"})  # noqa: F841
    return duckdb.sql(ORACLE["op10_mixing"]).fetchall()


def test_mixing_matches_sql_and_its_rules(spark):
    draw = random.Random(1)
    sources = ["zz", "a", "Z", None, "é", "tiny", "b"]
    rows = []
    for i in range(900):
        s = "zz" if i % 3 == 0 else draw.choice(sources)
        n = 3 if s == "tiny" else draw.choice([0, 1, 50, 400, 3000 if i % 100 == 0 else 20])
        rows.append((i, " ".join("w" for _ in range(n)) if n or i % 2 else None, s))
    docs = documents(spark, [r[1] for r in rows], [r[0] for r in rows], sources=[r[2] for r in rows])
    got = mixing.mix_documents(docs).collect()
    assert sorted(map(tuple, got)) == sorted(oracle(rows))
    size, target, taken = {}, {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        source = rows[r.doc_id][2]
        size[source], target[source] = r.source_size, r.target
        taken[source] += r.taken
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    level = max(target[s] / weight[s] for s in size)
    for s in size:
        assert target[s] <= 3 * size[s] and (abs(target[s] - 3 * size[s]) < 1e-6 or abs(target[s] - level * weight[s]) < 1e-6 * level)
        assert abs(taken[s] - target[s]) <= max(64, 0.02 * target[s])
    assert sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect())) == sorted(map(tuple, got))


def test_mixing_of_shards(spark):
    """Of many small shards, with few ids, null ones and a source without words, each source comes to its seats."""
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 2]), " ".join(draw.choice("uvw") for _ in range(i % 50)), "abc"[min(2, i % 7)]) for i in range(300)] + [(i, None, "none") for i in range(40)]
    docs = documents(spark, [r[1] for r in rows], [r[0] for r in rows], sources=[r[2] for r in rows])
    got = mixing.mix_documents(docs.withColumnRenamed("size", "Size"), shard_words=200, shard_rows=7, block=16, seat=4).collect()
    by = defaultdict(Counter)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source_size].update(taken=r.taken, n=1)
        by[r.source_size]["target"] = r.target
    assert all(abs(c["taken"] - c["target"]) <= 4 for c in by.values()) and len(by) == 4


@pytest.mark.parametrize("house", [0, 1, 9, 100, 3777])
def test_seats_go_to_the_highest_quotients(spark, house):
    draw = random.Random(house)
    targets = [float(draw.choice([0, 1, 5, 5, 40, 900, 900, 12345])) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(targets, 1)), "place long, target double")
    got = {r.place: r.seats for r in mixing.apportioned(rows, house, sum(targets)).collect()}
    want = dict.fromkeys(got, 0)
    for _ in range(house):
        best = max(want, key=lambda p: (targets[p - 1] / (2 * want[p] + 1), -p))
        want[best] += 1
    assert got == want


def test_running_totals_over_ranges(spark):
    values = [random.Random(9).randint(0, 50) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, v long").repartition(5)
    got = sorted((r.k, r._rank, r._before_v) for r in mixing.running(rows, [F.col("k").desc()], ["v"], "t").collect())
    assert got == [(k, 200 - k, sum(values[k + 1 :])) for k in range(200)]


def test_mixing_of_little(spark):
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    got = mixing.mix_documents(documents(spark, [None, "", " "], [None, None, 1], sources=[None, "a", "a"])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3


def test_mixed_texts_are_the_taken_words(spark):
    texts = [*AWKWARD, *(f"w{i} " * 200 for i in range(60))]
    docs = documents(spark, texts, sources=["ab"[i % 2] for i in range(len(texts))])
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(docs).collect()}
    got = mixing.mixed_texts(docs)
    assert got.columns == docs.columns
    assert {(r["size"], r.target, r.m, r.key) for r in got.collect()} == {("x", "t", 1, "k")}  # not the operator's own
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t or "")
    held = defaultdict(Counter)
    for r in got.collect():
        held[r.doc_id].update(words(r.text))
        assert r.n_chars == len(r.text) and not Counter(words(r.text)) - Counter(words(texts[r.doc_id]))
    assert {d: n for d, n in taken.items() if n} == {d: c.total() for d, c in held.items()}


# language ID


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = langid.identify_language(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and any(c.isalpha() for c in truth[r.doc_id][1])]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    # labels, sources and ids are no inputs of a prediction
    from pyspark.sql import functions as F

    other = docs.select(F.col("doc_id"), "text", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")).alias("lang"))
    assert sorted(map(tuple, langid.identify_language(other).collect())) == sorted(map(tuple, got))


def test_language_of_awkward_texts(spark):
    langs = ["en" if i % 2 else "de" for i in range(len(AWKWARD))]
    got = {r.doc_id: r for r in langid.identify_language(documents(spark, AWKWARD, langs=langs)).collect()}
    for i, t in enumerate(AWKWARD):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    got = langid.identify_language(documents(spark, ["abc", None], [None, None])).collect()
    assert [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in got] == [(None, False, "und", 0.0)] * 2
    assert langid.identify_language(documents(spark, [])).count() == 0


def test_letters_are_of_category_l():
    import unicodedata

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 1 << 17)]))
    small = {c for x in every for c in x.lower()}
    assert set("".join(langid.words_of(every))) == {c for c in small if unicodedata.category(c)[0] == "L"}
    assert langid.words_of("Abc½d ² e3f") == ["abc", "d", "e", "f"]


def test_sample_is_shared_among_languages(spark):
    texts = [f"wort {i}" for i in range(900)] + [f"word {i}" for i in range(20)] + ["rare"] * 5
    docs = documents(spark, texts, langs=["de"] * 900 + ["en"] * 20 + ["xx"] * 5)
    _, langs = langid.training_sample(docs, rows=30)
    assert Counter(langs)["de"] == 10 and 0 < Counter(langs)["en"] <= 10 and 0 < Counter(langs)["xx"] <= 5


def test_no_language_is_left_out(spark):
    names = [f"l{i:02}" for i in range(90)]
    docs = documents(spark, [f"{n}x " * 4 for n in names for _ in range(6)], langs=[n for n in names for _ in range(6)])
    texts, langs = langid.training_sample(docs, rows=200)
    assert len(set(langs)) == 90 and len(texts) <= 200


def test_identified_rows_keep_their_columns(spark):
    docs = documents(spark, ["the quick fox", "½² ①", None], langs=["en", "en", None]).selectExpr("*", "'a' as _said", "'b' as _lang", "'c' as _score", "'d' as lang_pred")
    got = langid.keep_identified(docs)
    assert got.columns == docs.columns
    assert [(r.doc_id, r._said, r._lang, r._score, r.lang_pred) for r in got.collect()] == [(0, "a", "b", "c", "d")]


def test_forward_backward_in_stretches_is_exact():
    draw = np.random.default_rng(1)
    model = langid.Crf(["a", "b", "c"], np.zeros((1, 3)), draw.normal(size=(3, 3)))
    lengths = np.array([1, 5, 64, 65, 200, 3])
    scores = draw.normal(size=(lengths.sum(), 3)) * 2
    got, got2 = model.posteriors(scores, lengths), model.posteriors(scores, lengths, stretch=7)
    at = 0
    for i, n in enumerate(lengths):
        phi, trans = np.exp(scores[at : at + n]), np.exp(model.steps)
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        a = np.ones(3) / 3
        for t in range(n):
            a = a @ trans * phi[t]
            a = alpha[t] = a / a.sum()
        for t in range(n - 2, -1, -1):
            b = trans @ (phi[t + 1] * beta[t + 1])
            beta[t] = b / b.sum()
        post = alpha * beta
        want = (post / post.sum(axis=1, keepdims=True)).sum(axis=0)
        assert np.allclose(got[i], want, atol=1e-6) and np.allclose(got2[i], want, atol=1e-6)
        at += n


def test_code_switched_words_are_told_apart():
    draw = random.Random(2)
    words = {"x": ["brown", "fox", "jump", "over", "lazily"], "y": ["ñandú", "cómo", "está", "después", "mañana"]}
    texts = [" ".join(draw.choice(words[g]) for _ in range(60)) for g in "xy" * 40]
    model = langid.train(texts, list("xy" * 40))
    said = ["fox", "over", "brown", "jump", "mañana", "cómo", "está", "ñandú", "fox", "brown"]
    mass = model.posteriors(model.scores(said), np.array([10]))[0]
    assert model.labels == ["x", "y"] and abs(mass[0] - 6) < 0.8


def test_words_encode_alone_as_in_their_text():
    tok = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    texts = ["a <|endoftext|>b c<|startoftext|> d", "\u0301x e\u0301 \u0130stanbul   ' 's", "", "  ", "<|endoftext|>", "don't 123abc \U0001f600x\x00y\xa0z", "a b a\nb"]
    for most in (0, 3, 1000):
        coder = packing.WordEncoder(tokenizer_path("word_bpe_49k.json"), 2, most)
        for _ in range(2):
            for text, coded in zip(texts, coder.encode(texts, budget=8), strict=True):
                assert coded == packing.pack_ids([*tok.encode(text, add_special_tokens=False).ids, 2])
