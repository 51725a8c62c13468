"""The pipeline's stages against plainer versions of them, one after the other."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from siftworks.llm import langid, simhash
from siftworks.llm.common import load_tokenizer, tokenizer_path
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_suffix import brute


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "packing"]
    docs, kept = raw, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == raw.columns and [f.dataType for f in docs.schema] == [f.dataType for f in raw.schema]
        rows = docs.collect()
        kept.append(rows)
        docs = spark.createDataFrame(rows, raw.schema).repartition(3)
    told, single, cut, mixed = kept

    said = {r.doc_id: r for r in langid.identify_language(raw).collect()}
    assert {r.doc_id for r in told} == {d for d, r in said.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert len(told) > 0.97 * raw.count()

    grams = {r.doc_id: shingles(r.text) for r in told}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    left = {r.doc_id for r in single}
    assert left <= set(grams)
    for a in left:
        assert all(alike(a, b) < 0.8 for b in left if b != a)
    for a in set(grams) - left:
        assert any(alike(a, b) >= 0.7 for b in grams if b != a)

    for r, (n, gone, _, _) in zip(single, brute([r.text for r in single], 200), strict=True):
        after = [x.text for x in cut if x.doc_id == r.doc_id]
        assert after == [] if gone == n else len(after[0].encode()) <= n - gone and len(after[0].encode()) >= n - gone - 6
        assert gone or after == [r.text]

    size, taken = Counter(), Counter()
    source = {r.doc_id: r.source for r in cut}
    for r in cut:
        size[r.source] += len(words(r.text))
    for r in mixed:
        taken[source[r.doc_id]] += len(words(r.text))
    order = sorted(size)
    total, weight = sum(size.values()), {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] >= 3 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    assert all(abs(taken[s] - target[s]) <= max(64, 0.03 * target[s]) for s in order)

    tok = load_tokenizer(tokenizer_path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    got, seqs = Counter(), defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        seqs[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for texts in ([], AWKWARD):
        docs = documents(spark, texts, langs=["en"] * len(texts), sources=[None if i % 4 else "s" for i in range(len(texts))])
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_similar_texts_meet(spark):
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join([*base[:150], "x", *base[150:]]), " ".join([*base[:100], *base[110:]]), " ".join(f"v{i}" for i in range(300)), "", None, "a b", "a b c"]
    got = {r.doc_id: r.component_id for r in simhash.similar_components(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_near_duplicates_are_those_of_fingerprints_and_of_shingles(spark, sf_dir):
    # one word over and over, with an end of its own: equal fingerprints, few shingles in common
    texts = [" ".join(["on"] * 40 + [f"{c}{i}" for i in range(6)]) for c in "abc"]
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (104, 87)]  # 0.83 of the shingles
    texts += [" ".join(f"v{i}" for i in range(9)), "on", "a b"]
    docs = documents(spark, texts)
    fps = [simhash.simhash(t.encode()) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 3 and (fps[3] ^ fps[4]).bit_count() > 3
    root = list(range(len(texts)))
    for i, t in enumerate(texts):
        for j in range(i):
            a, b = shingles(t), shingles(texts[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or 5 * len(a & b) >= 4 * len(a | b):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert root[:5] == [0, 0, 0, 3, 3]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == set(root)
