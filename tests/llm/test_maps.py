"""Operators that are maps over rows, held against plainer versions."""

import hashlib
import math
import re

import numpy as np
import pytest

from siftworks.llm import minhash, tokens, urlfilter
from siftworks.llm.common import load_tokenizer, tokenizer_path
from tests.llm.helpers import AWKWARD, documents


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(spark, sf_dir):
    return [r.text for r in table(spark, sf_dir, "documents").collect()]


# token counts


def test_token_counts_are_the_librarys(spark, sf_dir):
    texts = [*AWKWARD, *texts_of(spark, sf_dir), "a  b\n c \n\nd  ", "it's we'll 'S ’s", " a b", "tab\t x\ty", "x\x1c y"]
    tok = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in tokens.count_tokens(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), t


def test_token_counts_forget_without_change():
    counter = tokens.PieceCounter(tokenizer_path("byte_bpe_50k.json"), most=3)
    texts = ["the quick brown fox", "jumps over\nthe lazy dog", "the quick"]
    tok = load_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert counter.count(texts, budget=10) == [len(tok.encode(t).ids) for t in texts]


# URL filters

RULES = [urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"), urlfilter.Rule("block", "x*.net", "/a?c/*/z")]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule in RULES:
        glob = lambda s: "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in s)
        if re.match(rf"(?:[^/]*\.)?{glob(rule.host)}\Z", host, re.S) and re.match(glob(rule.path), path, re.S) and (best is None or len(rule.name) > len(best.name)):
            best = rule
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "https://Example.COM/en/7x?q#f", "http://a.b.com/en/", "http://com/en/1", "http://xcom/en/1", "http://notexample.com/en/7", "http://org/www.com/en/1", "http://q.xyz.net/abc/mid/zz", "http://xyz.net/a/c/mid/z", "http://com#/en/", "http://com/EN/", "http://a.com/" + "e" * 5000, "x://é.com/en/ü", "http://com:80/en/", "http://a://com/en/"]


def test_urls_against_regular_expressions(spark, sf_dir):
    urls = URLS + [r.url for r in table(spark, sf_dir, "pages").collect()] + URLS[:3]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'h' as host", "'r' as rule", "1 as verdict")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(rows, RULES).collect()}
    assert [got[i] for i in range(len(urls))] == [plain(u) for u in urls]


def test_automaton_of_many_words():
    rules = [urlfilter.Rule("block", f"host{i}.example", f"/path/{i}/") for i in range(100)]
    auto = urlfilter.GlobAutomaton(rules)
    assert auto.words > 30
    urls = [f".www.host{i}.example/path/{i}/x".encode() for i in range(100)] + [b".host1.example/path/2/"]
    assert [auto.rules[k].name if k >= 0 else None for k in auto.match(urls)] == [r.name for r in rules] + [None]


def test_no_rules_and_empty_table(spark):
    rows = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(rows, RULES).count() == 0
    rows = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert urlfilter.filter_urls(rows, []).first().verdict == "allow"


# fingerprints


def shingles(text, k=5):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_and_edits(spark, sf_dir):
    texts = [t or "" for t in [*AWKWARD, *texts_of(spark, sf_dir)]]
    ids = [3 * i - 7 for i in range(len(texts))]
    got = {r.doc_id: r for r in minhash.compare_with_edits(documents(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), reverse=True)
    errors = []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = texts[i], texts[j], got[ids[i]]
        edit = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        errors += [r.near_edited - jaccard(t, edit), r.near_next - jaccard(t, u)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert got[ids[i]].fingerprint == next(got[ids[k]].fingerprint for k in order if texts[k] == t)
    assert abs(np.mean(errors)) < 0.01 and np.sqrt(np.mean(np.square(errors))) < 0.03


def test_fingerprint_estimates_are_unbiased():
    draw = np.random.default_rng(1)
    maker = minhash.OnePermutation()
    for size in (3, 30, 600):
        errors = []
        for _ in range(60):
            common = [f"c{x}" for x in draw.integers(0, 10**9, size)]
            a, b = ([*common, *(f"{s}{x}" for x in draw.integers(0, 10**9, size // 2))] for s in "ab")
            single = minhash.OnePermutation(shingle=1)
            x, y = single.signatures([" ".join(a).encode(), " ".join(b).encode()])
            errors.append(maker.likeness(x, y) - len(set(a) & set(b)) / len(set(a) | set(b)))
        assert abs(np.mean(errors)) < 3.5 * np.std(errors) / math.sqrt(len(errors)) + 0.01


@pytest.mark.parametrize("ids", [[None, 5, 5, 1], [7, 7, 7, 7], [None] * 4])
def test_fingerprints_with_ties_and_null_ids(spark, ids):
    """Rows of one id stand by the hash of their text; repeated ones are rows of their own."""
    texts = ["b b", "c c c c", "a a", None]
    texts, ids = texts + texts[:2], ids + ids[:2]
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    got = minhash.compare_with_edits(documents(spark, texts, ids)).collect()
    want = sorted(zip([-(1 << 63) if i is None else i for i in ids], [t or "" for t in texts], strict=True), key=lambda x: (-x[0], hashed[x[1]]))
    edits = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() for (_, t), (_, u) in zip(want, want[1:] + want[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == edits
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i in ids)


def test_fingerprints_of_a_hot_id(spark):
    """Rows of one id go to many ranges, and none is lost between them."""
    texts = [f"text {i} of many words " * (1 + i % 7) for i in range(400)]
    hashed = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    got = minhash.compare_with_edits(documents(spark, texts, [3] * 300 + [None] * 100)).collect()
    order = [*sorted(texts[:300], key=hashed.get), *sorted(texts[300:], key=hashed.get)]
    edits = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)


def test_fingerprints_of_few_rows(spark):
    assert minhash.compare_with_edits(documents(spark, [])).count() == 0
    (row,) = minhash.compare_with_edits(documents(spark, ["abcd"])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert minhash.fingerprint_documents(documents(spark, ["", "a"])).count() == 2
