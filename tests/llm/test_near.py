"""SimHash, components, search and chat against brute force."""

import random

import numpy as np
import pytest
import xxhash

from siftworks.llm import chat, components, knn, simhash
from siftworks.llm.queries import ORACLE
from tests.llm.helpers import AWKWARD, documents


def plain_print(text, k=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=3):
    best = list(range(len(ids)))
    for _ in range(len(ids)):
        before = list(best)
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius:
                    best[i] = min(best[i], best[j])
        if best == before:
            break
    return best


def test_fingerprints_match_definition(spark):
    texts = [*AWKWARD, "One two THREE four", "É é ÀB c d e"]
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_print(t) for t in texts]


@pytest.mark.parametrize("large", [512, 4])
def test_links_connect_what_brute_force_connects(spark, large):
    draw = random.Random(large)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for _ in range(draw.randint(0, 6)):
            q = p
            for b in draw.sample(range(64), draw.randint(0, 5)):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    rows = spark.createDataFrame([((p ^ 1 << 63) - (1 << 63),) for p in prints], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.near_links(rows, large=large).collect()]
    assert all(bin(a ^ b).count("1") >= 1 for a, b in links)
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert [root[p] for p in prints] == [prints[i] for i in plain_components(prints, prints)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (130, 129)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 40 else 100 if i <= 130 else 200 for i in {x for e in edges for x in e}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_components(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    texts = [*AWKWARD, *(r.text for r in rows)]
    got = {r.doc_id: r for r in simhash.near_components(documents(spark, texts)).collect()}
    prints = [plain_print(t) for t in texts]
    want = plain_components(list(range(len(texts))), prints)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.near_components(documents(spark, [])).count() == 0


def test_null_ids_and_repeated_rows(spark):
    got = simhash.near_components(documents(spark, ["a b c", "a b c", "x y z w", None], [None, 4, None, 9])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, 4), (4, 4), (None, None), (9, 9)], key=str)


# search


def plain_search(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in dict.fromkeys((i, tuple(v)) for i, v in good):
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "block": 20, "chunk": 2}])
def test_search(spark, options):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + draw.normal(size=8) * 0.1]) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(30)] + [(100, rows[100][1]), (100, rows[7][1]), (150, rows[3][1]), (3, rows[3][1])] + [(600, None), (650, [None] * 8), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (None, rows[1][1]), (800, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as far")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in knn.search_embeddings(df, **options).collect())
    assert got == plain_search(rows)


def test_search_of_little(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.search_embeddings(df).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in knn.search_embeddings(df).collect()] == [(0, 1, 1, 256 * 512)]


# chat


def plain_chats(rows):
    said = {}
    key = lambda r: tuple((x is not None, x) for x in (r[1], r[2], r[3]))
    for r in sorted(rows, key=key):
        said.setdefault(r[0], []).append((r[2], r[3]))
    order = sorted(said, key=lambda c: (c is None, c))
    keep = []
    for c in order:
        if any(d != c and len(said[d]) > len(said[c]) and said[d][: len(said[c])] == said[c] for d in order):
            continue
        if any(said[d] == said[c] for d in order[: order.index(c)]):
            continue
        keep.append(c)
    return {(c, i, *t, len(said[c])) for c in keep for i, t in enumerate(said[c])}


@pytest.mark.parametrize("span", [2, 256])
def test_chat_snapshots(spark, span):
    draw = random.Random(span)
    rows = []
    for c in range(60):
        base = draw.randint(0, 8)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{base} {t}") for t in range(draw.randint(1, 9))]
    rows += [(None, 0, "user", "0 0"), (None, 0, None, None), (100, None, "user", None), (101, None, "user", ""), (102, 5, "user", "0 0"), (102, 5, "user", "0 0"), (103, 1, "assistant", "0 0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "'x' as n_turns", "2 as _a")
    got = chat.render(chat.collapse_snapshots(df, span)).collect()
    assert {(r.conv_id, r.position, r.role, r.text, r.n_turns) for r in got} == plain_chats(rows)
    assert len(got) == len({(r.conv_id, r.position) for r in got})
    assert all(r.segment == f"<|{r.role or 'user'}|>\n{r.text or ''}\n" and r.learned == (r.role == "assistant") for r in got)


def test_chat_of_empty_table(spark):
    assert chat.collapse_snapshots(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_oracles_are_for_registered_queries():
    from siftworks.llm.queries import QUERIES

    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("pivots", [None, 16, 10_000])
def test_search_with_many_rows_of_each_query_id(spark, pivots):
    """The query's own rows fill cells and are no candidates."""
    draw = np.random.default_rng(4)
    data = [(i, draw.integers(-256, 257, 8).tolist()) for i in range(400)]
    asked = [(i, v) for i, v in data if i % 20 == 0]
    rows = data + [(i, [x * 3 for x in v]) for i, v in asked for _ in range(10)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    queries = spark.createDataFrame(asked, "vec_id long, vector array<long>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(table, queries, pivots=pivots).collect()}
    for i, v in asked:
        best = sorted((-int(np.dot(v, w)), j) for j, w in rows if j != i)[:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, -x) for x, j in best]
