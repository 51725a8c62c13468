"""Search among empty vectors."""

from siftworks.llm import knn


def test_empty_vectors_score_zero_among_each_other(spark):
    rows = [(0, []), (1, []), (2, []), (50, [1.0]), (51, [2.0]), (100, None)]
    got = knn.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 0), (50, 1, 51, 131072)]
