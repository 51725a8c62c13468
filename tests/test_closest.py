"""The closest term, found by an index, is the one a comparison with every term finds."""

import random

import pytest

from siftworks.operators import closest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_closest_is_brute_force(spark, most):
    draw = random.Random(most)
    word = lambda: "".join(draw.choices("abcdé", k=draw.randrange(13)))
    terms = [(word(), draw.randrange(30)) for _ in range(150)] + [("Zz", 5), (None, 1), ("", 9)]
    values = []
    for _ in range(160):
        x = list(draw.choice(terms)[0] or word())
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(x) + 1)
            x[at : at + draw.randrange(2)] = draw.choice(["", "a", "x"])
        values.append("".join(x))
    values += [None, "", "z", "xyz", "Zz ", "a b-c"]
    got = closest.closest_terms(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(terms, "term string, place int"), most)
    found = {r.value: (r.closest, r.distance) for r in got.collect()}
    least = {}
    for t, p in terms:
        if t is not None:
            least[t] = min(p, least.get(t, p))
    assert set(found) == set(values)
    for v in set(values) - {None}:
        plain = v.strip().lower().replace(" ", "_").replace("-", "_")
        best = min((distance(plain, t.lower()), p, t) for t, p in least.items())
        assert found[v] == ((best[2], best[0]) if best[0] <= most else (None, None)), v
    assert found[None] == (None, None)
