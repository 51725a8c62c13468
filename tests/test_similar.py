"""Similar aliases by prefix filters against all pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftworks.operators import semantic, similar


def plain_dice(a, b):
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


@pytest.mark.parametrize("threshold", [0.2, 0.45, 0.8, 1.0])
def test_all_pairs(spark, threshold):
    draw = random.Random(threshold)
    word = lambda: "".join(draw.choices("abcé_", k=draw.randrange(14)))
    names, aliases = [word() for _ in range(150)], [word() for _ in range(180)]
    names += [None, "", "a", "aaaaaaa", *aliases[:9]]
    aliases += [None, "", "a", "aaaa", "aaaaaaaaaaaa", *aliases[:5]]
    got = similar.similar_names(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in aliases], "alias string"), threshold).collect()
    want = {(a, b): s for a in names if a is not None for b in aliases if b is not None if (s := plain_dice(a, b)) >= threshold}
    assert len(got) == len(want)
    assert {(r.name, r.alias): r.score for r in got} == pytest.approx(want)


def test_no_names_and_no_threshold(spark):
    none = spark.createDataFrame([], "name string, alias string")
    assert similar.similar_names(none, none).count() == 0
    with pytest.raises(ValueError):
        similar.similar_names(none, none, 0)


def test_a_registry_finds_what_the_list_does(spark):
    words = ["email_adress", "mail", "full_nam", "phone_no", "e_mail_id", "contct_number", "x", "", "state_of_lead", "lead_owner", "citty", "creation_date"]
    headers = spark.createDataFrame([("u", i, w) for i, w in enumerate(words)], "upload_id string, column_index int, normalized string")
    rows = lambda df: sorted(map(repr, df.withColumn("score", F.round("score", 9)).collect()))
    want = rows(semantic.match_headers(headers))
    assert len(want) > 10
    assert rows(semantic.match_headers(headers, registry=semantic.alias_table(spark))) == want


def test_many_aliases(spark):
    aliases = spark.range(100_000).select(F.concat(F.lit("column_"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8)).alias("alias"), F.col("id").cast("string").alias("field_id"), F.col("id").alias("alias_order"))
    some = [r.alias for r in aliases.limit(5).collect()]
    headers = spark.createDataFrame([("u", i, w[:-1] + "z") for i, w in enumerate(some)], "upload_id string, column_index int, normalized string")
    got = semantic.match_headers(headers, threshold=0.9, registry=aliases).collect()
    assert {(r.column_index, r.matched_alias) for r in got} >= set(enumerate(some))
