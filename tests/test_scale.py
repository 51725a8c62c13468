"""Plans stay small, and work is dealt to many tasks whatever the files are cut into."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from siftworks.functions import text
from siftworks.llm import packing
from siftworks.llm.common import load_tokenizer, tokenizer_path
from siftworks.plans import imports, leads, queries, semantics  # noqa: F401  (they register their queries)
from siftworks.plans.registry import QUERIES
from siftworks.sources import large


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_of_an_answer_are_not_repeated(spark):
    got = spark.createDataFrame([("So: [1] or",)], "a string").select(F.array_join(text.answer_diagnostics(F.col("a")), ",").alias("codes"), text.json_candidate(F.col("a")).alias("candidate"), text.answer_problem(F.col("a")).alias("problem"))
    assert tuple(got.first()) == ("SURROUNDING_TEXT_STRIPPED", "[1]", None)
    assert planned(got).count("regexp_extract") <= 3  # one for each of the three; thousands when each step repeats the one before


def test_leads_are_dealt_to_all_cores(spark, sf_dir):
    assert leads.leads(spark, sf_dir).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


#: Queries that do all their work on leads.
ON_LEADS = ["normalize_cells", "batch_summaries", "trust_records", "import_outcome", "enum_warnings", "extract_records", "decision_reasons", "batch_results", "business_rules", "incremental_summary", "column_semantics", "classifier_evidence", "execution_metrics", "outcome_ledger", "report_warnings"]


@pytest.mark.parametrize("name", ON_LEADS)
def test_tasks_of_leads_grow_with_the_rows(spark, sf_dir, monkeypatch, name):
    rows = leads.table(spark, sf_dir, "customer").count()
    monkeypatch.setattr(leads, "TASK_ROWS", 10)
    group, sc = uuid.uuid4().hex, spark.sparkContext
    sc.setJobGroup(group, name)
    try:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= rows / 10 > 2 * sc.defaultParallelism


def test_words_are_kept_apart_by_a_plain_sign():
    path = tokenizer_path("word_bpe_49k.json")
    coder, tok = packing.WordEncoder(path, 2), load_tokenizer(path)
    assert coder.mark.strip() not in {t.content for t in tok.get_added_tokens_decoder().values()}
    special = next(t.content for t in tok.get_added_tokens_decoder().values())
    texts = ["it's | a|b ||", f"x{special}y {special} z", "́a é ΣΑΣ İI", "\t \x0b.  b　c", "don't 'twas 12 3.4 中文!?", "~ ^ ` \\ a~b", ""]
    assert list(coder.encode(texts)) == [packing.pack_ids([*tok.encode(t, add_special_tokens=False).ids, 2]) for t in texts]


def test_plain_words_take_the_cheap_steps():
    path = tokenizer_path("word_bpe_49k.json")
    coder, tok = packing.WordEncoder(path, 2), load_tokenizer(path)
    signs = [chr(i) for i in range(33, 0x250)]
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices(signs if n % 3 else signs[:94], k=draw.randint(1, 9))) for _ in range(300)) for n in range(30)]
    assert list(coder.encode(texts)) == [packing.pack_ids([*tok.encode(t, add_special_tokens=False).ids, 2]) for t in texts]
    coder.tok = None
    assert list(coder.encode(["Émile (a-b), C++... ÀÖß"])) == [packing.pack_ids([*tok.encode("Émile (a-b), C++... ÀÖß", add_special_tokens=False).ids, 2])]


def test_small_ranges_share_a_task(spark, tmp_path):
    (tmp_path / "f.csv").write_text("".join(f'{i},"a\n{i}"\n' for i in range(5000)))
    with large._splits(spark, 512):
        lines = spark.read.text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 100
        assert large._grouped(lines, 512).rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = large.read_large(spark, str(tmp_path), 512).collect()
    assert sorted((r.ordinal, *r.raw_cells) for r in got) == [(i, str(i), f"a\n{i}") for i in range(5000)]


def test_steps_of_trust_are_not_repeated(spark, sf_dir):
    got = planned(QUERIES["trust_records"](spark, sf_dir))
    assert got.count("ascii(") <= 40 and got.count("levenshtein(") <= 9  # 432 and 18 when each step repeats the one before
