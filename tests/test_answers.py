"""Answers that are asked for once, whatever stops the runs."""

import os

import pytest

from siftworks.operators import answers


def asked(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def logging_provider(folder, bad=(), answer='{{"k": "{}"}}'):
    def provider(prompt):
        fd, _ = __import__("tempfile").mkstemp(dir=folder)
        with os.fdopen(fd, "w") as f:
            f.write(prompt)
        if prompt in bad:
            raise RuntimeError("busy")
        return answer.format(prompt)

    return provider


def test_each_prompt_once(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    rows = [(f"b{i}", f"p{i}") for i in range(20)] + [("b3", "p3"), (None, "null batch"), ("b0", None)]
    prompts = spark.createDataFrame(rows, "batch_id string, prompt string")
    answers.ask(prompts.filter("batch_id < 'b15'"), logging_provider(str(log), bad={"p1"}), path)
    answers.ask(prompts, logging_provider(str(log)), path, attempt=2)
    answers.ask(prompts, logging_provider(str(log)), path, attempt=3)
    want = sorted([f"p{i}" for i in range(20)] + ["p1", "null batch", ""])
    assert asked(str(log)) == want
    got = {(r.batch_id, r.prompt): (r.attempt, r.answer) for r in answers.answered(prompts, path).collect()}
    assert len(got) == 22 and got["b1", "p1"] == (2, '{"k": "p1"}') and all(a for _, a in got.values())
    changed = spark.createDataFrame([("b1", "other")], prompts.schema)
    assert answers.answered(changed, path).first().attempt is None


def test_a_stopped_run_keeps_whole_waves(spark, tmp_path, monkeypatch):
    log, path = tmp_path / "log", str(tmp_path / "kept")
    log.mkdir()
    prompts = spark.createDataFrame([(f"b{i}", f"p{i}") for i in range(40)], "batch_id string, prompt string")
    plain, turns = answers._latest, []

    def stop(spark, path):
        turns.append(1)
        if len(turns) == 3:
            raise KeyboardInterrupt
        return plain(spark, path)

    monkeypatch.setattr(answers, "_latest", stop)
    with pytest.raises(KeyboardInterrupt):
        answers.ask(prompts, logging_provider(str(log)), path)
    monkeypatch.undo()
    first = len(asked(str(log)))
    assert 0 < first < 40
    answers.ask(prompts, logging_provider(str(log)), path, attempt=2)
    assert asked(str(log)) == sorted(f"p{i}" for i in range(40))


def test_records_and_report(spark):
    rows = [("a", "p", 1, 'So: [{"k": 1}, {"k": 2}]', None), ("b", "p", 1, "no", None), ("c", "p", 1, None, "E: x"), ("d", "p", None, None, None), ("e", "p", 1, " ", None), ("f", "p", 1, '{"k": 9}', None)]
    got = answers.split_answers(spark.createDataFrame(rows, "batch_id string, prompt string, attempt long, answer string, error string"), "struct<k:long>")
    assert sorted(map(tuple, got["records"].collect())) == [("a", 1), ("a", 2), ("f", 9)]
    report = {r.batch_id: (r.status, r.problem, r.record_count) for r in got["report"].collect()}
    assert report == {"a": ("completed", None, 2), "b": ("failed", "JSON_PARSE_FAILED", 0), "c": ("failed", "PROVIDER_ERROR", 0), "d": ("failed", "NOT_ASKED", 0), "e": ("failed", "EMPTY_RESPONSE", 0), "f": ("completed", None, 1)}
