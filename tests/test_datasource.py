"""Files through the data source: against the one-call tokenizer, cut in ranges, filtered, and as a stream that stops."""

import pytest

from siftworks.plans.queries import lead_files
from siftworks.sources import datasource, delimited
from tests.test_large import odd_texts


def written(folder):
    for i, text in enumerate(odd_texts()):
        (folder / f"a b+{i}.csv").write_bytes(b"\xff\xfe" + text.encode("utf-16-le") if i % 9 == 4 else text.encode())
    (folder / "_hidden").write_text("no,no")
    return str(folder)


def read(spark, path, **options):
    return spark.read.format(datasource.register(spark)).options(**options).load(path)


def test_whole_files(spark, tmp_path):
    path = written(tmp_path)
    (tmp_path / "_hidden").unlink()
    got = read(spark, path, range_bytes=100).drop("block")
    assert got.rdd.getNumPartitions() > 3
    want = delimited.read_records(delimited.files_at(spark, path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    small = read(spark, path, max_bytes=9).filter("ordinal is null")
    assert small.count() == sum(len(x.read_bytes()) > 9 for x in tmp_path.iterdir())


@pytest.mark.parametrize("size", [3, 40])
def test_ranges_change_nothing(spark, tmp_path, size):
    path = written(tmp_path)
    whole, cut = (read(spark, path, multiline="false", range_bytes=n) for n in (1 << 20, size))
    assert sorted(map(repr, whole.drop("block").collect())) == sorted(map(repr, cut.drop("block").collect()))
    for a, b in zip(delimited.parse(whole), delimited.parse(cut), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_lines_without_quotes_are_those_of_whole_files(spark, tmp_path):
    for i, text in enumerate(["a,b\n\n1,2", "a;b\r\n1;2\r3;4\r\n\r\n5", "﻿é|b\nü|\n", "", "\n", 'a,b\n"1,1", "2" x\n"x""y",z\n']):
        (tmp_path / f"{i}.csv").write_text(text, newline="")
    for a, b in zip(delimited.parse(read(spark, str(tmp_path))), delimited.parse(read(spark, str(tmp_path), multiline="false", range_bytes=2)), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_an_open_quote_ends_with_its_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"x,y\n1,""\n"p""')
    got = read(spark, str(tmp_path), multiline="false", range_bytes=4).orderBy("ordinal").collect()
    assert [(r.ordinal, r.raw_cells) for r in got] == [(0, ["a", "b"]), (4, ["x,y"]), (9, ["1", ""]), (14, ['p"'])]


def test_options_schema_and_filter(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v;w\né,1;2\n".encode("latin-1"))
    (tmp_path / "b.csv").write_text("x;y\n")
    got = read(spark, str(tmp_path), delimiter=";", encoding="latin-1")
    assert [r.raw_cells for r in got.filter("upload_id like '%a.csv'").orderBy("ordinal").collect()] == [["k,v", "w"], ["é,1", "2"]]
    few = spark.read.format(datasource.NAME).schema("ordinal long, upload_id string").load(str(tmp_path))
    assert few.columns == ["ordinal", "upload_id"] and few.count() == 3
    one = read(spark, str(tmp_path), range_bytes=1).filter(f"upload_id = 'file:{tmp_path}/a.csv' and ordinal > 0")
    assert one.rdd.getNumPartitions() == 1 and [r.ordinal for r in one.collect()] == [1]
    assert read(spark, str(tmp_path)).filter("upload_id = 'none'").collect() == []
    with pytest.raises(Exception, match="one character"):
        read(spark, str(tmp_path), delimiter=";;").collect()


def test_empty_folder(spark, tmp_path):
    assert read(spark, str(tmp_path)).collect() == []


def test_leads_read_through_the_source(spark, sf_dir, tmp_path):
    for r in lead_files(spark, sf_dir).collect():
        (tmp_path / r.path).write_bytes(r.content)
    name = lambda rows: sorted(repr((r.upload_id.split("/")[-1], *r[1:])) for r in rows.collect())
    for a, b in zip(delimited.parse(read(spark, str(tmp_path))), delimited.parse(delimited.read_records(lead_files(spark, sf_dir))), strict=True):
        assert name(a) == name(b)


def test_stream_resumes_after_a_stop(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    got, stop = {}, [False]

    def sink(df, batch):
        got[batch] = sorted((r.upload_id.split("/")[-1], r.ordinal) for r in df.collect())
        if stop[0]:
            raise RuntimeError("stopped")

    def run():
        stream = spark.readStream.format(datasource.register(spark)).option("log", str(tmp_path / "log")).load(str(folder))
        query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()

    (folder / "b.csv").write_text("h\n1\n")
    run()
    (folder / "a.csv").write_text("h\n")
    stop[0] = True
    with pytest.raises(Exception, match="stopped"):
        run()
    (folder / "0.csv").write_text("h\n")  # comes after the stop, and isn't taken into the batch that is done again
    stop[0] = False
    run()
    run()
    (folder / "c.csv").write_text("h\n")
    run()
    batches = [x for x in got.values() if x]
    assert batches[:2] == [[("b.csv", 0), ("b.csv", 1)], [("a.csv", 0)]]
    assert sorted(x for b in batches for x in b) == [("0.csv", 0), ("a.csv", 0), ("b.csv", 0), ("b.csv", 1), ("c.csv", 0)]
