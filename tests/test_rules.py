"""Detectors, rules and files on single values."""

import pytest
from pyspark.sql import functions as F

from siftworks.functions import detect, rules, text
from siftworks.operators import cells, extract, profile, trust
from siftworks.sources import delimited


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}").repartition(2)
    return [r[1] for r in sorted(df.select("i", expression(F.col("v"))).collect(), key=lambda r: r[0])]


CASES = {
    "email": ["a@b.co", "a@b", "a b@c.d", "a@b.c\n", "@b.c", "a@@b.c"],
    "date": ["2026-05-12", "2026-05-12T00:00Z", "2026/5/1", "5/12/2026", "12-May-2026", "12 May 2026", "12.05.26", "May 12, 2026", "2026-5-12", "1-2-3"],
    "phone": ["98333 11111", "+1 (415) 555-2671", "2026-01-15", "123456", "1234567", "1234567890123456", "12a34567", "-1234567", "1234567.89"],
    "numeric": ["1,200", "$5", "-$5", "5%", "₹5", "1.5", ".5", "", ",", "1e5"],
}
EXPECTED = {
    "email": [True, False, False, False, False, False],
    "date": [True, True, True, True, True, True, True, False, False, False],
    "phone": [True, True, False, False, True, False, False, True, True],
    "numeric": [True, True, True, True, False, True, False, False, False, False],
}


@pytest.mark.parametrize("kind", sorted(CASES))
def test_detectors(spark, kind):
    assert values(spark, CASES[kind], getattr(detect, f"looks_like_{kind}")) == EXPECTED[kind]


def field(spark, items, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return sorted(rules.normalize(df, "v", **options).collect(), key=lambda r: r.i)


@pytest.mark.parametrize(
    ("raw", "value", "applied", "status", "confidence"),
    [
        ("  JOHN@Example.COM ", "john@example.com", ["whitespace", "email"], "normalized", 1.0),
        ("a@nodot", "a@nodot", ["email"], "warning", 0.4),
        ("x, a@b.io", "x", ["email"], "warning", 0.4),
        ("a@b.io and c@d.io", "a@b.io", ["email"], "normalized", 1.0),
        ("+91 98333 11111", "+919833311111", ["phone"], "normalized", 1.0),
        ("983-331-1111", "9833311111", ["phone"], "warning", 0.5),
        ("2500000", "2500000", ["phone"], "warning", 0.5),
        ("2026-01-15", "2026-01-15", ["date"], "normalized", 1.0),
        ("15/01/2026", "2026-01-15", ["date"], "normalized", 1.0),
        ("15-Jan-2026", "2026-01-15", ["date"], "normalized", 1.0),
        ("05/06/2026", "05/06/2026", ["date"], "warning", 0.3),
        ("05/05/2026", "05/05/2026", ["date"], "warning", 0.3),
        ("13/13/2026", "13/13/2026", ["date"], "warning", 0.2),
        ("2026-02-30", "2026-02-30", ["date"], "warning", 0.2),
        ("0026-01-15", "0026-01-15", ["date"], "warning", 0.2),
        ("25/12/26", "2026-12-25", ["date"], "normalized", 1.0),
        ("$1,200,000", "1200000", ["number"], "normalized", 1.0),
        ("150000", "150000", ["number"], "normalized", 1.0),
        ("1.50", "1.5", ["number"], "normalized", 1.0),
        ("Yes", "true", ["boolean"], "normalized", 1.0),
        ("N/A", None, ["null"], "normalized", 1.0),
        ("", None, ["null"], "normalized", 1.0),
        (None, None, ["null"], "normalized", 1.0),
        ("“hi”", '"hi"', ["text"], "normalized", 1.0),
        ("plain", "plain", [], "unchanged", 1.0),
        ("é​x", "éx", ["unicode"], "normalized", 1.0),
        ("a \t b\r\n c ", "a b\nc", ["whitespace"], "normalized", 1.0),
        ("₹18,50,000", "₹18,50,000", [], "unchanged", 1.0),
        ("Jan 15, 2026", "Jan 15, 2026", [], "unchanged", 1.0),
    ],
)
def test_normalize(spark, raw, value, applied, status, confidence):
    (got,) = field(spark, [raw])
    assert (got.normalized_value, got.applied_rules, got.status, got.confidence) == (value, applied, status, confidence)


def test_number_rule_takes_other_currencies(spark):
    got = values(spark, ["₹18,50,000", "€5", "-$5", "x"], lambda v: F.struct(rules.number_rule(v)["details"]["number"]["value"].alias("n"), rules.number_rule(v)["details"]["number"]["currency_symbol"].alias("c")))
    assert [(r.n, r.c) for r in got] == [(1850000.0, "₹"), (5.0, "€"), (-5.0, None), (None, None)]


def test_numbers_as_text(spark):
    items = [1e21, 1.5e22, 1e20, 123456789012345680.0, 12345678.9, 1e7, 150000.0, 0.0001, 0.001, 1.5e-6, 1e-7, -1.25e-9, -12345678.5, 0.0]
    want = ["1e+21", "1.5e+22", "100000000000000000000", "123456789012345680", "12345678.9", "10000000", "150000", "0.0001", "0.001", "0.0000015", "1e-7", "-1.25e-9", "-12345678.5", "0"]
    assert values(spark, items, rules.number_text, "double") == want


def test_preview_of_a_file(spark, tmp_path):
    from siftworks.operators import preview

    (tmp_path / "leads.csv").write_text("Full Name,E-mail,Budget\n" + "".join(f"Person {'abc'[i % 3]}x,p{i}@x.io,${i},000\n" for i in range(60)))
    (tmp_path / "empty.csv").write_text("")
    datasets, rows = delimited.read_delimited(spark, str(tmp_path))
    got = preview.preview(datasets.filter("error is null").cache(), rows.cache(), compose=False)
    assert {r.error for r in datasets.collect()} == {None, "EMPTY_DATASET"}
    assert got["rows"].count() == 50 and got["metadata"].first().row_count == 60
    assert {r.column_index: r.field_id for r in got["mapped"].collect()} == {0: "name", 1: "email", 2: got["mapped"].filter("column_index = 2").first().field_id}
    assert got["report"].first().columns_analyzed == 3 and got["normalization"].first().emails_normalized == 60
    assert {r.type_guess for r in got["profiles"].collect()} == {"text", "email", "numeric"}


def test_dice_is_symmetric_and_bounded(spark):
    pairs = [("night", "nacht"), ("aaaa", "aa"), ("a", "b"), ("same", "same"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(text.dice(F.col("a"), F.col("b")).alias("x"), text.dice(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] == [0.25, 0.5, 0.0, 1.0, 0.0]


def test_quality_score_by_hand(spark):
    lit = F.lit
    assert spark.range(1).select(profile.quality_score(lit(1), lit(4), lit(1), lit(3), lit(12), lit(2), lit(3))).first()[0] == 67


def test_tokenize():
    got = lambda t, d=",": list(delimited.tokenize(t, d))
    assert got('a,b\r\n"x, ""y""\n2",z\r') == [["a", "b"], ['x, "y"\n2', "z"]]
    assert got('a,  "q"t,b"c"\n\nlast,') == [["a", "qt", 'b"c"'], [""], ["last", ""]]
    assert got('"open, to the end\nx') == [["open, to the end\nx"]]
    assert got("") == []
    assert delimited.find_delimiter("a;b;c\n1;2,5;3\n") == ";" and delimited.find_delimiter("one\ntwo") == ","
    assert delimited.decode("é,b".encode("utf-16-le").join([b"\xff\xfe", b""])) == ("é,b", "UTF-16LE")


def test_read_ragged_file(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text("Name,Email,,Name\nA,a@b.c\n\n,,,\nB,b@c.d,x,y,z\n")
    datasets, rows = delimited.read_delimited(spark, str(tmp_path))
    (d,) = datasets.collect()
    assert (d.headers, d.blank_rows, d.row_count) == (["Name", "Email", "Column 3", "Name (2)"], 2, 2)
    got = sorted(rows.collect(), key=lambda r: r.row_number)
    assert [(r.cells, r.status, r.warning) for r in got] == [(["A", "a@b.c", "", ""], "recovered", "ROW_PADDED"), (["B", "b@c.d", "x", "y"], "recovered", "ROW_TRUNCATED")]
    long = cells.parsed_to_cells(rows, datasets)
    assert long.count() == 8
    records = extract.wide(extract.extract(cells.normalize_cells(long))).orderBy("row_number").collect()
    assert [(r.name, r.email) for r in records] == [("A", "a@b.c"), ("B", "b@c.d")]
    assert {(r.code, r["count"]) for r in delimited.parse_warnings(datasets, rows).collect()} == {("BLANK_ROWS_SKIPPED", 2), ("DUPLICATE_HEADERS_RENAMED", 2), ("EMPTY_HEADER_NAMES", 1), ("RAGGED_ROWS_ADJUSTED", 2)}


def test_json_repair(spark):
    got = values(spark, ['{a: 1,}', '{"a": "x\ny"', '{"ok": 1}', "nothing", None, '{"a": "b\\q"}'], text.repair_json)
    assert [(r.success, r.text) for r in got] == [(True, '{"a": 1}'), (True, '{"a": "x\\ny"}'), (False, None), (False, None), (False, None), (True, '{"a": "b\\\\q"}')]
    got = values(spark, ['{"n": "O’Brien"}', "{a: NaN}", '{"a": "\\', '{"a": [1}', '{“a”: "x\x01"}'], text.repair_json)
    assert [(r.success, r.text, r.repairs) for r in got] == [
        (False, None, []), (False, '{"a": NaN}', ["UNQUOTED_KEY_QUOTED"]), (False, '{"a": "\\"}', ["UNTERMINATED_STRING_CLOSED", "UNBALANCED_BRACKETS_CLOSED"]),
        (False, '{"a": [1}}', ["UNBALANCED_BRACKETS_CLOSED"]), (False, '{"a": "x\x01"}', ["SMART_QUOTES_NORMALIZED"]),
    ]


def test_trust_takes_repairs_before_rules(spark):
    row = {f: None for f in trust.FIELDS} | {"email": "A@B.io", "crm_status": "good lead follow up", "mobile_without_country_code": "98-33311111", "created_at": "15/01/2026"}
    fields = [(f, row[f], 1.0 if row[f] else 0.0, "") for f in trust.FIELDS]
    df = spark.createDataFrame([(1, fields)], f"row_number long, fields {trust.FIELD}")
    (got,) = trust.run_trust(df).collect()
    kept = {r.target_field: r.value for r in got.reports if r.value}
    assert kept == {"email": "a@b.io", "crm_status": "GOOD_LEAD_FOLLOW_UP", "mobile_without_country_code": "9833311111", "created_at": "2026-01-15"}
    assert (got.repair_count, got.approval_status) == (4, "needs_review")


def test_stream_of_files(spark, tmp_path):
    from siftworks.streaming import uploads

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n3,4\n")
    seen = []
    uploads.watch(spark, str(folder), str(tmp_path / "state"), lambda datasets, rows, batch: seen.append(rows.count())).awaitTermination()
    uploads.watch(spark, str(folder), str(tmp_path / "state"), lambda datasets, rows, batch: seen.append(rows.count())).awaitTermination()
    assert seen == [2]
