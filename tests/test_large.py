"""The tokenizer against a plain state machine, and files cut at every byte against the one-call tokenizer."""

import random

import pytest

from siftworks.sources import delimited, large


def machine(text, delimiter):
    """One character at a time: outside or inside quotes."""
    out, record, cell, inside, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                inside = False
            else:
                cell += c
        elif c == '"' and all(x in " \t" for x in cell):
            inside, cell = True, ""
        elif c == delimiter:
            record.append(cell)
            cell = ""
        elif c in "\r\n":
            out.append([*record, cell])
            record, cell = [], ""
            i += text[i : i + 2] == "\r\n"
        else:
            cell += c
        i += 1
    if cell or record:
        out.append([*record, cell])
    return out


@pytest.mark.parametrize("delimiter", [",", ";", "|", "\t"])
def test_tokenizer_is_the_machine(delimiter):
    draw = random.Random(delimiter)
    for _ in range(15_000):
        text = "".join(draw.choices('""" \t\n\ra' + delimiter * 2, k=draw.randrange(14)))
        assert list(delimited.tokenize(text, delimiter)) == machine(text, delimiter), text
        n, inside = 0, False
        for line in text.split("\n"):
            ends, inside = large.record_ends(line + "\n", inside, delimiter)
            n += len(ends)
        want = machine(text + "\n", delimiter)
        assert n == len(want) - inside, text


@pytest.mark.parametrize(("text", "want"), [('x\t "a\tb"\ty', [["x", "a\tb", "y"]]), ('""  "x,y",z', [["x,y", "z"]]), ('""', []), ('"', []), ('a,""\n', [["a", ""]])])
def test_odd_quotes(text, want):
    assert list(delimited.tokenize(text, "\t" if "\t" in text else ",")) == want


def odd_texts():
    draw = random.Random(8)
    texts = ["", '"', '""', "a,b\n1,2", "a,b\r\n1,\"x\r\ny\"\r\n", "h\n\n\n,\n\"open\nto the\nend", "﻿a;b\n1;2\n", 'a\tb\n "1\t2"\t3\n', "é,ü\n😀,\"ß\n\n\"\n", "a,b\rc,d\re,\"f\rg\"\r"]
    for _ in range(12):
        d = draw.choice(",;|\t")
        texts.append(f"h1{d}h2{d}h3\n" + "".join(draw.choices(['"', '""', "\n", "\r\n", d, d, " ", "x", "é1", '\n"', f'{d}"', f'"{d}'], k=draw.randrange(60))))
    return texts


@pytest.mark.parametrize(("size", "most"), [(2, 100_000), (7, 0), (1 << 20, 100_000)])
def test_files_cut_anywhere(spark, tmp_path, size, most):
    want = {}
    for i, text in enumerate(odd_texts()):
        name = tmp_path / f"a b+{i}.csv"
        raw = text.encode("utf-8")
        if i % 9 == 4:
            raw = b"\xff\xfe" + text.encode("utf-16-le")
        name.write_bytes(raw)
        clean = text.removeprefix("﻿")
        want[f"a b+{i}.csv"] = list(enumerate(delimited.tokenize(clean, delimited.find_delimiter(clean)))) or [(-1, None)]
    got = {}
    records = large.read_large(spark, str(tmp_path), size, most)
    rows = records.collect()
    for r in rows:
        got.setdefault(r.upload_id.split("/")[-1], []).append((r.ordinal, r.raw_cells))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == want
    plain = delimited.read_records(delimited.files_at(spark, str(tmp_path)))
    assert {(r.upload_id, r.delimiter, r.encoding) for r in rows if r.ordinal >= 0} == {(r.upload_id, r.delimiter, r.encoding) for r in plain.collect() if r.ordinal >= 0}
    for a, b in zip(delimited.parse(records), delimited.parse(plain), strict=True):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    if size < 8:
        assert len({(r.upload_id, r.block) for r in rows}) > 60
