import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.sources import delimited as D

COLUMNS = ["id", "embedding", "document"]


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ('1,"1,2",a', None),
        ('1,"[1, 2]","say ""x"""\r', None),
        ("1,1 2,a", None),
        ("+1,1e0  2,", None),
        (' 1 ,"1,2",a', None),
        ('1,"1,2,a', "broken_quoting"),
        ('1,"1,2"x,a', "broken_quoting"),
        ('1,"1,2", "a"', "broken_quoting"),
        ('1,1 2,a"b', "broken_quoting"),
        ("1,1 2", "column_count"),
        ("1,1 2,a,b", "column_count"),
        ("x,1 2,a", "bad_id"),
        ("1.0,1 2,a", "bad_id"),
        ("9223372036854775808,1 2,a", "bad_id"),
        ("-9223372036854775808,1 2,a", None),
        ("١,1 2,a", "bad_id"),
        ("1,,a", "bad_embedding"),
        ("1,[],a", "bad_embedding"),
        ('1,"[1,[2]]",a', "bad_embedding"),
        ('1,"1,,2",a', "bad_embedding"),
        ("1,1 nan,a", "bad_embedding"),
        ("1,1 1e39,a", "bad_embedding"),
        ("1,0x1 2,a", "bad_embedding"),
        ("1,1,a", "wrong_dimension"),
        ("1,1 2 3,a", "wrong_dimension"),
    ],
)
def test_reasons(line, reason):
    assert D.parse_line(line, ",", COLUMNS, 2).reason == reason


@pytest.mark.parametrize("line", ["", " ", "\r", "\t \r"])
def test_blank(line):
    assert D.parse_line(line, "\t", COLUMNS, 2) is None


def test_first_reason_wins():
    assert D.parse_line('x,"1', ",", COLUMNS, 2).reason == "broken_quoting"
    assert D.parse_line("x,y", ",", COLUMNS, 2).reason == "column_count"
    assert D.parse_line("x,y,z", ",", COLUMNS, 2).reason == "bad_id"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\t ', max_size=6), min_size=1, max_size=5), st.sampled_from(",\t"))
def test_round_trip(fields, sep):
    line = sep.join('"' + f.replace('"', '""') + '"' for f in fields)
    assert D._record(line, 0, sep, "")[0] == fields


def test_recovery_after_a_lost_quote():
    text = '1,"1,2",a\n2,"1,2,b\n3,"1,2","two\nlines"\n4,1 2,d\n'
    got = list(D.parse_text(text, ",", COLUMNS, 2))
    assert [(r.id, r.reason) for r in got] == [(1, None), (None, "broken_quoting"), (3, None), (4, None)]
    assert got[2].fields[2] == "two\nlines"
    assert got[1].position is not None


def test_load_lines(spark):
    files = spark.createDataFrame([(1, "CSV ", "id,embedding", 2), (2, "xml", "id,embedding", 2), (3, "tsv", None, 2)], "file_id bigint, file_format string, header_columns string, dimension int")
    rows = [(1, 1, 2, "5,1 2"), (2, 1, 3, "5,1 2"), (3, 1, 4, None), (4, 1, 5, " "), (5, 2, 2, "5,1 2"), (6, 9, 2, "x"), (7, 3, 2, "x"), (8, 1, 6, "7," + "1 " * 200_000)]
    lines = spark.createDataFrame([r + ("extra",) for r in rows], "row_id bigint, file_id bigint, line_no int, raw_line string, reason string")
    out = {r.row_id: (r.id, r.reason) for r in D.load_lines(lines, files).collect()}
    assert out == {1: (5, None), 2: (5, None), 5: (None, "unknown_file"), 6: (None, "unknown_file"), 7: (None, "unknown_file"), 8: (None, "wrong_dimension")}
    assert D.load_lines(lines.limit(0), files.limit(0)).count() == 0


def test_read_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,embedding\n1,"1,2"\n2,"1,2\n3,1 2\n')
    got = D.read_delimited(spark, str(tmp_path / "a.csv"), ",", 2).orderBy("line_no").collect()
    assert [(r.id, r.reason) for r in got] == [(1, None), (None, "broken_quoting"), (3, None)]


def test_very_long_ids(spark):
    assert D.parse_id("9" * 5000) is None and D.parse_id("-" + "0" * 5000 + "17") == -17 and D.parse_id("+0") == 0
    assert D.parse_id(str(2**63 - 1)) == 2**63 - 1 and D.parse_id(str(2**63)) is None and D.parse_id(str(-(2**63))) == -(2**63)
    files = spark.createDataFrame([(1, "csv", "id,embedding", 2)], "file_id bigint, file_format string, header_columns string, dimension int")
    lines = spark.createDataFrame([(1, 1, 2, "9" * 5000 + ",1 2")], "row_id bigint, file_id bigint, line_no int, raw_line string")
    assert [r.reason for r in D.load_lines(lines, files).collect()] == ["bad_id"]


@pytest.mark.parametrize("stretch", [3, 17, 10_000])
def test_files_in_pieces_as_in_one(spark, stretch):
    """Cutting a file at anchors changes nothing, whatever the quotes do around the cuts."""
    rng = random.Random(8)
    kinds = ['{n},"1,2",note', '{n},"1,2","two\nlines"', '{n},"1,2","three\n\n lines"', '{n},"1,2,lost', '{n},"1,2","open', "", "  ", '{n},1 2', 'x,1 2,d', '{n},"1,2,3",d', 'tail",{n},"', '"', '{n},1 2,d\r']
    text = "\n".join(rng.choice(kinds).format(n=n) for n in range(300))
    columns = ["id", "embedding", "note"]
    want = [(text.count("\n", 0, r.start) + 2, r.id if r.reason is None else None, r.fields, r.reason) for r in D.parse_text(text, ",", columns, 2)]
    lines = [(1, k + 2, x, "more") for k, x in enumerate(text.split("\n"))] + [(2, 2, "5\t1 2", "more"), (3, 2, "x", "more"), (2, 3, None, "more")]
    rng.shuffle(lines)
    files = spark.createDataFrame([(1, "csv", ",".join(columns), 2), (2, "tsv", "id,embedding", 2)], "file_id bigint, file_format string, header_columns string, dimension int")
    rows = spark.createDataFrame(lines, "file_id bigint, line_no int, raw_line string, piece string")
    got = D.load_files(rows, files, stretch).orderBy("file_id", "line_no").collect()
    assert [(r.line_no, r.id, r.fields, r.reason) for r in got if r.file_id == 1] == want
    assert [(r.id, r.reason) for r in got if r.file_id > 1] == [(5, None), (None, "unknown_file")]
    assert D.load_files(rows.limit(0), files.limit(0)).count() == 0
