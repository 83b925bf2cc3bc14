"""Delimited files in many blocks against Python's csv."""

import csv
import io
import random

import pytest
from loomtab.sources import delimited


@pytest.fixture
def tiny_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def want(raw, separator):
    for name in ("utf-8-sig", "gbk", "latin-1"):
        try:
            text = raw.decode(name)
            break
        except UnicodeDecodeError:
            continue
    # a line of blanks that is a record by itself is skipped
    blanks = " \t\f\v".replace(separator, "")
    return [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if x and not (len(x) == 1 and x[0] and not x[0].strip(blanks))]


def test_fuzzed_files_are_what_csv_reads(spark, tmp_path, tiny_blocks):
    r = random.Random(7)
    files = {}
    for k in range(9):
        sep = "\t" if k % 5 == 4 else ","
        bits = ["a", "bc", "é漢" if k % 3 else "张三", '"', '""', sep, sep, "\n", "\n", "\r\n", " ", '"x\ny"', f'{sep}"', f'"{sep}', "long words " * 3]
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 200)))
        quoted = False
        for line in text.split("\n"):
            quoted = delimited.ends_quoted(line.encode(), sep.encode(), quoted)
        text += '"' * quoted  # a file that ends in quotes has no records
        raw = text.encode("gbk" if k % 3 == 0 and "é" not in text else "utf-8")
        if k == 7:
            raw = b"\xef\xbb\xbf" + raw
        name = f"f{k}.{'tsv' if sep == chr(9) else 'csv'}"
        (tmp_path / name).write_bytes(raw)
        files[name] = want(raw, sep)
    found = delimited.records(spark, str(tmp_path)).collect()
    got = {}
    for row in sorted(found, key=lambda x: (x.record, x.part)):
        got.setdefault(row.file.rsplit("/", 1)[-1], []).append(row.cells)
    assert delimited.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 9
    for name, rows in files.items():
        whole = sum(len(c) for x in rows for c in x)
        assert got.get(name, []) == rows, (name, whole)


def test_one_file_over_many_tasks_with_a_quoted_field_over_blocks(spark, tmp_path, tiny_blocks):
    text = "id,text\n" + "".join(f'{i},"line {i}\n\nmore ""quoted"", é {"x" * (i % 90)}\n"\n' for i in range(40))
    (tmp_path / "one.csv").write_text(text)
    found = delimited.records(spark, str(tmp_path / "one.csv"))
    rows = sorted(found.collect(), key=lambda x: x.record)
    assert [r.cells for r in rows] == list(csv.reader(io.StringIO(text, newline=""))) and [r.record for r in rows] == list(range(41))
    assert delimited.shapes(found).first()[1:] == (41, 2, False)
    states = delimited.blocks(delimited.lines(spark, str(tmp_path / "one.csv"))).collect()
    assert len(states) > 15 and {s.quoted for s in states} == {True, False}


def test_ragged_open_and_empty_files(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n1,2,3\n")
    (tmp_path / "open.csv").write_text('a,b\n1,"2\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n")
    found = delimited.records(spark, str(tmp_path))
    assert {(r.file.rsplit("/", 1)[-1], r.rows, r.width, r.ragged) for r in delimited.shapes(found).collect()} == {("long.csv", 2, 2, True)}
    assert {r.file.rsplit("/", 1)[-1] for r in delimited.blocks(delimited.lines(spark, str(tmp_path))).where("open").collect()} == {"open.csv"}


@pytest.mark.parametrize(("line", "quoted", "ends"), [(b'a,"b', False, True), (b'a "b', False, False), (b'b" ,"c', True, True), (b'x"",', True, True), (b'""', False, False), (b'"""', False, True), (b'"a"b"', False, False), (b"", True, True)])
def test_state_after_a_line(line, quoted, ends):
    assert delimited.ends_quoted(line, b",", quoted) is ends
