"""Workspace sources and table readers against plain Python on small files."""

import csv

import pytest
from pyspark.sql import functions as F
from loomtab.sources import catalog_schemas, tables, workspace


@pytest.fixture
def root(tmp_path):
    def put(name, data):
        path = tmp_path / "ws" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
        return path

    put("raw/a.csv", "name,age\nAnn,3\n")
    put("raw/_hidden.txt", "line one\nline two")
    put(".dir/b.json", '{"name": "x", "tags": [1]}')
    put("raw/.secret", "no")
    put("SESSION_MEMORY.md", "no")
    put("gbk.txt", "姓名".encode("gbk"))
    put("list.json", "[1, 2, 3]")
    put("bad.json", "{nope")
    return tmp_path / "ws"


def test_inventory(spark, root):
    got = [r.relative_path for r in workspace.scan(spark, str(root)).collect()]
    assert got == [".dir/b.json", "bad.json", "gbk.txt", "list.json", "raw/_hidden.txt", "raw/a.csv"]
    assert [r.relative_path for r in workspace.scan(spark, str(root), depth=1).collect()] == ["bad.json", "gbk.txt", "list.json"]
    assert "raw/.secret" in {r.relative_path for r in workspace.scan(spark, str(root), dotfiles=True).collect()}
    assert not any(r.relative_path.startswith(".dir") for r in workspace.scan(spark, str(root), dot_directories=False).collect())
    assert workspace.scan(spark, str(root / "missing")).collect() == []


def test_listing_is_that_of_a_walk(spark, tmp_path):
    import os
    import random

    r = random.Random(3)
    for _ in range(60):
        folder = tmp_path / "/".join(r.choice(["a", "b b", ".c", "_d", "é"]) for _ in range(r.randrange(4)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / r.choice(["x.txt", ".y", "_z", "SESSION_MEMORY.md", "p%20q", "=1"])).write_text("x" * r.randrange(9))
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    walked = {os.path.relpath(os.path.join(d, n), tmp_path): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(tmp_path) for n in names}
    for depth, dotfiles, dot_directories in ((None, True, True), (None, False, False), (2, False, True)):
        got = {x.relative_path: x.size_bytes for x in workspace.scan(spark, str(tmp_path), depth, dotfiles, dot_directories).collect()}
        parts = {p: p.split("/") for p in walked}
        assert got == {p: n for p, n in walked.items() if (depth is None or len(parts[p]) <= depth) and parts[p][-1] != "SESSION_MEMORY.md"
                       and (dotfiles or parts[p][-1][0] != ".") and (dot_directories or not any(x[0] == "." for x in parts[p][:-1]))}
    plan = workspace.contents(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "LocalTableScan" not in plan


def test_tree(spark, root):
    nodes = {(r.path, r.parent, r.depth, r.kind) for r in workspace.tree(workspace.scan(spark, str(root))).collect()}
    assert ("raw", "", 1, "directory") in nodes and ("raw/a.csv", "raw", 2, "file") in nodes and len(nodes) == 8


def test_digests(spark, root):
    files = spark.createDataFrame([(p.name, p.read_bytes()) for p in root.rglob("*") if p.is_file()], "relative_path string, content binary")
    got = {r.relative_path: r for r in workspace.digests(files).collect()}
    assert got["gbk.txt"].encoding == "gbk" and got["gbk.txt"].preview == "姓名"
    assert (got["_hidden.txt"].line_count, got["_hidden.txt"].preview_truncated) == (2, False)
    assert (got["b.json"].json_type, got["b.json"].json_keys, got["b.json"].json_key_count) == ("dict", ["name", "tags"], 2)
    assert (got["list.json"].json_type, got["list.json"].json_length) == ("list", 3)
    assert got["list.json"].json_item_keys is None
    one = spark.createDataFrame([('[{"a": 1, "b": 2}, 3]',)], "t string").select(*workspace.json_summary(F.col("t"))).first()
    assert (one.json_type, one.json_length, one.json_item_keys) == ("list", 2, ["a", "b"])
    assert got["bad.json"].json_type is None and got["bad.json"].json_keys is None


def test_contents_and_payload(spark, root):
    files = workspace.contents(spark, f"file://{root}/raw")
    assert {(r.relative_path, bytes(r.content)) for r in files.collect()} == {("a.csv", b"name,age\nAnn,3\n"), ("_hidden.txt", b"line one\nline two")}
    every = {r.relative_path for r in workspace.contents(spark, str(root)).collect()}
    assert every == {r.relative_path for r in workspace.scan(spark, str(root)).collect()}
    assert workspace.contents(spark, str(root / "missing")).collect() == []


def test_digest_of_a_workspace(spark, root):
    """Inventory, rules, contents and handlers together, as the reader's most basic call has them."""
    import json

    from loomtab.operators import digest, rules

    files = workspace.contents(spark, str(root)).withColumnRenamed("relative_path", "path")
    routed = rules.resolve(files, rules.rules(spark))
    got = {r.path: json.loads(r.digest) for r in digest.digests(routed).collect()}
    assert got["raw/a.csv"]["columns"] == ["name", "age"] and got["raw/a.csv"]["shape"] == [1, 2] and got["raw/a.csv"]["file_type"] == "table"
    assert (got["gbk.txt"]["encoding"], got["gbk.txt"]["preview"], got["gbk.txt"]["format_id"]) == ("gbk", "姓名", "builtin.text.plain")
    assert got[".dir/b.json"]["json_keys"] == ["name", "tags"] and got["list.json"]["json_length"] == 3 and "json_type" not in got["bad.json"]
    assert {r.path for r in digest.undigested(files, files.where("path like 'raw/%'")).collect()} == {".dir/b.json", "bad.json", "gbk.txt", "list.json"}


def test_project_tree(spark):
    inventory = spark.createDataFrame([("raw/a/b.csv", 3, 3), ("else/x", 1, 2)], "relative_path string, size_bytes long, depth int")
    nodes = {(r.path, r.parent, r.kind) for r in workspace.project_tree(inventory).collect()}
    assert nodes == {("raw", "", "directory"), ("raw/a", "raw", "directory"), ("raw/a/b.csv", "raw/a", "file"), ("outputs", "", "directory"), ("archive", "", "directory")}


def test_payload(spark):
    made = spark.createDataFrame([("a", b"text"), ("b", b"\xff\x00")], "relative_path string, content binary")
    assert {tuple(r) for r in workspace.payload(made).collect()} == {("a", "utf-8", "text"), ("b", "base64", "/wA=")}


@pytest.mark.parametrize(("name", "text", "want"), [
    ("a.csv", "name,age\nAnn,3\nBob,NA\n", [("Ann", "3"), ("Bob", None)]),
    ("a.tsv", "name\tage\nAnn\t3\n", [("Ann", "3")]),
    ("q.csv", 'a,b\n"x, ""y""\nz",2\n', [('x, "y"\nz', "2")]),
    ("short.csv", "a,b,c\n1\n2,3\n", [("1", None, None), ("2", "3", None)]),
])
def test_tables(spark, tmp_path, name, text, want):
    path = tmp_path / name
    path.write_text(text)
    raw = tables.read_raw(spark, str(path))
    head = next(csv.reader([text.split("\n")[0]], delimiter="\t" if name.endswith("tsv") else ","))
    table = tables.promote_header(raw)
    assert table.columns == head and [tuple(r) for r in table.collect()] == want


def test_table_edges(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2,3\n")
    with pytest.raises(tables.RaggedTable):
        tables.read_raw(spark, str(path))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_raw(spark, str(tmp_path / "empty.csv"))
    (tmp_path / "head.csv").write_text("a,b\n")
    assert tables.promote_header(tables.read_raw(spark, str(tmp_path / "head.csv"))).columns == []
    (tmp_path / "note.csv").write_text("# about,,\nID,Name,\n7,x,2\n")
    raw = tables.read_raw(spark, str(tmp_path / "note.csv"))
    assert tables.promote_header(raw).columns == ["# about", "Unnamed: 1", "Unnamed: 2"]
    assert tables.promote_header(raw, 1, ["ID", "Name", "ID"]).columns == ["ID", "Name", "ID_1"]
    (tmp_path / "g.csv").write_bytes("姓名,年龄\n张三,18\n".encode("gbk"))
    assert tables.promote_header(tables.read_raw(spark, str(tmp_path / "g.csv"))).collect()[0][0] == "张三"


def test_names():
    assert tables.unique_names(["a", "a", "a_1", None, " "]) == ["a", "a_1", "a_1", "Unnamed: 3", "Unnamed: 4"]
    assert len(set(tables.unique_names(["a", "a", "a_1", "a"], strict=True))) == 4


def test_catalog_bootstrap(spark):
    made = catalog_schemas.bootstrap(spark)
    assert len(made) == len(catalog_schemas.TABLES) and catalog_schemas.bootstrap(spark) == []
    for name in catalog_schemas.TABLES:
        spark.sql(f"DROP TABLE {name}")
