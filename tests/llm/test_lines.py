import random
import re

import duckdb
import pytest
from loomtab.llm import lines as L
from loomtab.llm.tables import keyed


def _brute(rows, run, long=L.LONG):
    """(id, text) in order -> id -> list of kept texts."""
    seen, out = set(), {}
    for i, text in rows:
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        worded = [j for j, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        stretches = [("run", worded[p : p + run]) for p in range(len(worded) - run + 1)]
        for kind, at in stretches + [("line", [j]) for j in worded if len(re.findall(r"[^\x20\x09-\x0D]+", lines[j])) > long]:
            key = kind, tuple(lines[j] for j in at)
            if key in seen:
                gone.update(at)
            seen.add(key)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.fixture(scope="module")
def rows(awkward):
    r = random.Random(8)
    pool = [f"line {i} é" for i in range(25)] + ["", " ", "one"] + [" ".join(f"w{i}" for i in range(n)) for n in (50, 51, 80)]
    more = [(400 + i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(60)]
    more += [(500 + i, f"head {i}\nlicense a\nlicense b\nlicense c\ntail {i}") for i in range(80)]
    more += [(600, pool[-1]), (601, pool[-1]), (602, " ".join(["x"] * 51)), (603, " ".join(["x"] * 51)), (604, " ".join(["x"] * 50)), (605, " ".join(["x"] * 50))]
    return [*awkward, *more, (700, "\n".join(f"row {i % 900}" for i in range(3000)))]


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_matches_brute_force(spark, rows, run):
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, id string, gone int").repartition(3)
    got = L.remove_repeated_lines(frame, run)
    assert got.columns == frame.columns
    got = got.collect()
    want = _brute(sorted(set(rows), key=lambda x: (x[0], x[1] or "")), run)
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[r.doc_id] and (r.id, r.gone) == ("x", 7)


def test_only_minima_are_posted(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    worded = sum(bool(x.strip()) for _, t in rows for x in (t or "").split("\n"))
    for run, most in ((2, 0.75), (4, 0.5), (8, 0.3)):
        posted = L.postings(keyed(frame, "doc_id", "text"), run, long=10**6)
        assert 0 < posted.count() < most * worded


def test_places_of_a_hot_run_can_be_split(spark, tmp_path):
    """A join of two plain tables, whose skewed side adaptive execution splits."""
    rows = [(i, f"a {i}\nlicense a\nlicense b\nb {i}") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    now = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        gone = L.repeated_lines(keyed(frame, "doc_id", "text"))
        assert len(gone.collect()) == 5999
        assert "skew=true" in gone._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sql_gives_the_same(spark, rows, tmp_path):
    once = sorted(set(rows), key=lambda x: x[0])
    spark.createDataFrame(once, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, L.op1_lines(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = db.execute(L.ORACLES["op1_lines"])
    assert [c[0] for c in cursor.description] == ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    assert got == sorted(cursor.fetchall())


def test_empty(spark):
    assert L.remove_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_that_are_no_numbers(spark):
    rows = [("a", "x y\nz w\nend"), ("b", "x y\nz w\nother"), (None, "x y\nz w\nthird")]
    got = {r.doc_id: r.text for r in L.remove_repeated_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got[None] == rows[2][1] and {got["a"], got["b"]} == {"end", "other"}
