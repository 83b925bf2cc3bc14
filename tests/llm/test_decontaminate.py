import random
import re

import duckdb
import pytest
from loomtab.llm import decontaminate as D


def _words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def _brute(rows, bench):
    windows = {}
    for i, text in bench:
        w = _words(text)
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add(i)
    out = []
    for i, text in rows:
        w, hit, items = _words(text), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    items |= windows[tuple(w[s : s + m])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in items if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(awkward):
    r = random.Random(3)
    pool = ["the", "of", "É", "and", "Zwei", "trois", "42", "naïve", "x"] + [f"rare{i}" for i in range(40)]
    say = lambda n: " ".join(r.choice(pool) for _ in range(n))
    bench = [(i, say(r.randrange(14, 40))) for i in range(12)] + [(20, "short item here"), (21, "two wörds"), (22, "Lonely!"), (23, ""), (24, None), (None, say(20)), (25, "the of " * 12), (26, "the of " * 12)]
    rows = [*awkward]
    for i in range(60):
        text = say(r.randrange(0, 300))
        for _, part in r.sample(bench, r.randrange(0, 3)):
            w = (part or "").split()
            cut = " ".join(w[: r.randrange(0, len(w) + 1)]) if r.random() < 0.4 else " ".join(w)
            text += "; " + cut.upper() + ". " + say(r.randrange(0, 20))
        rows.append((600 + i, text))
    rows.append((700, "the of " * 400))
    return rows, bench


def test_matches_brute_force(spark, tables):
    rows, bench = tables
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, n_words int, item_id string").repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in bench], "item_id long, text string, doc_id int")
    want = _brute(rows, bench)
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == want and sum(x[4] for x in want) > 20 and sum(0 < x[2] and not x[4] for x in want) > 0
    kept = D.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if not x[4]]


def test_shuffled_sides_give_the_same(spark, tables, monkeypatch):
    rows, bench = tables
    monkeypatch.setattr(D, "SMALL", -1)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == _brute(rows, bench)


def test_sql_gives_the_same(spark, tables, tmp_path):
    rows, bench = tables
    once = sorted(set(rows), key=lambda x: x[0])
    spark.createDataFrame(once, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, D.op6_decontaminate(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(db.execute(D.ORACLES["op6_decontaminate"]).fetchall())


def test_empty(spark, tables):
    none, empty = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    assert D.contamination(none, empty).collect() == []
    assert all(r.n_hit == 0 and not r.contaminated for r in D.contamination(docs, empty).collect())


def test_no_words_beside_tokens(spark, tables):
    """Where tokens are shuffled, rows hold a key, a place and a token; texts and words stay where they are."""
    from loomtab.llm.tables import keyed

    docs = keyed(spark.createDataFrame(tables[0], "doc_id long, text string"), "doc_id", "text")
    wanted = spark.createDataFrame([(i,) for i in range(10)], "token long").hint("merge")
    plan = D.shingle_places(docs, wanted, 3)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(x for x in plan.split("\n") if "Generate posexplode" in x)
    assert "words" not in generate and "text" not in generate
    assert D.shingle_places(docs, wanted, 3).columns == ["token", "k", "h", "at"]


def test_a_long_text_and_one_window_many_times(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, " ".join(f"w{i % 997}" for i in range(30_000)) + " " + item), (2, f"{item} . " * 2000), (3, item.replace("ten", "TEN"))]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("a", item)], "item_id string, text string")
    got = sorted((r.id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == [(1, 30_013, 13, ["a"], False), (2, 26_000, 26_000, ["a"], True), (3, 13, 13, ["a"], True)]
