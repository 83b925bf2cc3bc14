"""Column functions and operators against small independent folds in Python."""

import json
import os
import random

import pytest
from loomtab.functions import files as N
from loomtab.functions import text as T
from loomtab.operators import events as E
from loomtab.operators import mutations as M
from loomtab.operators import routing as R
from loomtab.operators import rules
from loomtab.operators import uploads as U
from loomtab.streaming import events as S
from pyspark.sql import functions as F


def _column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = [".bashrc", "a.tar.gz", "x/.y/z.TXT", "noext", "..a.b", "a.", "", "dir.d/file", "Ünï.Csv", "..", "a/b.c/"]


def test_extension(spark):
    assert _column(spark, NAMES, N.extension) == [os.path.splitext(n)[1].lower() for n in NAMES]


#: Upload names and what is stored for them.
SAFE = {
    "report.csv": "report.csv", "a\\b\\c d.txt": "c d.txt", "x/y/we?ird*name.pdf": "we_ird_name.pdf", "two  spaces__here.md": "two spaces_here.md", "数据 表.xlsx": "数据 表.xlsx",
    "  padded .txt": "padded.txt", "...": "file", "": "file", "a.?!": "a", "._x_. .csv": "x.csv", "Ünï.Csv": "Ünï.Csv", "a (1).csv": "a (1).csv", "dir/": "file", "q" * 300 + ".csv": "q" * 200,
}


def test_safe_name(spark):
    assert _column(spark, list(SAFE), N.safe_name) == list(SAFE.values())
    assert _column(spark, [None], N.safe_name) == ["file"]


def test_paths(spark):
    paths = ["a/b", "../a", "a/../../b", "", "/abs", "a/./b/..", None, "..", "a//b"]
    want = [bool((p or "").strip()) and not (p or "").startswith("/") and not os.path.normpath(p).startswith("..") for p in paths]
    assert _column(spark, paths, N.is_safe_relative) == want
    assert _column(spark, ["7/3/sessions/s1/raw/a", "7/s2/a"], N.session_of) == ["s1", "s2"]


def test_texts(spark):
    texts = ["", "  short ", "x" * 50, None, "a\nb", "a\n"]
    assert _column(spark, texts, lambda c: T.shorten(c, 40, "..")) == ["", "short", "x" * 20 + "..", "", "a\nb", "a"]
    assert _column(spark, texts, T.line_count) == [len((t or "").splitlines()) for t in texts]
    codes = ["```python\nx = 1\n```", "x", "", None, "```\ny\n```\n"]
    assert _column(spark, codes, T.unfence) == ["x = 1", "x", "", "", "y"]
    commands = ["python3 a/b.py", "python3 a.py ; ls", "python3 a.txt", "python3  x.py  ", "python3 $X.py"]
    assert _column(spark, commands, T.allowed_command) == ["a/b.py", None, None, "x.py", None]


def test_rules(spark):
    custom = [{"format_id": "own.mdx", "extensions": ["mdx", ".CSV"], "category": "text", "handler_id": "text", "priority": 1}, {"format_id": "off", "extensions": [".pdf"], "category": "text", "handler_id": "text", "enabled": False}]
    rows = [("a.mdx", None, None), ("b.csv", None, None), ("c.pdf", None, None), ("noext", "Text/Plain; charset=x", None), ("noext", None, "255044462d312e37"), ("x.zzz", None, None), ("y.json", "application/pdf", None)]
    files = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, path string, mime string, magic string")
    got = rules.resolve(files, rules.rules(spark, custom), mime=F.col("mime"), magic=F.col("magic")).orderBy("i").collect()
    assert [r.format_id for r in got] == ["own.mdx", "own.mdx", "builtin.document.pdf", "builtin.text.plain", "builtin.document.pdf", None, "builtin.text.structured"]
    assert got[5].category == "binary"
    off = rules.resolve(files, rules.rules(spark, disabled=("builtin.document.pdf",)))
    assert {r.i for r in off.where("category = 'binary'").collect()} >= {2}


def _compacted(log):
    out = []
    for seq, kind, content in log:
        if kind == "llm_chunk" and out and out[-1][1] == "llm_chunk":
            out[-1] = (out[-1][0], kind, out[-1][2] + content)
            continue
        while kind == "llm_complete" and out and out[-1][1] == "llm_chunk":
            out.pop()
        out.append((seq, kind, content))
    return out


@pytest.fixture(scope="module")
def logs():
    r = random.Random(4)
    return {s: [(i, r.choice(["llm_chunk", "llm_chunk", "llm_complete", "other"]), f"{i}|") for i in range(r.randrange(0, 30))] for s in range(40)}


def test_compaction(spark, logs):
    events = spark.createDataFrame([(s, *e) for s, log in logs.items() for e in log], "session_id long, seq long, type string, content string")
    got = {}
    for r in E.compact(events).orderBy("seq").collect():
        got.setdefault(r.session_id, []).append((r.seq, r.type, r.content))
    assert got == {s: _compacted(log) for s, log in logs.items() if log}


def test_stream_compaction_over_many_batches(spark, logs, tmp_path):
    for step in range(3):  # a file is a batch
        part = [(s, *e) for s, log in logs.items() for e in log if e[0] // 10 == step]
        spark.createDataFrame(part, "session_id long, seq long, type string, content string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(1.1)  # files are taken in order of their time
    seen = []
    stream = spark.readStream.schema("session_id long, seq long, type string, content string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = S.compact_stream(stream).writeStream.foreachBatch(lambda df, n: seen.append(df.toPandas())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(seen) >= 3
    import pandas as pd

    changes = spark.createDataFrame(pd.concat(seen), S.OUT)
    got = {}
    for r in S.snapshot(changes).orderBy("seq").collect():
        got.setdefault(r.session_id, []).append((r.seq, r.type, r.content))
    assert got == {s: _compacted(log) for s, log in logs.items() if log}


def test_watermarked_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id) AS ts, 'view' AS event_type FROM range(5)").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/e")
    query = S.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 5


#: What is set in a state (the rest is false or low), the decision, and the route it becomes.
ROUTES = [
    ("", "coder", "planner"), ("", "finish", "planner"), ("force", "worker", "planner"), ("plan", "worker", "reporter"), ("plan data", "worker", "coder"), ("plan data", "reporter", "coder"),
    ("plan code data", "reporter", "worker"), ("plan code data", "finish", "worker"), ("plan code ran data", "finish", "reporter"), ("plan data", "finish", "coder"), ("plan", "coder", "reporter"),
    ("plan code ran data done", "coder", "finish"), ("plan code ran data", "coder", "coder"), ("plan code ran failed data", "coder", "coder"), ("plan code ran failed data late_fixes", "coder", "worker"),
    ("plan code data late_steps", "worker", "reporter"), ("plan code ran data late_plans", "planner", "reporter"), ("plan data late_plans", "planner", "coder"), ("plan late_plans", "planner", "reporter"),
    ("plan code data after_coder", "coder", "worker"), ("plan code ran data force", "coder", "reporter"), ("plan", "planner", "planner"),
]


def test_routing(spark):
    """A few states by hand; all 20,480 are compared with SQL in test_queries."""
    rows = [
        (i, route, "coder" if "after_coder" in on else "", 24 if "late_steps" in on else 1, 4 if "late_plans" in on else 0, 5 if "late_fixes" in on else 0, *(k in on.split() for k in ("plan", "code", "ran", "failed", "data", "done", "force")))
        for i, (on, route, _) in enumerate(ROUTES)
    ]
    schema = "i int, route string, last string, invocations int, replans int, corrections int, plan boolean, code boolean, ran boolean, failed boolean, data boolean, done boolean, force boolean"
    got = R.clamp(spark.createDataFrame(rows, schema)).orderBy("i").collect()
    assert [r.route for r in got] == [want for _, _, want in ROUTES]
    assert got[0].rule == "needs_plan" and got[-1].rule is None


def test_uploads(spark):
    manifests = spark.createDataFrame([("u", 3, 10), ("none", 0, 0), ("v", 2, 8)], "upload_id string, total long, size long")
    parts = spark.createDataFrame([("u", 0, 4), ("u", 0, 4), ("u", 2, 2), ("u", 7, 4), ("u", -1, 4)], "upload_id string, part long, bytes long")
    got = {r.upload_id: (r.uploaded, r.missing, r.uploaded_bytes, r.progress) for r in U.status(manifests, parts).collect()}
    assert got == {"u": ([0, 2], [1], 6, 0.6), "none": ([], [], 0, 0.0), "v": ([], [0, 1], 0, 0.0)}
    clock = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:00:01') AS t(id, created_at)")
    assert [r.id for r in U.expired(clock, F.lit("2024-01-02 00:00:01").cast("timestamp")).collect()] == [1]


def test_mutations(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    staged = spark.createDataFrame([(2, "q"), (4, "s"), (4, "r")], "id int, v string")
    assert sorted(map(tuple, M.insert_if_absent(target, staged, ["id"]).collect())) == [(4, "r")]
    assert [r.id for r in M.delete_by_key(target, staged, ["id"]).collect()] == [1]
    changed = M.partial_update(target, spark.createDataFrame([(1, None, "no"), (2, "new", "no")], "id int, v string, secret string"), "id", ["v"])
    assert sorted(map(tuple, changed.collect())) == [(1, "a"), (2, "new")] and changed.columns == ["id", "v"]


def test_sse_keeps_text(spark):
    frame = _column(spark, [json.dumps({"a": "é"}, ensure_ascii=False)], T.sse)[0]
    assert frame == 'data: {"a": "é"}\n\n'


def test_names_of_a_batch(spark):
    from loomtab.operators import names

    uploads = spark.createDataFrame([("d", "a.csv", 1), ("d", "a.csv", 2), ("d", "a (1).csv", 3), ("e", "a.csv", 4), ("d", "x" * 250 + ".csv", 5), ("d", "x" * 250 + ".csv", 6)], "directory string, name string, ord int")
    existing = spark.createDataFrame([("d", "a.csv"), ("d", "b.csv"), ("e", None)], "directory string, name string")
    got = {r.ord: (r.stored, r.renamed) for r in names.allocate(uploads, existing).collect()}
    assert got[1] == ("a (1).csv", True) and got[2] == ("a (2).csv", True) and got[3] == ("a (1) (1).csv", True) and got[4] == ("a.csv", False)
    assert got[5][0] == ("x" * 250 + ".csv")[:200] and got[6][0] != got[5][0] and len(got[6][0]) <= 200


def _one_by_one(uploads, existing):
    """Names as a folder would give them, one upload after another."""
    from loomtab.functions.files import NAME_LIMIT

    used, out = {}, {}
    for d, n in existing:
        used.setdefault(d, set()).add(n)
    for d, name, o in sorted(uploads, key=lambda u: u[2]):
        taken, n, made = used.setdefault(d, set()), 0, name
        dot = name.rfind(".")
        first, end = (name[:dot], name[dot:]) if dot > 0 and name[:dot].strip(".") else (name, "")
        while made in taken:
            n += 1
            made = first[: max(1, NAME_LIMIT - len(f" ({n})") - len(end))] + f" ({n}){end}"
        taken.add(made)
        out[o] = made
    return out


def test_unique_names_like_a_folder(spark):
    import random

    from loomtab.operators import names

    r = random.Random(2)
    pool = ["a.csv", "a (1).csv", "a (1) (1).csv", "a (2).csv", "A.csv", "a.CSV", "a", "a (1)", "b.csv", "b (7).csv", "b (08).csv", "x" * 196 + ".csv", "x" * 192 + " (1).csv", "y" * 150 + "." + "e" * 40, "y (1" + "z" * 190]
    existing = [(d, n) for d in "pqr" for n in r.sample(pool, 7)] + [("q", f"b ({i}).csv") for i in (0, 1, 2, 5, 6)] + [("q", "b.csv"), ("h", "c (3).csv")]
    uploads = [(r.choice("pqr"), r.choice(pool), i) for i in range(250)] + [("h", "c.csv", 1000 + i) for i in range(300)] + [(None, "c.csv", 2000), (None, "c.csv", 2001)]
    frame = spark.createDataFrame([(*u, "kept") for u in uploads], "directory string, name string, ord int, taken_ string").repartition(5)
    got = names.allocate(frame, spark.createDataFrame(existing, "directory string, name string"))
    assert got.columns == ["directory", "name", "ord", "taken_", "safe", "stored", "renamed"]
    rows = got.collect()
    assert {x.ord: x.stored for x in rows} == _one_by_one(uploads, existing) and len(rows) == len(uploads)
    assert all(x.renamed == (x.stored != x.safe) and x.taken_ == "kept" for x in rows)
    again = [("d", "a (1).csv", 1)], [("d", "a (1).csv"), ("d", "a (1) (1).csv")]
    one = names.allocate(spark.createDataFrame(again[0], "directory string, name string, ord int"), spark.createDataFrame(again[1], "directory string, name string")).first()
    assert one.stored == "a (1) (2).csv"


def test_unique_names_in_parts(spark):
    """Names that compete over several rounds, with lists and taken numbers cut into partitions of a few rows."""
    import random

    from loomtab.operators import names

    for seed in (1,):
        r = random.Random(seed)
        pool = ["a.csv", *(f"a ({i}).csv" for i in range(1, 9)), "a (1) (1).csv", "a (2) (1).csv", "x" * 196 + ".csv", "x" * 192 + " (1).csv", "x" * 192 + " (2).csv"]
        weights = [30, *[3] * 8, 4, 2, 12, 4, 3]
        existing = [("p", n) for n in r.sample(pool, 4)]
        uploads = [(r.choice("pq"), n, i) for i, n in enumerate(r.choices(pool, weights, k=70))]
        got = names.allocate(spark.createDataFrame(uploads, "directory string, name string, ord int"), spark.createDataFrame(existing, "directory string, name string"), rows=50)
        assert {x.ord: x.stored for x in got.collect()} == _one_by_one(uploads, existing)


def test_unique_names_have_a_small_plan(spark):
    from loomtab.plans import queries

    df = queries()["unique_names"](spark, "/root/testdata/sf0.001")
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000


def test_places_over_partitions(spark):
    from loomtab.operators.ordered import in_order

    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.lit("hot").alias("key"), F.lit("mine").alias("n_x"))
    got = in_order(df, ["key", "x"], "places", F.col("x"), rows=30)
    rows = got.collect()
    assert len({r.part_ for r in rows}) > 10
    assert all(r.place_ == r.x and r.sum_ == r.x * (r.x + 1) // 2 for r in rows)
    assert in_order(df.limit(0), ["key", "x"], "places").count() == 0


def test_digest_handlers(spark):
    import io
    import struct
    import zipfile

    from loomtab.operators import digest

    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f'<w:document xmlns:w="{word}"><w:body>{p("Hello")}{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr><w:tr><w:tc>{p("")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", 16, 8, 8, 2)
    files = spark.createDataFrame([("d.docx", "document_docx", raw.getvalue()), ("broken.docx", "document_docx", b"no zip"), ("i.png", "image", png), ("p.pdf", "document_pdf", b"%PDF"), ("x.bin", "binary", None)], "path string, handler_id string, content binary")
    got = {r.path: r for r in digest.digests(files).collect()}
    assert json.loads(got["d.docx"].digest) == {"paragraph_count": 1, "table_count": 1, "preview": "Hello\n\n[表1]\na | b", "preview_truncated": False}
    assert got["broken.docx"].digest is None and "BadZipFile" in got["broken.docx"].error
    assert json.loads(got["i.png"].digest) == {"format": "PNG", "width": 16, "height": 8, "mode": "RGB"} and got["x.bin"].size_bytes == 0
    digest.register("own", lambda path, content: {"n": len(content)})
    assert "own" in digest.handlers() and json.loads(digest.digests(files.limit(1).selectExpr("path", "'own' handler_id", "content")).first().digest)["n"] > 0


def test_quantiles_against_numpy(spark):
    import numpy as np
    from loomtab.operators import stats

    r = np.random.default_rng(3)
    a, b = r.normal(size=1001).round(2).tolist(), [7.0] * 900 + r.integers(0, 5, 101).astype(float).tolist()
    c = [None if i % 3 else float(i) for i in range(1001)]
    frame = spark.createDataFrame(list(zip(a, b, c, [None] * 1001)), "a double, b double, c double, d double").repartition(5)
    got = {x.column_name: x.quantiles for x in stats.quantiles(frame, ["a", "b", "c", "d"], (0.0, 0.1, 0.25, 0.5, 0.99, 1.0)).collect()}
    for name, values in (("a", a), ("b", b), ("c", [x for x in c if x is not None])):
        assert np.allclose(got[name], np.quantile(values, [0, 0.1, 0.25, 0.5, 0.99, 1])), name
    assert "d" not in got
    assert {x.column_name: x.p50 for x in stats.describe(frame, ["a", "d"]).collect()}["d"] is None


def test_memory_texts(spark):
    from loomtab.operators import memory
    from pyspark.sql import functions as F

    nested = {"files": {"a.csv": {"shape": [3, 2], "columns": ["x", "y"], "deep": {"er": {"est": {"of": {"all": None}}}}, "ok": True, "preview": "l1\nl2"}}, "items": [{"n": 1}, [], "s"], "none": [], "long": "z" * 241}
    want = (
        "## files\n\n### a.csv\n\n#### shape\n\n- 3\n- 2\n\n#### columns\n\n- x\n- y\n\n#### deep\n\n##### er\n\n###### est\n\n###### of\n\n###### all\n\n（无）\n\n#### ok\n\n是\n\n#### preview\n\n```\nl1\nl2\n```\n\n"
        "## items\n\n### 第 1 项\n\n#### n\n\n1\n\n### 第 2 项\n\n（空）\n\n### 第 3 项\n\ns\n\n## none\n\n（空）\n\n## long\n\n```\n" + "z" * 241 + "\n```\n\n"
    )
    frame = spark.createDataFrame([(json.dumps(nested),), ("{broken",), (None,)], "d string")
    assert [x[0] for x in frame.select(memory.digest_markdown("d")).collect()] == [want, None, None]
    results = F.array(F.struct(F.lit("a.py").alias("path"), F.lit(False).alias("success"), F.lit(1).alias("returncode"), F.lit("").alias("stdout"), F.lit("e" * 3000).alias("stderr")))
    text = spark.range(1).select(memory.worker_section(F.lit(False), F.array(F.lit("m"), F.lit("")), results, F.lit(" log "))).first()[0]
    assert text == "- 整体成功: False\n- 汇总错误: m\n- 文件 `a.py`: success=False, returncode=1\n  - stderr 摘录:\n```\n" + "e" * 2480 + "\n…（已截断）\n```\n- 聚合日志摘录:\n```\nlog\n```"


def test_info_text_is_what_a_data_frame_prints(spark):
    import io

    import pandas as pd
    from loomtab.operators import stats

    frames = [
        pd.DataFrame({"a": [1, 2, 3], "a long name": ["x", None, "z"], "f": [1.5, None, 2.0], "b": [True, False, True], "t": pd.to_datetime(["2024-01-01"] * 3)}),
        pd.DataFrame({f"c{i}": [i] for i in range(12)}), pd.DataFrame({f"c{i}": [i] for i in range(101)}), pd.DataFrame({"only": ["x"] * 30}),
    ]
    for frame in frames:
        out = io.StringIO()
        frame.info(buf=out, memory_usage=False)
        df = spark.createDataFrame([tuple(None if pd.isna(x) else x.to_pydatetime() if hasattr(x, "to_pydatetime") else x.item() if hasattr(x, "item") else x for x in row) for row in frame.itertuples(index=False)],
                                   ", ".join(f"`{c}` {({'int64': 'long', 'float64': 'double', 'bool': 'boolean'}).get(str(t), 'timestamp' if 'date' in str(t) else 'string')}" for c, t in frame.dtypes.items()))
        assert stats.info_text(df).first().info == out.getvalue()
    nulls = spark.createDataFrame([(None, None), (1, True)], "n long, b boolean")
    assert "float64(1), object(1)" in stats.info_text(nulls).first().info
    assert "0 entries\n" in stats.info_text(nulls.limit(0)).first().info
