"""Segmented scans, chunked streams, live tails, timers and merged files, with parts and batches of a few rows."""

import hashlib
import json
import random

import pytest
from loomtab.operators import events as E
from loomtab.operators import uploads as U
from loomtab.operators.ordered import dealt, neighbours
from loomtab.streaming import events as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def log():
    """One session with most of the rows, runs that cross parts, and small ones."""
    r = random.Random(6)
    rows = [(1, i, r.choices(["llm_chunk", "llm_complete", "stage_result", "report_chunk"], [8, 1, 1, 1])[0], None if i % 17 == 0 else f"é{i} ") for i in range(240)]
    return rows + [(2, 0, "llm_chunk", "a"), (3, 5, "llm_complete", "b"), (3, 6, "error", None), (None, 1, "llm_chunk", "x"), (None, 2, "llm_chunk", "y")]


def compacted(rows):
    out = []
    for session in {r[0] for r in rows}:
        own, run = sorted(r for r in rows if r[0] == session), []
        for i, (_, seq, kind, content) in enumerate(own):
            if kind == "llm_chunk":
                run.append((seq, content or ""))
                if i + 1 < len(own) and own[i + 1][2] == "llm_chunk":
                    continue
                if i + 1 == len(own) or own[i + 1][2] != "llm_complete":
                    out.append((session, run[0][0], "llm_chunk", "".join(c for _, c in run), len(run)))
                run = []
            else:
                out.append((session, seq, kind, content or "", 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [1_000_000, 25])
def test_compaction_over_parts(spark, log, rows):
    df = spark.createDataFrame(log, "session_id long, seq long, type string, content string").repartition(5)
    got = E.compact(df, rows=rows)
    assert sorted([(r.session_id, r.seq, r.type, r.content, r.n_merged) for r in got.collect()], key=str) == compacted(log)
    told = {r.session_id: (r.n_events, r.report, r.status) for r in E.fold(df, rows=rows).collect()}
    own = [x for x in log if x[0] == 1]
    assert told[1] == (240, "".join(c or "" for _, _, k, c in own if k == "report_chunk"), "done") and told[3][2] == "error"
    results = df.where("session_id = 1").select("session_id", "seq", (F.col("type") != "stage_result").alias("success"), F.col("seq").cast("string").alias("log"), F.col("content").alias("error"))
    up = E.rollup_results(results, "session_id", "seq", rows=rows).first()
    assert (up.success, up.logs, up.errors) == (False, "\n".join(str(i) for i in range(240)), [c for _, _, k, c in own if k == "stage_result" and c is not None])


def test_a_hot_session_is_many_tasks_work(spark, log):
    df = spark.createDataFrame(log, "session_id long, seq long, type string, content string")
    parts = dealt(df, ["session_id", "seq"], "test", 25)
    sizes = [r.n for r in parts.groupBy("part_").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 80
    near = {(r.session_id, r.seq): (r.prev_, r.next_) for r in neighbours(parts, ["session_id", "seq"], F.col("seq")).collect()}
    assert all(near[1, i] == (i - 1, i + 1) for i in range(1, 239)) and near[None, 1][0] is None
    plan = E.compact(df, rows=25)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("part_" in line for line in plan.split("\n") if "windowspecdefinition(session_id" in line)


def test_any_cut_of_a_stream_gives_the_same_events(spark):
    r = random.Random(8)
    said = [json.dumps({"i": i, "t": "é漢😀" * (i % 4)}, ensure_ascii=False) for i in range(40)]
    whole = "".join(r.choice([f"data: {s}\n\n", f"data:{s} \r\n", f": note\ndata: {s}\n", f"data: {s[1:]}\ndata: {s}\n"]) for s in said).encode() + b"data: {}"
    chunks = []
    for stream in range(3):
        cuts = sorted(r.sample(range(len(whole)), 60)) if stream else list(range(0, len(whole), 7))
        chunks += [(stream, k, whole[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(whole)], strict=True))]
    chunks.append((1, 1000, None))
    df = spark.createDataFrame(chunks, "stream long, seq long, data binary").repartition(3)
    got = {}
    for row in E.sse_chunks(df, rows=30).orderBy("place").collect():
        got.setdefault(row.stream, []).append((row.place, row.payload))
    lines = whole.decode().split("\n")
    want = [(i, x.strip()[5:].strip()) for i, x in enumerate(lines[:-1]) if x.strip().startswith("data:") and x.strip()[5:].strip()[0] == "{"]
    assert got == {0: want, 1: want, 2: want} and [p for _, p in want] == said


def _stream(spark, folder, batches, schema, make, mode="append"):
    """Rows that a stream gives for files that come one after another, one query run a batch."""
    (folder / "in").mkdir(parents=True, exist_ok=True)
    source = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = source.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start(f"{folder}/out")
        query.awaitTermination()
    return spark.read.schema(source.schema).parquet(f"{folder}/out")


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_chunks_over_batches(spark, tmp_path, few_partitions):
    whole = "data: {\"a\": \"é漢\"}\n\ndata: [1]\nnone\ndata: 2\ndata: {".encode()
    cut = [(s, k, whole[k * 5 : k * 5 + 5]) for s in (1, 2) for k in range(len(whole) // 5 + 1)]
    batches = [[c for c in cut if c[1] // 4 == b] for b in range(3)]
    got = _stream(spark, tmp_path, batches, "stream long, seq long, data binary", S.sse_stream)
    want = E.sse_chunks(spark.createDataFrame([c for b in batches for c in b], "stream long, seq long, data binary"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 4


def test_live_tail_over_batches(spark, tmp_path, few_partitions):
    log = [(s, v, "error" if (s, v) in {(1, 7), (2, 3), (3, 2), (1, 9)} else "x") for s in (1, 2, 3, 4) for v in range(1, 12)]
    seen = spark.createDataFrame([(1, 4), (2, 3), (3, 4), (4, 0)], "session_id long, seen long")
    batches = [[x for x in log if x[1] <= 3], [x for x in log if 3 < x[1] <= 6], [x for x in log if 5 < x[1] <= 8], [x for x in log if x[1] > 8]]  # version 6 comes twice
    schema = "session_id long, version long, type string"
    got = _stream(spark, tmp_path, batches, schema, lambda df: S.live_tail(df, seen))
    want = E.snapshot_then_tail(spark.createDataFrame(log, schema), seen).select("session_id", "version", "type", "part")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_uploads_expire_as_a_clock_ticks(spark, tmp_path, few_partitions):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    at = lambda hours: start + timedelta(hours=hours)
    made = lambda hours: json.dumps({"created_at": str(at(hours))})
    batches = [
        [(1, made(0), at(0)), (2, made(5), at(1)), (3, None, at(1)), (4, "{", at(1)), (5, '{"size": 1}', at(1)), (6, made(-30), at(1))],
        [(None, None, at(20))], [(7, made(10), at(21))], [(None, None, at(24))], [(None, None, at(24.5))], [(None, None, at(40))],
    ]
    schema = "upload_id long, manifest string, at timestamp"
    gone = []
    for k in range(1, len(batches) + 1):
        got = _stream(spark, tmp_path / "s", batches[k - 1 : k], schema, S.expiring)
        gone.append({r.upload_id: r.verdict for r in got.collect()})
    first = {3: "remove_missing", 4: "remove_corrupt", 5: "remove_corrupt", 6: "expired"}
    assert gone == [first, first, first, first, first | {1: "expired"}, first | {1: "expired", 2: "expired", 7: "expired"}]
    folders = spark.createDataFrame([x for b in batches for x in b if x[0]], schema)
    swept = U.sweep(folders, F.lit(str(at(40))).cast("timestamp")).where("verdict <> 'keep'")
    assert {r.upload_id: r.verdict for r in swept.collect()} == gone[-1]


def test_large_uploads_become_files(spark, tmp_path):
    r = random.Random(1)
    parts = {(u, k): r.randbytes(n) for u, sizes in {"a": (3 << 20, 1, 0, 1 << 20), "b": (5,), "c": (0,)}.items() for k, n in enumerate(sizes)}
    df = spark.createDataFrame([(u, k, bytes(x)) for (u, k), x in parts.items()] + [("a", 1, bytes(parts["a", 1]))], "upload_id string, part int, content binary").repartition(4)
    manifests = spark.createDataFrame([("a", 4, (4 << 20) + 1), ("b", 1, 6), ("c", 1, 0), ("d", 2, 3)], "upload_id string, total long, size long")
    got = {x.upload_id: x for x in U.merged_uploads(df, manifests, folder=str(tmp_path / "out")).collect()}
    whole = b"".join(parts["a", k] for k in range(4))
    assert (got["a"].outcome, got["a"].n_bytes, got["a"].sha256) == ("ok", len(whole), hashlib.sha256(whole).hexdigest())
    assert open(got["a"].path, "rb").read() == whole and open(got["c"].path, "rb").read() == b""
    assert {k: x.outcome for k, x in got.items()} == {"a": "ok", "b": "size", "c": "ok", "d": "incomplete"} and got["b"].path is None
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 16


def test_access_has_no_cross_join(spark):
    from loomtab.plans import queries

    for name in ("reachable_projects", "accessible_sessions", "accessible_in_project", "session_access"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_two_writers_and_one_that_fails(spark, tmp_path):
    import threading

    from loomtab.operators import commits as K

    path = f"file://{tmp_path}/t"
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    assert K.create(one(0), path) == 1
    with pytest.raises(K.Conflict):
        K._attempt(spark, path, lambda now: (K.write(spark, path, lambda x: x.unionByName(one(1))), now.unionByName(one(9)))[1])  # another write in between
    assert sorted(r.n for r in K.read(spark, path).collect()) == [0, 1]
    tried = []

    def late(now):
        tried.append(now.count())
        if len(tried) == 1:
            K.write(spark, path, lambda x: x.unionByName(one(2)))
        return now.unionByName(one(3))

    assert K.write(spark, path, late) == 4 and tried == [2, 3]  # what the other wrote is read again
    assert sorted(r.n for r in K.read(spark, path).collect()) == [0, 1, 2, 3]
    assert sorted(r.n for r in K.read(spark, path, 2).collect()) == [0, 1]
    with pytest.raises(ZeroDivisionError):
        K.write(spark, path, lambda now: 1 / 0)
    broken = F.udf(lambda n: 1 / 0, "int")
    with pytest.raises(Exception, match="division"):
        K.write(spark, path, lambda now: now.select(broken("n").alias("n")))
    assert K.versions(spark, path) == [1, 2, 3, 4] and len(list((tmp_path / "t/data").iterdir())) == 4  # nothing of those that failed
    with pytest.raises(KeyError):
        K.read(spark, path, 7)
    done = []
    threads = [threading.Thread(target=lambda n=n: done.append(K.write(spark, path, lambda x: x.unionByName(one(n))))) for n in (10, 11)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(done) == [5, 6] and sorted(r.n for r in K.read(spark, path).collect()) == [0, 1, 2, 3, 10, 11]


def test_joins_by_time_with_a_hot_key(spark):
    from datetime import datetime, timedelta

    from loomtab.operators import intervals as V

    r = random.Random(5)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s) if s is not None else None
    make = lambda n, first: [(first + i, r.choice([1, 1, 1, 2, None]), r.choice([None, *range(0, 400, 10)])) for i in range(n)]
    left, right = make(90, 0), make(80, 1000)
    frame = lambda rows: spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "id long, user long, t timestamp")
    got = V.within(frame(left), frame(right), "user", "t", 30_000_000)
    pairs = {(a[0], b[0]) for a in left for b in right if a[1] == b[1] and None not in (a[1], a[2], b[2]) and abs(a[2] - b[2]) <= 30}
    assert sorted((x.l_id, x.r_id) for x in got.collect()) == sorted(pairs) and "NestedLoop" not in got._jdf.queryExecution().toString()
    for rows in (1_000_000, 20):
        found = V.latest_before(frame(left), frame(right), "user", "t", "id", "id", rows=rows)
        best = {a[0]: max(((b[2], b[0]) for b in right if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and b[2] <= a[2]), default=(0, None))[1] for a in left}
        assert {x.id: x.before_ for x in found.collect()} == best


def test_sessions_and_two_streams_with_rows_out_of_order(spark, tmp_path, few_partitions):
    from datetime import datetime, timedelta

    from loomtab.streaming import windows as W

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[(1, at(0)), (1, at(50)), (2, at(10))], [(1, at(25)), (2, at(45))], [(1, at(200)), (2, at(100))], [(None, at(100_000))], [(None, at(200_000))]]
    schema = "user_id long, ts timestamp"
    got = _stream(spark, tmp_path / "s", batches, schema, lambda df: W.sessions(df, "30 minutes", "2 hours"))
    every = spark.createDataFrame([x for b in batches for x in b if x[0]], schema)
    assert sorted(map(tuple, got.where("user_id is not null").collect())) == sorted(map(tuple, W.sessions(every, "30 minutes", None).collect()))
    clicks = [(i, i % 2, at(13 * i)) for i in range(20)]
    buys = [(100 + i, i % 2, at(29 * i + 5)) for i in range(10)]
    wide = "event_id long, user_id long, ts timestamp"
    for name, rows in (("a", clicks), ("b", buys)):
        for half in (rows[::2], rows[1::2]):  # the second file has rows before those of the first
            spark.createDataFrame(half, wide).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    a, b = (spark.readStream.schema(wide).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{n}") for n in "ab")
    query = W.followed(a, b, "1 hour", "10 hours").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/st").trigger(availableNow=True).start(f"{tmp_path}/o")
    query.awaitTermination()
    assert query.recentProgress and max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 2 * 30  # both sides, rows and counts
    want = W.followed(spark.createDataFrame(clicks, wide), spark.createDataFrame(buys, wide), late=None)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_sketches_merge_without_the_rows(spark):
    from loomtab.operators import stats

    df = spark.range(30_000).select((F.col("id") % 20).alias("day"), (F.col("id") * 7 % 9000).alias("v"))
    states = stats.sketched(df, ["day"], "v")
    whole = stats.merged_sketches(states.withColumn("all", F.lit(1)), ["all"]).first()
    assert whole.n == 30_000 and abs(whole.distinct_values - 9000) < 3 * 1.04 / 128 * 9000
    assert stats.merged_sketches(states.where("day < 0"), ["day"]).count() == 0
