"""Importance resampling against plain Python and its SQL."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from loomtab.llm import resampling


def brute(rows, target, buckets=10_000, grams=1, share=10, least=20):
    def words(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower).split(" ")

    def features(text):
        w = [x for x in words(text) if x]
        return w, [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    own, goal = [features(t) for _, t in rows], Counter(b for t in target for b in features(t)[1])
    all_ = Counter(b for _, f in own for b in f)
    s, t = sum(all_.values()) + buckets, sum(goal.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1.0) * s / ((all_[b] + 1.0) * t)))
    out = []
    for (key, _), (w, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for i, x in enumerate(able[: share * len(able) // 100]):
        x[4] = i + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def found(df):
    return sorted(((r.id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


@pytest.mark.parametrize(("buckets", "grams", "share", "least"), [(10_000, 1, 10, 20), (97, 2, 60, 3), (65_536, 3, 100, 0)])
def test_draw_is_that_of_plain_python(spark, docs, awkward, buckets, grams, share, least):
    goal = ["word3 WORD4 word5, and others", None, "", "漢字 word3"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(goal)], "item_id int, text string")
    got = resampling.resample(docs, target, buckets=buckets, grams=grams, share=share, least=least)
    assert found(got) == brute(awkward, goal, buckets, grams, share, least)


def test_streams_are_cut_at_documents(spark, docs, awkward, monkeypatch):
    whole = {r.bucket: r.n for r in resampling.counts(resampling.streams(docs, "doc_id", "text")).collect()}
    monkeypatch.setattr(resampling, "STREAM", 50)
    pack = resampling._packer(10_000, 1)
    import pyarrow as pa

    made = list(pack(iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in awkward]), pa.array([t for _, t in awkward])], ["id", "text"])])))
    assert [i for b in made for i in b.column(0)[0].as_py()] == [i for i, _ in awkward]
    assert len(made) > 10
    runs = [resampling.run_lengths(np.frombuffer(b.column(3)[0].as_py(), "<u2")) for b in made]
    at, n = resampling.merged_runs(runs)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == whole


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, 9, 9), (None, "b b", 8, 8, 8)], "doc_id long, text string, score int, row int, total int")
    none = spark.createDataFrame([], "item_id int, text string")
    assert found(resampling.resample(docs, none, least=0, share=100)) == brute([(1, "a b c"), (None, "b b")], [], share=100, least=0)
    assert resampling.resample(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        resampling.streams(docs, "doc_id", "text", 70_000)


def test_ties_and_repeated_rows_take_one_rank_each(spark):
    rows = [(7, "same words here")] * 5 + [(2, "same words here")] * 2
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "same")], "item_id int, text string"), share=100, least=1)
    assert sorted(r.rank for r in got.collect()) == list(range(1, 8))


def test_runs_of_random_values():
    r = random.Random(2)
    for size in (0, 1, 2, 1000):
        values = np.array([r.randrange(50) for _ in range(size)], np.uint16)
        at, n = resampling.run_lengths(values)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == Counter(values.tolist())
