import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from loomtab.llm import substrings as S
from loomtab.llm.blocks import blocks


def _brute(docs, length):
    """docs: (id, bytes) in order, without repeated rows -> id -> removed bytes as a set."""
    seen, out = set(), {}
    for i, text in docs:
        gone = set()
        for p in range(len(text) - length + 1):
            w = text[p : p + length]
            if w in seen:
                gone.update(range(p, p + length))
            seen.add(w)
        out.setdefault(i, []).append((text, gone))
    return out


def _runs(gone):
    runs = []
    for p in sorted(gone):
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    return [tuple(r) for r in runs]


@pytest.fixture(scope="module")
def rows(awkward):
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abcde é") for _ in range(n))
    passage, line = say(260), say(110)
    more = [(200 + i, say(r.randrange(0, 200)) + passage[r.randrange(80) : r.randrange(170, 260)] + say(r.randrange(0, 90)) + line) for i in range(30)]
    more += [(300, passage + passage), (301, "a" * 500), (302, "ab" * 200), (303, "a" * 99), (304, say(99)), (305, passage[:100]), (306, "x" + passage[:99])]
    return [*awkward, *more]


def test_matches_brute_force(spark, rows, tmp_path):
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = S.remove_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert len(got) == len(rows)
    once = sorted({(i, (t or "").encode()) for i, t in rows})
    want = _brute(once, S.LENGTH)
    for r in got:
        text, gone = want[r.id][0]
        assert r.n_bytes == len(text)
        assert [tuple(x) for x in r.spans] == _runs(gone), r.id
        assert bytes(r.kept) == bytes(b for p, b in enumerate(text) if p not in gone)
    assert sum(bool(r.spans) for r in got) > 30
    digests = {r.doc_id: r for r in S.op2_substrings(spark, str(tmp_path)).collect()}
    for r in got:
        d = digests[r.id]
        assert d.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
        assert (d.n_removed, d.n_spans) == (sum(b - a for a, b in r.spans), len(r.spans))


def test_equal_strings_have_equal_minimizers(rows):
    column = pa.array([t for _, t in rows], pa.string())
    seen = {}
    for block in blocks(column, 3000):
        owner, place, a, b, fp = S.segments(block)
        raw = block.data.tobytes()
        assert (np.diff(owner) >= 0).all()
        assert (b - a + 1).sum() == sum(max(0, n - S.LENGTH + 1) for n in np.diff(block.offsets))
        for m, x, y, f in zip(place, a, b, fp):
            for p in range(x, y + 1):
                assert p <= m and m + S.K <= p + S.LENGTH
                assert seen.setdefault(raw[p : p + S.LENGTH], (m - p, f)) == (m - p, f)


def _later(texts, rank, length, memory, base):
    """Starts of later strings by text, as the shard of one task finds them."""
    shard = S._Shard(memory)
    for i in range(0, len(texts), 7):
        shard.add(pa.array(texts[i : i + 7], pa.binary()))
    data, ends = shard.done()
    at = np.concatenate(list(S.later_starts(data, ends, np.array(rank), length, memory, base)))
    doc = np.searchsorted(ends, at)
    return [(at[doc == i] - (ends[i] - len(t))).tolist() for i, t in enumerate(texts)]


@pytest.mark.parametrize("memory", [300, 1 << 20])
def test_later_starts_in_a_shard(rows, memory):
    texts = sorted({(t or "").encode() for _, t in rows if t and len(t) < 1500})
    r = random.Random(1)
    r.shuffle(texts)
    want = _brute(list(enumerate(texts)), 40)
    for got, i in zip(_later(texts, range(len(texts)), 40, memory, 100), range(len(texts)), strict=True):
        text, gone = want[i][0]
        assert {q for p in got for q in range(p, p + 40)} == gone
    twice = _later(texts + texts[:5], [*range(len(texts)), *range(5)], 40, memory, 100)
    assert twice[: len(texts)] == _later(texts, range(len(texts)), 40, memory, 100) and twice[len(texts) :] == twice[:5]


def test_a_shard_of_many_times_the_memory(tmp_path, monkeypatch):
    """Text, types, numbers, queues and flags are in files; names are sorted by recursion; nothing stays."""
    from loomtab.llm import induced as I

    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40)).encode()
    texts = [" ".join(r.choice(words) for _ in range(1500)).encode() + passage * (i % 3) for i in range(25)]
    memory, before, recursions = 1 << 14, I.Store.spilled, []
    deeper = I.suffix_array
    monkeypatch.setattr(I, "suffix_array", lambda *a: (recursions.append(len(a[0])), deeper(*a))[1])
    got = _later(texts, range(len(texts)), 100, memory, 64)
    total = sum(map(len, texts))
    assert total > 10 * memory and I.Store.spilled - before > 10 * total and len(recursions) >= 2
    want = _brute(list(enumerate(texts)), 100)
    for i, starts in enumerate(got):
        assert {q for p in starts for q in range(p, p + 100)} == want[i][0][1]
    assert list(tmp_path.iterdir()) == []


def test_queues_spill_in_a_query(spark, rows, monkeypatch):
    """Tasks of the operator itself use files where their bound is small, with the same result."""
    from loomtab.llm import induced as I

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((r.id, r.spans) for r in S.remove_repeats(frame).collect())
    column = pa.array([t.encode() for _, t in rows if t], pa.binary())
    n = len(column)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), column], ["key", "k", "h", "start", "bytes"])
    found = []
    for memory in (1 << 24, 1 << 12):
        monkeypatch.setattr(S, "MEMORY", memory)
        monkeypatch.setattr(S.later_starts, "__defaults__", (S.LENGTH, memory, 64))
        before = I.Store.spilled
        found.append([b.to_pydict() for b in S._compared(iter([batch]))])
        assert (I.Store.spilled > before) == (memory < 1 << 20)
    assert found[0] == found[1] and want


def test_hot_minimizers_are_dealt_by_context(rows):
    for _, text in rows:
        raw = (text or "").encode()
        block = next(iter(blocks(pa.array([raw], pa.binary()))))
        for _, _, a, b, fp in zip(*(x.tolist() for x in S.segments(block)), strict=True):
            parts = S._by_context(pa.py_buffer(raw), fp, a, b + S.LENGTH)
            covered = sorted(p for _, s, part in parts for p in range(s, s + len(part) - S.LENGTH + 1))
            assert covered == list(range(a, b + 1))
            assert all(raw[s : s + len(part)] == part for _, s, part in parts)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_strings_meet_when_hot(rows):
    """Pieces of every segment, as if all were hot: equal strings have equal keys."""
    keys = {}
    for _, text in rows:
        raw = (text or "").encode()
        block = next(iter(blocks(pa.array([raw], pa.binary()))))
        for _, _, a, b, fp in zip(*(x.tolist() for x in S.segments(block)), strict=True):
            for key, s, part in S._by_context(pa.py_buffer(raw), fp, a, b + S.LENGTH):
                for p in range(len(part) - S.LENGTH + 1):
                    assert keys.setdefault(part[p : p + S.LENGTH], key) == key


def test_stretches_of_equal_polynomial_hash_stay(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(1, thue), (2, other), (3, thue[:300]), (4, "x" + other[500:900])]
    want = _brute([(i, t.encode()) for i, t in rows], S.LENGTH)
    for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert [tuple(x) for x in r.spans] == _runs(want[r.id][0][1])
