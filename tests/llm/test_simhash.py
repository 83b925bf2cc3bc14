import random

import numpy as np
import xxhash
from loomtab.llm import simhash as S


def _fp(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(fps):
    root = {i: i for i in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_matches_brute_force(docs, awkward):
    got = S.simhash_groups(docs).collect()
    assert len(got) == len(awkward)
    fps = {i: _fp(t) for i, t in awkward}
    want = _components(fps)
    for row in got:
        assert row.fp % (1 << 64) == fps[row.id]
        assert row.component_id == want[row.id]
    assert len(set(want.values())) < len(want) - 3


def test_links_of_random_chains(spark):
    r = random.Random(3)
    fps = {}
    for i in range(40):
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            fps[len(fps)] = x
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    distinct = spark.createDataFrame(rows, "id long, fp long").groupBy("fp").min("id")
    from loomtab.llm.components import connected_components

    want = _components(fps)
    for hot in (S.HOT, 3, 0):  # lists by four bytes, some of them split, all of them split
        got = {x.node: x.root for x in connected_components(S.links(distinct.select("fp"), hot)).collect()}
        same = {}
        for i, fp in rows:
            same.setdefault(got.get(fp, fp), set()).add(want[i])
        assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(want.values()))


def test_all_pairs_within_reach_meet(spark):
    """Every pair of at most two differing bits shares a list; the tally drops pairs that met in one."""
    r = random.Random(7)
    fps = {r.getrandbits(64) for _ in range(150)}
    for x in list(fps):
        fps.add(x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
        fps.add(x ^ (r.getrandbits(24) << 40))  # three bytes apart
        fps.add(x & ~0xFFFF | r.getrandbits(16))
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    distinct = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    for hot in (S.HOT, 2):
        lists = {}
        for p in S.postings(distinct, hot).collect():
            lists.setdefault((p.choice, p.key), set()).add(p.fp % (1 << 64))
        met = {tuple(sorted((a, b))) for x in lists.values() for a in x for b in x if a < b}
        near = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
        assert near <= met
        if hot == S.HOT:
            pairs = np.array(sorted(met), np.uint64)
            retained = S.tally(pairs[:, 0] ^ pairs[:, 1]) >= S.SHARED
            assert 0 < retained.sum() < len(pairs)
            assert {tuple(map(int, p)) for p in pairs[S._near(pairs[:, 0], pairs[:, 1])]} == near


def test_lists_are_whole_across_batches():
    import pyarrow as pa

    r = np.random.default_rng(5)
    fp = np.sort(np.unique(r.integers(0, 1 << 12, 900).astype(np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), len(S.MASKS) - 1, np.int32)), pa.array(fp.view(np.int64))], ["choice", "fp"])
    whole = [x for b in S._links(iter([batch])) for x in zip(*b.to_pydict().values())]
    small = [x for b in S._links(iter([batch.slice(i, 50) for i in range(0, len(batch), 50)])) for x in zip(*b.to_pydict().values())]
    assert sorted(whole) == sorted(small) and whole


def test_large_key_is_linked_like_pairs():
    r = np.random.default_rng(1)
    members = np.unique(r.integers(0, 1 << 16, 400).astype(np.uint64))
    mask = int(S.MASKS[-1])
    shift = np.uint64(0) if mask >> 16 else np.uint64(48)
    members = np.sort(members << shift)
    a, b = S._star(members, mask)
    want = _components({i: int(x) for i, x in enumerate(members)})
    groups = len(set(want.values()))
    assert len(a) == len(members) - groups and {len({want[int(np.searchsorted(members, x))] for x in pair}) for pair in zip(a, b)} == {1}


def test_empty(spark):
    assert S.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
