"""The vectorised views of texts that all corpus operators rest on."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from loomtab.llm import blocks as B
from loomtab.llm.hashed import gram

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabé漢\x0b", max_size=30)), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 40), st.integers(0, 3))
def test_blocks_hold_every_document_once(rows, most, skip):
    column = pa.array([*["x"] * skip, *rows], pa.string()).slice(skip)
    got = {}
    for block in B.blocks(column, most):
        raw = block.data.tobytes()
        for i in range(len(block)):
            assert block.first + i not in got
            got[block.first + i] = raw[block.offsets[i] : block.offsets[i + 1]]
    assert [got[i] for i in range(len(rows))] == [(t or "").encode() for t in rows]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_and_their_hashes(rows):
    wanted, hashes = [], {}
    for block in B.blocks(pa.array(rows, pa.string())):
        starts, ends, counts = B.words(block)
        raw = block.data.tobytes()
        wanted += [raw[a:b] for a, b in zip(starts, ends)]
        assert counts.tolist() == [len((t or "").encode().split()) for t in rows]
        for h, a, b in zip(B.window_hash(B.prefix_hash(block.data), starts, ends).tolist(), starts, ends):
            assert hashes.setdefault(h, raw[a:b]) == raw[a:b]
    assert wanted == [w for t in rows for w in (t or "").encode().split()]
    assert len(hashes) == len(set(wanted))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=9), min_size=1, max_size=6), st.integers(1, 4))
def test_grams_stay_inside_documents(docs, n):
    flat = np.array([x for d in docs for x in d], np.uint64)
    h, counts = gram(flat, np.array([len(d) for d in docs]), n)
    wanted = [tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1)]
    assert counts.tolist() == [max(0, len(d) - n + 1) for d in docs]
    assert len(h) == len(wanted) and len(dict(zip(wanted, h.tolist()))) == len(set(h.tolist()))


def test_sums_by_document():
    assert B.per_document(np.array([2, 0, 3]), np.array([1, 2, 3, 4, 5])).tolist() == [3, 0, 12]
