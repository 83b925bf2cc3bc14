import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from loomtab.llm import token_files as T
from loomtab.llm.wavelet import WaveletMatrix
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = P.path(T.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def _encode(texts):
    tokenizer = T.WordTokenizer(PATH)
    out = []
    for block in T.blocks(pa.array(texts, pa.string()), 4096):
        flat, counts = tokenizer.encode(block)
        out += [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    return out


def test_every_kind_of_character(library):
    r = random.Random(6)
    latin = [chr(c) for c in range(0x200) if chr(c) not in "'\x1c\x1d\x1e\x1f"]
    wide = [chr(c) for c in range(0x3100)]
    texts = [f"a{c}b {c}{c} 1{c}C" for c in wide[:0x600]]
    for alphabet in (latin, latin[:128], wide, "abc' sdtlvrem", "ÀÉß1²!? \n", "Σσ ΑΣ."):
        texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(120)]
    texts += ["", None, "<|endoftext|> x <|startoftext|>", "it's 'S HE'LL don't"]
    assert _encode(texts) == [library(t) for t in texts]


def test_files_hold_all_ids_in_order(spark, docs, awkward, library, tmp_path):
    where = f"file://{tmp_path}/{uuid.uuid4().hex}"
    T.write_shards(T.encode(T.in_order(docs, 3), PATH), where, 700)
    back = T.read_shards(spark, where)
    got = T.ids_of(back).orderBy("start").collect()
    want = sorted((i, len(library(t)) + 1, [*library(t), 1]) for i, t in awkward)
    assert [(r.id, r.n_tokens, list(memoryview(bytes(r.ids)).cast("I"))) for r in got] == want
    assert [r.start for r in got] == np.cumsum([0, *(w[1] for w in want)])[:-1].tolist()
    assert back.count() > 6
    flat = [x for w in want for x in w[2]]
    starts = dict(zip((r.start for r in back.collect()), (r.n for r in back.collect())))
    for r in got:  # what the planes say of each document's first token
        block = max(s for s in starts if s <= r.start)
        before = [i for i in range(block, r.start) if flat[i] == r.first_id]
        assert (r.first_id, r.n_before, r.previous) == (flat[r.start], len(before), before[-1] if before else None)
    asked = [0, 5, len(flat) - 1, len(flat), -1, 5, None, 700]
    seen = T.tokens_at(back, spark.createDataFrame([(x,) for x in asked], "position long")).collect()
    assert sorted(map(tuple, seen)) == [(x, flat[x]) for x in (0, 5, 700, len(flat) - 1)]
    tokens = [1, flat[0], flat[7], 48_000, 10**6]
    assert sorted(map(tuple, T.counts_of(back, tokens).collect())) == sorted((x, flat.count(x)) for x in set(tokens))
    assert sorted(map(tuple, T.occurrences_of(back, tokens).collect())) == sorted((x, i) for x in set(tokens) for i, y in enumerate(flat) if x == y)
    row = max(back.collect(), key=lambda b: b.n).asDict()
    m, ids = T.matrix(row), T.matrix(row).decode()
    for i in (0, len(ids) // 2, len(ids) - 1):
        assert m.access(i) == ids[i]
    assert m.count(1) == (ids == 1).sum() and m.select(1, 0) == int(np.flatnonzero(ids == 1)[0])


def test_query(spark, docs, awkward, library, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.ids_crc32) for r in T.op9_token_files(spark, str(tmp_path)).collect()}
    assert got == {(i, zlib.crc32(np.array([*library(t), 1], "<u4").tobytes())) for i, t in awkward}


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    r = np.random.default_rng(n)
    x = (r.zipf(1.4, n) % 3000).astype(np.uint32)
    for ids in (x, x * 0, x * 50):
        m = WaveletMatrix.build(ids)
        assert (m.decode() == ids).all()
        for v in {*ids[:20].tolist(), 7, 2**20}:
            at = np.flatnonzero(ids == v)
            assert m.count(v) == len(at) and m.rank(v, n // 2) == (ids[: n // 2] == v).sum()
            assert all(m.select(v, k) == at[k] for k in range(0, len(at), max(1, len(at) // 5)))
            with pytest.raises(IndexError):
                m.select(v, len(at))
        assert all(m.access(i) == ids[i] for i in range(0, n, max(1, n // 50)))
        assert (m.accesses(np.arange(n)) == ids).all()
        for v in {*ids[:5].tolist()}:
            assert (m.occurrences(v) == np.flatnonzero(ids == v)).all()


def test_small_blocks_and_memory(spark, awkward, library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    assert _encode([t for _, t in awkward]) == [library(t) for _, t in awkward]


def test_empty(spark, tmp_path):
    where = f"file://{tmp_path}/none"
    T.write_shards(T.encode(T.in_order(spark.createDataFrame([], "doc_id long, text string")), PATH), where)
    back = T.read_shards(spark, where)
    assert T.ids_of(back).collect() == T.counts_of(back, [1]).collect() == T.occurrences_of(back, [1]).collect() == []
    assert T.tokens_at(back, spark.createDataFrame([(0,)], "position long")).collect() == []


def test_pieces_of_equal_hash_have_their_own_ids(spark, library, tmp_path):
    """Two long words with one polynomial hash, and short ones that any hash may send to one slot."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [thue, other, f"{thue} x {other}", "a\0 a", "a", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq"]
    assert _encode(texts) == [library(t) for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ids_crc32 for r in T.op9_token_files(spark, str(tmp_path)).collect()}
    assert got == {i: zlib.crc32(np.array([*library(t), 1], "<u4").tobytes()) for i, t in enumerate(texts)}


def test_a_crowded_slot(monkeypatch):
    """Every piece has one hash: bytes alone tell them apart."""
    from loomtab.llm import pieces

    monkeypatch.setattr(pieces, "mix", lambda x: np.zeros_like(x) + np.uint64(7))
    data = np.frombuffer(b"aabbabaacaab", np.uint8)
    starts, ends = np.array([0, 2, 0, 4, 1, 6, 9]), np.array([2, 4, 2, 6, 2, 8, 11])
    index = pieces.PieceIndex(10)
    numbers, new = index.number(data, starts, ends)
    assert [new[i] for i in numbers] == [data[a:b].tobytes() for a, b in zip(starts, ends)]
    again, none = index.number(data, starts, ends)
    assert (again == numbers).all() and none == [] and len(set(new)) == len(new) == index.n


def test_ids_of_any_kind_and_groups_of_shards(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 2)
    monkeypatch.setattr(T, "BLOCK", 300)
    monkeypatch.setattr(T, "SMALL", 3)
    named = docs.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    T.write_shards(T.encode(T.in_order(named, 7), PATH), str(tmp_path / "a"), 500)
    T.write_shards(T.encode(T.in_order(named, 1), PATH), str(tmp_path / "b"))
    many, one = T.read_shards(spark, str(tmp_path / "a")), T.read_shards(spark, str(tmp_path / "b"))
    rows = lambda x: sorted((r.id, r.start, bytes(r.ids)) for r in T.ids_of(x).collect())
    assert rows(many) == rows(one) and many.count() > 7 and rows(many)[0][0] == "doc 1"
    asked = spark.range(0, 6000, 7).withColumnRenamed("id", "position")
    read = lambda x: {(r.position, r.token) for r in T.tokens_at(x, asked).collect()}
    assert read(many) == read(one) and len(read(many)) > 300
    assert "NestedLoop" not in T.tokens_at(many, asked)._jdf.queryExecution().toString()
