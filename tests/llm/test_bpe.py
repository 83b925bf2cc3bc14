import base64
import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from loomtab.llm import bpe as B

PATH = P.path(B.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents_as_the_library_encodes_them(spark, docs, awkward, library):
    got = B.decode(B.encode(docs, PATH), PATH).collect()
    assert sorted((r.id, bytes(r.decoded).decode()) for r in got) == sorted((i, t or "") for i, t in awkward)
    want = sorted((i, tuple(library.encode_ordinary(t or ""))) for i, t in awkward)
    assert sorted((r.id, tuple(memoryview(bytes(r.ids)).cast("I"))) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_every_kind_of_character(library):
    r = random.Random(2)
    bpe = B.load(PATH, P.PATTERN)
    everything = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    texts = ["".join(r.choice(everything) + r.choice([" ", "", "a", "1", "'s"]) for _ in range(3000)) for _ in range(5)]
    texts += ["x" + c + c + "y " + c for c in everything[:0x300]]
    for text in texts:
        pieces = bpe.pieces(text)
        assert "".join(pieces) == text
        flat, sizes = bpe.encode_pieces(pieces)
        assert flat.tolist() == library.encode_ordinary(text) and sizes.sum() == len(flat)


def test_all_of_unicode(library):
    """The pattern cuts every character as the tokenizer's library does, whatever kind each of them takes it for."""
    bpe = B.load(PATH, P.PATTERN)
    every = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    some = [c for c in every if c < 0x3500 or 0xA000 <= c < 0xD800 and c % 50 == 0 or 0xF000 <= c < 0x20000 or c % 997 == 0]
    for k in range(0, len(some), 5000):
        text = "".join(f"a{c}b {c}'s{c}{c}'s 1{c}2  {c}\n" for c in map(chr, some[k : k + 5000]))
        assert bpe.encode_pieces(bpe.pieces(text))[0].tolist() == library.encode_ordinary(text)


def test_a_very_long_piece(library):
    r = random.Random(4)
    bpe = B.load(PATH, P.PATTERN)
    for text in ("".join(r.choice("etaoinshrdlu") for _ in range(100_000)), "ab" * 60_000):
        assert bpe.encode_pieces([text])[0].tolist() == library.encode_ordinary(text)


def test_long_pieces(library, monkeypatch):
    r = random.Random(4)
    bpe = B.load(PATH, P.PATTERN)
    for n in (B.LONG - 1, B.LONG, B.LONG + 1, 3000):
        for alphabet in ("a", "ab", "etaoinshrdlu", " "):
            text = "".join(r.choice(alphabet) for _ in range(n))
            flat, _ = bpe.encode_pieces(bpe.pieces(text))
            assert flat.tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(awkward, library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    texts = [t for _, t in awkward]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], ["id", "text"]) for i, t in enumerate(texts)]
    out = [b.column(2)[0].as_py() for b in B.encode_batches(iter(batches), PATH, P.PATTERN)]
    assert [list(memoryview(x).cast("I")) for x in out] == [library.encode_ordinary(t or "") for t in texts]


def test_query_digests(spark, library, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    row = {r.doc_id: r for r in B.op3_bpe(spark, str(tmp_path)).collect()}[93]
    ids = library.encode_ordinary("ÀÉ ñandú — 漢字 😀 é")
    assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256("ÀÉ ñandú — 漢字 😀 é".encode()).hexdigest()


def test_empty(spark):
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
