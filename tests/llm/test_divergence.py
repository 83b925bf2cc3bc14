"""The source audit against plain Python, with blocks, chunks and bands of few rows."""

import random
from collections import Counter

import numpy as np
import pytest
from loomtab.llm import divergence


def brute(rows, least=10, top=10):
    """(lang, source, text) rows -> sorted (lang, source, part, item, value, rank)."""
    docs = []
    for lang, source, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in lower).split(" ")))
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, Counter(w for w in words if w)) for la, s, words in docs if la == lang]
        held = Counter(t for _, c in own for t in c)
        kept = [t for t, n in held.items() if n >= least]
        total = {s: Counter() for s, _ in own}
        for s, c in own:
            total[s].update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in total.items()}, share(sum(total.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in total:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in total if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if total[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, value, rank + 1))
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfgé" for b in ("a", "e", "oo", "漢")]
    out = [(None, None, None), ("en", "s0", ""), ("en", "empty", "12 34"), ("xx", "alone", "ba ba")]
    for _ in range(160):
        n = r.randrange(23)
        out.append((r.choice(("en", "en", "de", None)), f"s{min(r.randrange(9), r.randrange(9))}", " ".join(r.choice(words[n % 7 :]).title() if n == 3 else r.choice(words[n % 7 :]) for _ in range(n))))
    return out + out[-3:]


@pytest.mark.parametrize(("block", "chunk", "band"), [(16, 4096, 64), (2, 3, 64), (3, 2, 1)])
def test_audit_is_that_of_plain_python(spark, rows, monkeypatch, block, chunk, band):
    monkeypatch.setattr(divergence, "BAND", band)
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "lang string, source string, text string, block int, n int, term int").repartition(3)
    assert found(divergence.audit(df, least_docs=5, block=block, chunk=chunk)) == brute(rows, 5)


def test_counts_that_are_sent_in_parts_are_the_same(spark, rows, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batches = [pa.RecordBatch.from_arrays([pa.array([lang or ""]), pa.array([source or ""]), pa.array([text or ""])], ["a", "b", "c"]) for lang, source, text in rows]
    parts = list(divergence._counted(iter(batches)))
    assert len(parts) > 20
    sums = Counter()
    for p in parts:
        for lang, source, term, n, _ in zip(*(c.to_pylist() for c in p.columns), strict=True):
            sums[lang, source, term.decode()] += n
    df = spark.createDataFrame([tuple(x or "" for x in r) for r in rows], "lang string, source string, text string")
    assert {(r.lang, r.source, r.term): r.n for r in divergence.term_counts(df).collect()} == sums


def test_no_kept_terms_and_no_rows(spark):
    rows = [("en", "a", "one"), ("en", "b", "two"), ("en", "ä", None)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.audit(df)) == brute(rows)
    assert len(found(divergence.audit(df))) == 6
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    r = random.Random(1)
    for _ in range(200):
        size = r.randrange(1, 9 * 10**15)
        n = r.randrange(size)
        assert divergence.shares(np.array([n]), size)[0] == 1 + 10**9 * (n + 2) // size
