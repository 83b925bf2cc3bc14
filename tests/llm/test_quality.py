import random
import re

import numpy as np
import pytest
from loomtab.llm import quality as Q


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    good = [" ".join(r.choice("the of and rend stone river light".split()) for _ in range(r.randrange(30, 90))) for _ in range(150)]
    bad = [" ".join(r.choice("BUY!! NOW!! CHEAP!! $$$ || ###".split()) + str(r.randrange(99)) for _ in range(r.randrange(30, 90))) for _ in range(80)]
    texts = [(i, t) for i, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in texts if i % 4] + [(None, 1), (9999, 0), (1, None)], "doc_id long, quality int")
    return docs, labels


def test_base_counts(docs, awkward):
    got = sorted(tuple(r)[:7] for r in Q.judge(docs, None).drop("quality_score").collect())
    assert got == sorted((i, *_base(t)) for i, t in awkward)


def test_held_out_verdicts(labelled):
    docs, labels = labelled
    got = {r.id: r for r in Q.judge(docs, Q.fitted(docs, labels)).collect()}
    held = [i for i in got if i % 4 == 0]
    right = [got[i].kept == (i < 150) for i in held if not got[i].base_failed]
    assert len(right) > 40 and np.mean(right) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in got.values())


def test_bound_on_the_sample(labelled):
    docs, labels = labelled
    assert Q.sample(docs, labels, "quality", 20).count() <= 20


def test_calibration_is_a_minimum():
    r = np.random.default_rng(0)
    z = r.normal(0, 15, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.4 * z - 1)))).astype(float)
    c = Q.calibrate(z, y)
    assert abs(c["slope"] - 0.4) < 0.05 and abs(c["offset"] + 1) < 0.15
    c = Q.calibrate(np.array([-20.0] * 50 + [20.0] * 50), np.array([0.0] * 50 + [1.0] * 50))
    assert c["slope"] > 0


def test_rows_kept_whole(spark, labelled):
    docs, labels = labelled
    odd = docs.selectExpr("doc_id", "text", "1 as kept", "2 as id", "cast(3 as long) as n_words")
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3)}


def test_empty_tables_and_no_labels(spark, labelled):
    docs, labels = labelled
    none = spark.createDataFrame([], docs.schema)
    assert Q.judge(none, Q.fitted(none, labels)).collect() == []
    assert Q.fitted(docs, labels.where("quality = 1")) is None


def test_words_of_equal_hash_are_not_equal(spark):
    """A word over a and b and its complement have one polynomial hash; their windows are no repeats."""
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [(1, " ".join([thue] + list("cdefghi") + [other] + list("cdefghi"))), (2, " ".join([thue] * 9 + [other] * 12)), (3, " ".join([thue, *"0123456", other] * 9))]
    got = sorted(tuple(r)[:7] for r in Q.judge(spark.createDataFrame(texts, "doc_id long, text string"), None).drop("quality_score").collect())
    assert got == [(i, *_base(t)) for i, t in texts]
    assert got[0][5] == 0


def test_verdicts_against_a_dense_form(spark, labelled):
    """Scores by dense counts of the same buckets, mean by kind, then the fitted scaling and threshold."""
    import pyarrow as pa

    docs, labels = labelled
    model = Q.fitted(docs, labels)
    w = np.frombuffer(model["weights"], np.float32).astype(float)
    for r in Q.judge(docs, model, carry=True).collect():
        z = model["bias"]
        for block in Q.blocks(pa.array([r.text], pa.string())):
            for index, _ in Q.features(block, Q.SPEC):
                counts = np.bincount(index, minlength=len(w))
                z += Q._SCALE * (counts @ w) / max(counts.sum(), 1)
        p = 1 / (1 + np.exp(-(model["slope"] * z + model["offset"])))
        assert abs(p - r.quality_score) < 1e-4
        assert r.base_failed == _base(r.text)[5]
        assert abs(p - Q.THRESHOLD) < 1e-3 or r.kept == (not r.base_failed and p >= Q.THRESHOLD)
