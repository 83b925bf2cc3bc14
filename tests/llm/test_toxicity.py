import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from loomtab.llm import toxicity as X


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    words = [f"{a}{b}" for a in "stone river light of the and rend".split() for b in "abcdefgh"]
    bad = ["scumbag", "morondus", "wretchly"]
    rows = []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randrange(10, 80))]
        if i % 6 == 0:
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    got = {r.id: r.score for r in X.score(docs, X.fitted(docs, labels)).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    right = [(got[i] >= 0.5) == (i % 6 == 0) for i in held]
    assert np.mean(right) > 0.97


def test_labels_outside_training_folds_do_not_count(spark, corpus):
    docs, labels = corpus
    changed = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = X.fitted(docs, labels), X.fitted(docs, changed)
    assert a == b


def test_nulls_repeats_and_clashing_names(spark, docs, corpus):
    model = X.fitted(*corpus)
    odd = docs.selectExpr("doc_id", "text", "1 as score", "'x' as id", "0 as label")
    got = X.score(odd, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id == 8}) == 1


def test_without_positives_or_rows(spark, corpus):
    docs, labels = corpus
    assert X.fitted(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in X.score(docs.limit(5), None).collect()} == {0.0}
    none = spark.createDataFrame([], docs.schema)
    assert X.score(none, X.fitted(none, labels)).collect() == []


def test_risk_is_corrected_by_the_prior():
    r = random.Random(2)
    say = lambda bad: " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(20)) + " nasty" * bad
    model = X.train([say(1) for _ in range(200)], [say(i % 5 == 0) for i in range(1000)], 0.2)
    z = [X.scores(X.features(next(X.blocks(X.pa.array([t]))), X.SPEC), np.frombuffer(model["weights"], np.float32), model["bias"], mean=False)[0] for t in (say(1), say(0))]
    assert z[0] > 0 > z[1]


def test_training_steps_against_a_dense_form():
    """The risk and its gradient written out for dense counts of the same buckets, stepped likewise."""
    from loomtab.llm.hashed import Adam, features, sigmoid

    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    say = lambda low, high: " ".join(words[i] for i in r.integers(low, high, 25))
    positive, unlabelled, prior = [say(0, 22) for _ in range(12)], [say(10, 40) for _ in range(20)], 0.2
    model = X.train(positive, unlabelled, prior)
    counts = np.zeros((32, 1 << X.SPEC.bits))
    for i, text in enumerate([*positive, *unlabelled]):
        for block in X.blocks(pa.array([text], pa.string())):
            for index, _ in features(block, X.SPEC):
                np.add.at(counts[i], index, 1)
    w = np.frombuffer(model["weights"], np.float32)
    seen = np.flatnonzero(w)
    held = (counts > 0).astype(int)
    chosen = X._chosen(held[:12].sum(axis=0), held[12:].sum(axis=0), 12, 20)
    assert set(seen) <= set(chosen) and len(chosen)
    x, v, b = counts[:, chosen], np.zeros(len(chosen), np.float32), np.full(1, np.log(prior / (1 - prior)), np.float32)
    move, shift = Adam(v.shape, 0.02), Adam(b.shape, 0.02)
    for _ in range(X._ROUNDS):
        z = x @ v + b[0]
        p, u = sigmoid(z[:12]), sigmoid(z[12:])
        as_zero = np.concatenate((-prior * p / 12, u / 20))
        as_one = np.concatenate((prior * (p - 1) / 12, np.zeros(20)))
        risk = -np.log(1 - u).mean() + prior * np.log(1 - p).mean()  # unlabelled as 0, less the positives' share of it
        g = as_one + as_zero if risk >= 0 else -as_zero
        move.step(v, (x.T @ g).astype(np.float32) + X._DECAY * v)
        shift.step(b, g.sum(keepdims=True).astype(np.float32))
    assert np.allclose(w[chosen], v, atol=1e-3) and abs(model["bias"] - b[0]) < 1e-3
