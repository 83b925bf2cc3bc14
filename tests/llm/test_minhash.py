"""MinHash near-duplicates against all pairs."""

import random

import numpy as np
import pytest
from loomtab.llm import minhash
from pyspark.sql import functions as F


def brute(rows):
    """(id, text) rows -> {(id, text): (n, component id)}, all pairs compared on word shingles."""
    sets = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        words = [w for w in words if w]
        sets.append({tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    order = lambda x: (x is not None, x or 0)
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, key), key, key=order)
    return [(key, len(s), least[find(i)], key == least[find(i)]) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def found(df):
    return sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_awkward_rows_as_all_pairs_have_them(spark, docs, awkward):
    assert found(minhash.near_duplicates(docs)) == sorted(brute(awkward), key=str)


def chain(seed, groups=6, size=14):
    """Texts in families whose members lose or change words one after another, so that many pairs are just above or below the bound."""
    r = random.Random(seed)
    rows, at = [], 0
    for _ in range(groups):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice((12, 40, 120)))]
        for _ in range(size):
            words = list(words)
            for _ in range(r.choice((1, 1, 2, 3))):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            rows.append((at, " ".join(words)))
            at += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [minhash.TILE, 150])
def test_families_at_the_bound_and_groups_in_tiles(spark, tile):
    rows = chain(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 6 < len({x[2] for x in want}) < len(rows)  # neither one component a family nor none
    assert found(minhash.near_duplicates(df, tile=tile)) == sorted(want, key=str)


def test_null_ids_repeats_clashing_columns_and_one_id_over_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (3, text), (3, text), (3, "other words stand here"), (5, "other words stand here"), (6, ""), (7, None), (7, " \n"), (8, "A b"), (9, "a B\t")]
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], "doc_id long, text string, k int, row int, n int, key int")
    assert found(minhash.near_duplicates(df)) == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_that_are_texts(spark):
    df = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), ("c", "x")], "doc_id string, text string")
    got = {r.id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got["a"] == got["b"] and got["c"] == "c"


def test_every_coordinate_is_filled_and_agreement_is_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 500).astype(np.uint64)
    for share in (0.5, 0.85):
        agree = []
        for trial in range(40):
            own = mixed = r.integers(0, 2**63, 1000).astype(np.uint64)
            same = int(1000 * 2 * share / (1 + share))  # of sets of equal size
            mixed = np.concatenate((own[:same], r.integers(0, 2**63, 1000 - same).astype(np.uint64)))
            s = minhash.sketches(np.concatenate((own, mixed)), np.array([1000, 1000]))
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - share) < 0.02 and np.std(agree) < 1.5 * (share * (1 - share) / 200) ** 0.5
    for n in (1, 2, 7, 500):
        s = minhash.sketches(a[:n], np.array([n]))
        assert (s != np.uint64(2**64 - 1)).all()
        assert (s == minhash.sketches(r.permutation(a[:n]), np.array([n]))).all()


def test_a_large_group_gives_a_star(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:199], f"y{i}"])) for i in range(300)]
    made = minhash.sketched(minhash.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    lists = made.select(F.explode("keys").alias("key"), "row").groupBy("key").agg(F.min("row").alias("least"), F.collect_list("row").alias("rows")).where(F.size("rows") > 1)
    stars = lists.select(F.explode("rows").alias("v"), F.col("least").alias("u")).where("u <> v").distinct().count()
    assert stars < 6 * 300  # of 44,850 pairs
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_numbers_of_shingles_are_those_of_their_words():
    r = random.Random(3)
    texts = [" ".join(r.choice("abcDd") + r.choice(["", "x"]) for _ in range(r.randrange(1, 30))).encode() for _ in range(60)]
    sets, got = [minhash.shingles(t) for t in texts], minhash.numbered(texts)
    assert [len(x) for x in got] == [len(x) for x in sets]
    assert all(len(np.intersect1d(got[i], got[j])) == len(sets[i] & sets[j]) for i in range(60) for j in range(i))
