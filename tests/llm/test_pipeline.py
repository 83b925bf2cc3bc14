"""The pipeline's stages against brute force, each on what its predecessor gave."""

import random
import re

import corpus_pipeline as C
import public_tokenizers
import pytest
from loomtab.llm import bpe, quality
from loomtab.llm.tables import table, written
from test_decontaminate import _brute as _contaminated
from test_lines import _brute as _line_dedup
from test_simhash import _components, _fp


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    where = str(tmp_path_factory.mktemp("corpus"))
    pool = [f"word{i}" for i in range(300)] + ["the", "of", "and", "Ünï"]
    say = lambda n: " ".join(r.choice(pool) for _ in range(n))
    bench = [(i, say(30)) for i in range(8)]
    shared = [say(12), say(15), say(9)]
    rows = []
    for i in range(120):
        text = "\n".join(say(r.randrange(20, 60)) for _ in range(r.randrange(1, 5)))
        if i % 7 == 0:
            text += "\n" + "\n".join(shared)
        if i % 11 == 0:
            text += "\n" + r.choice(bench)[1]
        rows.append((i, text))
    rows += [(200 + i, rows[i + 1][1] if i % 2 else rows[i + 1][1] + " end") for i in range(20)]
    rows += [(300, None), (301, ""), (302, "too short"), (303, "BUY NOW!! " * 30), (5, rows[5][1])]
    full = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)] + [(303, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def test_stages(spark, folder):
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "encode"]
    docs = table(spark, folder, "documents")
    columns = docs.columns
    before = _pairs(docs)
    judged = {(r.id): r.kept for r in quality.judge(docs, quality.fitted(docs, table(spark, folder, "labels"))).collect()}
    wants = {
        "quality": lambda rows: [x for x in rows if judged[x[0]]],
        "line_dedup": lambda rows: [(i, _line_dedup(sorted(set(rows)), 2)[i]) for i, _ in rows],
        "decontaminate": lambda rows: [x for x, y in zip(rows, _contaminated(rows, _pairs_of(spark, folder)), strict=True) if not y[4]],
    }
    for name, stage in C.STAGES[:-1]:
        after = written(stage(spark, docs, folder), f"test-{name}")
        assert after.columns == columns
        rows = _pairs(after)
        if name == "near_dedup":
            root = _components({i: _fp(t) for i, t in before})
            assert [i for i, _ in rows] == sorted(set(root.values()))
        else:
            assert rows == sorted(wants[name](before), key=lambda x: (x[0], x[1] or "")), name
        assert len(rows) <= len(before)
        docs, before = after, rows
    last = C.encoding(spark, docs, folder).collect()
    vocabulary = bpe.load(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    import numpy as np

    assert sorted((r.doc_id, vocabulary.decode(np.frombuffer(r.ids, "<u4"))[0].tobytes().decode()) for r in last) == before
    assert sorted((r.doc_id, r.n_tokens) for r in C.run(spark, folder).collect()) == sorted((r.doc_id, r.n_tokens) for r in last)


def _pairs_of(spark, folder):
    return [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]


def test_stages_survive_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, folder, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_no_swallowed_imports():
    assert not re.search(r"\btry:", open(C.__file__).read())


def test_a_run_leaves_only_its_stages(spark, folder):
    import glob

    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{where}/*"))
    assert C.run(spark, folder).count() > 0
    assert sorted(x.rsplit("-", 2)[-2] for x in set(glob.glob(f"{where}/*")) - before) == ["decontaminate", "encode", "line_dedup", "near_dedup", "quality"]
