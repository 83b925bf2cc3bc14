import zlib

from loomtab.llm import sharding as S


def test_cuts_at_equal_targets(spark, docs, awkward, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(S.op5_sharding(spark, str(tmp_path)).collect(), key=lambda r: (r.shard, r.slot))
    raw = sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in awkward)
    assert [(r.doc_id, r.text_crc32, r.size) for r in got] == raw
    total, upto, want = sum(x[2] for x in raw), 0, []
    for _, _, size in raw:
        want.append(min(7, (2 * upto + size) * 8 // (2 * total)))
        upto += size
    assert [r.shard for r in got] == want
    for s in range(8):
        slots = [r.slot for r in got if r.shard == s]
        assert slots == list(range(len(slots)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_near_equal_bytes(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "repeat('é', cast(id % 97 as int)) as text").unionByName(spark.range(2000).selectExpr("cast(null as long) doc_id", "'copy' text"))
    sizes = {}
    got = S.assign_shards(rows).collect()
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(got) == 7000 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 193


def test_empty(spark):
    assert S.assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
