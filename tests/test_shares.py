"""Tasks hold shares that do not grow with the tables."""

from pyspark.sql import functions as F

from loomtab.operators import uploads as U


def test_uploads_are_listed_in_bounded_shares(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARE", 500, raising=False)
    manifests = spark.range(3000).select(F.col("id").alias("upload_id"), (F.col("id") % 4).alias("total"), F.lit(10).cast("long").alias("size"))
    parts = spark.range(6000).select((F.col("id") % 2000).alias("upload_id"), F.expr("id div 2000").alias("part"), F.lit(2).cast("long").alias("bytes"))
    found = U.status(manifests, parts.unionByName(parts))
    held = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(held) >= 25 and max(r["count"] for r in held) <= 500  # 15000 rows in shares of 500
    for r in found.collect():
        there = [p for p in range(3) if r.upload_id < 2000 and p < r.total]
        assert (r.uploaded, r.missing) == (there, [p for p in range(r.total) if p not in there])
        assert (r.uploaded_bytes, r.progress) == (2 * len(there), round(2 * len(there) / 10, 6))


def test_sections_of_workers_are_dealt_by_rows(spark, monkeypatch):
    from loomtab import plans
    from loomtab.plans import memory

    monkeypatch.setattr(memory, "SECTIONS", 25, raising=False)
    found = plans.queries()["worker_sections"](spark, "/root/testdata/sf0.001")
    assert found.groupBy(F.spark_partition_id()).count().count() == 8  # 200 rows


def test_a_shortened_text_is_made_once(spark):
    from pyspark.sql import types as T

    from loomtab.functions.text import shorten

    made = spark.sparkContext.accumulator(0)

    def text(n: int) -> str:
        made.add(1)
        return f" {n} " * 20

    own = F.udf(text, T.StringType()).asNondeterministic()(F.col("id"))
    plan = spark.range(1).select(shorten(own, 30).alias("t"))
    text_uses = plan._jdf.queryExecution().analyzed().toString().count("text(")
    assert text_uses == 1
    assert [r.t for r in plan.collect()] == ["0  0  0  0 "[:10] + "\n…（已截断）"] and made.value == 1


def test_no_task_writes_whole_delimited_files(spark, tmp_path, monkeypatch):
    from oracle import compare, connect

    from loomtab import plans
    from loomtab.plans import flows

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4, "doc_id").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(flows, "new_folder", lambda spark, name: f"{tmp_path}/{name}")
    found = plans.queries()["delimited_files"](spark, f"{tmp_path}/in")
    assert all(len(list((tmp_path / "delimited" / name).glob("part-*"))) == 4 for name in ("a.csv", "b.tsv"))
    assert compare(found, connect(f"{tmp_path}/in"), plans.oracle_sql()["delimited_files"]) == (200, "")
