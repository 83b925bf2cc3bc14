"""Chunked uploads: manifests and parts as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import is_safe_relative
from .ordered import file_system, small_batches, written

MIB = 1 << 20
#: Manifests and parts that one task joins and lists; some 150 bytes each are held.
SHARE = 500_000
CHUNK_LEAST, CHUNK_DEFAULT, CHUNK_MOST, TTL_SECONDS = MIB, 5 * MIB, 10 * MIB, 86_400


def chunk_size(asked: Column) -> Column:
    return F.greatest(F.lit(CHUNK_LEAST), F.least(F.lit(CHUNK_MOST), F.coalesce(asked, F.lit(CHUNK_DEFAULT))))


def total_chunks(size: Column, chunk: Column) -> Column:
    return F.when(size <= 0, 0).otherwise(F.floor((size + chunk - 1) / chunk)).cast("long")


def expected_size(index: Column, size: Column, chunk: Column, total: Column) -> Column:
    """Bytes that a part must have; 0 outside the range."""
    rest = size - chunk * (total - 1)
    return F.when((index < 0) | (index >= total), 0).when((index == total - 1) & (rest > 0), rest).otherwise(chunk)


def status(manifests: DataFrame, parts: DataFrame, key: str = "upload_id") -> DataFrame:
    """Uploaded and missing parts, bytes and progress of each upload; parts out of range do not count.

    Both sides are counted and dealt by upload once, in shares of about ``SHARE`` rows, and everything else happens
    within a share: rows compress so well here that shares by bytes would hold many millions.
    """
    n = max(1, -(-(manifests.count() + parts.count()) // SHARE))
    manifests, parts = manifests.repartition(n, key), parts.repartition(n, key)
    held = parts.join(manifests.select(key, "total"), key).where((F.col("part") >= 0) & (F.col("part") < F.col("total")))
    held = held.groupBy(key, "part").agg(F.max("bytes").alias("bytes"))
    per = held.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("uploaded"), F.sum("bytes").alias("uploaded_bytes"))
    out = manifests.join(per, key, "left").withColumns({"uploaded": F.coalesce("uploaded", F.array().cast("array<bigint>")), "uploaded_bytes": F.coalesce("uploaded_bytes", F.lit(0))})
    every = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumns({"missing": F.array_except(every, "uploaded"), "progress": F.round(F.col("uploaded_bytes") / F.greatest(F.col("size"), F.lit(1)), 6)})


def accept(parts: DataFrame) -> DataFrame:
    """Why each offered part is refused, in the order of the checks; ``ok`` otherwise.

    Columns: owner, user, age, state, part, size, chunk, total, bytes, checksum, actual.
    """
    want = expected_size(F.col("part"), F.col("size"), F.col("chunk"), F.col("total"))
    reason = (
        F.when(F.col("owner") != F.col("user"), "forbidden").when(F.col("age") > TTL_SECONDS, "expired").when(F.col("state") == "completed", "completed")
        .when((F.col("part") < 0) | (F.col("part") >= F.col("total")), "range").when(F.col("bytes") != want, "size")
        .when(F.col("checksum").isNotNull() & (F.lower(F.trim("checksum")) != F.col("actual")), "checksum").otherwise("ok")
    )
    return parts.withColumn("verdict", reason)


def expired(manifests: DataFrame, now: Column, created: str = "created_at") -> DataFrame:
    """Uploads older than the time to live, by a clock that the caller gives."""
    return manifests.where(F.unix_timestamp(now) - F.unix_timestamp(created) > TTL_SECONDS)


def merged(parts: DataFrame, key: str, part: str, content: str, folder: str | None = None) -> DataFrame:
    """Parts of each upload (texts or bytes) joined in order: key, n_bytes, sha256 and path.

    A secondary sort: slices of up to 1 MiB are dealt by upload and sorted by place, and a task feeds them one by one to
    a running checksum and, with a ``folder``, to a file of its own there, so it holds a few slices whatever an upload's
    size. A task that is run again writes another file; the path is that of the run that counted.
    """
    spark, bytes_ = parts.sparkSession, F.col(content).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - 1, F.lit(0)), F.lit(MIB))
    cut = parts.select(F.col(key).alias("key"), F.col(part).alias("part"), bytes_.alias("content"), F.explode(starts).alias("at"))
    cut = cut.select("key", "part", "at", F.substring("content", F.col("at") + 1, F.lit(MIB)).alias("slice"))
    kind = cut.schema["key"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, size, out, path = None, None, 0, None, None

        def done() -> pa.RecordBatch:
            if out is not None:
                out.close()
            return pa.RecordBatch.from_arrays([pa.array([own[0]], own[1]), pa.array([size], pa.int64()), pa.array([digest.hexdigest()]), pa.array([path], pa.string())], ["key", "n_bytes", "sha256", "path"])

        for batch in batches:
            for i in range(len(batch)):
                value = batch.column(0)[i].as_py()
                if own is None or value != own[0]:
                    if own is not None:
                        yield done()
                    own, digest, size = (value, batch.column(0).type), sha256(), 0
                    if folder:
                        path = f"{folder}/{uuid.uuid4().hex}"
                        system, where = file_system(path)
                        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(where)
                data = batch.column(1)[i].as_buffer()
                digest.update(data)
                size += data.size
                if out is not None:
                    out.write(data)
        if own is not None:
            yield done()

    sorted_ = cut.repartition("key").sortWithinPartitions("key", "part", "at").select("key", "slice")
    with small_batches(spark, 16):
        return written(sorted_.mapInArrow(merge, f"key {kind}, n_bytes long, sha256 string, path string"), "merged").withColumnRenamed("key", key)


LARGEST = 2048 * MIB


def size_verdict(size: Column) -> Column:
    """Whether an upload of so many bytes is taken: not empty, and at most 2048 MB."""
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > LARGEST, "too_large").otherwise("ok")


def raw_copy_verdict(path: Column, exists: Column) -> Column:
    """Whether a project's file may be copied to a session: below ``raw/`` once slashes are alike, inside the project, and there."""
    clean = F.ltrim(F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/"), F.lit("/"))
    below = F.startswith(clean, F.lit("raw/")) & is_safe_relative(clean) & (F.length(clean) > 4)
    climbs = F.array_contains(F.split(clean, "/"), "..")
    return F.when(~below | climbs, "bad_path").when(~F.coalesce(exists, F.lit(False)), "missing").otherwise("ok")


def remaining_seconds(created: Column, now: Column) -> Column:
    """Seconds that an upload still lives, by the caller's clock; never below zero."""
    return F.greatest(F.lit(0), TTL_SECONDS - (F.unix_timestamp(now) - F.unix_timestamp(created)))


def verified(parts: DataFrame, content: str = "content", checksum: str = "checksum") -> DataFrame:
    """``parts`` with actual (SHA-256 of their bytes) and matches: no checksum, or the same one in either case, trimmed."""
    asked = F.lower(F.trim(F.coalesce(F.col(checksum), F.lit(""))))
    return parts.withColumn("actual", F.sha2(F.col(content), 256)).withColumn("matches", (asked == "") | (asked == F.col("actual")))


def merged_uploads(parts: DataFrame, manifests: DataFrame, key: str = "upload_id", folder: str | None = None) -> DataFrame:
    """Outcome of each upload (incomplete, size, ok) with n_bytes; where ok the parts are joined: sha256 and, with a ``folder``, path.

    parts: key, part, content (binary); manifests: key, total, size. Sizes are summed before any bytes are moved, so a
    wrong one costs nothing; of a part that came twice one counts.
    """
    inside = parts.join(manifests.select(key, "total"), key).where((F.col("part") >= 0) & (F.col("part") < F.col("total"))).drop("total")
    once = inside.dropDuplicates([key, "part"])
    sums = once.select(key, F.octet_length("content").cast("long").alias("b")).groupBy(key).agg(F.count("*").alias("held"), F.sum("b").alias("n_bytes"))
    zero = F.lit(0).cast("long")
    outcome = F.when(F.coalesce("held", zero) < F.col("total"), "incomplete").when(F.coalesce("n_bytes", zero) != F.col("size"), "size").otherwise("ok")
    state = manifests.join(sums, key, "left").select(key, outcome.alias("outcome"), F.coalesce("n_bytes", zero).alias("n_bytes"))
    whole = merged(once.join(state.where("outcome = 'ok'").select(key), key, "left_semi"), key, "part", "content", folder)
    return state.join(whole.select(key, "sha256", "path"), key, "left")


_MANIFEST = "upload_id string, created_at string, size long"


def sweep(folders: DataFrame, now: Column, manifest: str = "manifest") -> DataFrame:
    """Upload folders with ``verdict``: remove_missing (no manifest), remove_corrupt (not JSON, or without a time), expired, or keep."""
    made = F.from_json(F.col(manifest), _MANIFEST)
    created = F.try_to_timestamp(made["created_at"])
    age = F.unix_timestamp(now) - F.unix_timestamp(created)
    return folders.withColumn("verdict", F.when(F.col(manifest).isNull(), "remove_missing").when(created.isNull(), "remove_corrupt").when(age > TTL_SECONDS, "expired").otherwise("keep"))
