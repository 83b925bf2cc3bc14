"""Catalog tables whose writes take effect as a whole, once, or not at all.

A table is a folder of snapshots and a folder of marks, one a version, each
naming its snapshot. A write reads the last version, writes what it becomes
beside it, and makes the next version's mark, which only one writer can. A
writer that comes second, or fails, deletes its snapshot, reads again and tries
once more; then the error is the caller's. Readers take a version, so nobody
sees half of a write, and older versions stay readable.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

_MARK = "v%012d"


class Conflict(RuntimeError):
    """Another writer made the version."""


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _marked(spark: SparkSession, path: str) -> dict[int, str]:
    """Versions and their snapshots; a mark's name holds both, as a name is there as a whole or not at all."""
    system, where = _system(spark, f"{path}/log")
    if not system.exists(where):
        return {}
    names = [x.getPath().getName() for x in system.listStatus(where)]
    return {int(n[1:].split("-")[0]): n.split("-", 1)[1] for n in names if n.startswith("v") and "-" in n}


def _mark(spark: SparkSession, path: str, version: int, snapshot: str) -> bool:
    """Makes a version's mark unless there is one. The claim, an empty file, is made by whoever comes first."""
    system, claim = _system(spark, f"{path}/claims/{_MARK % version}")
    system.mkdirs(claim.getParent())
    if system.getScheme() == "file":  # Hadoop's local files are made in two steps
        try:
            os.close(os.open(claim.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
    elif not system.createNewFile(claim):
        return False
    _, where = _system(spark, f"{path}/log/{_MARK % version}-{snapshot}")
    return bool(system.mkdirs(where))


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(_marked(spark, path))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, or of the last one."""
    marked = _marked(spark, path)
    if not marked or version is not None and version not in marked:
        raise KeyError(f"no such version of {path}: {version}")
    return spark.read.parquet(f"{path}/data/{marked[max(marked) if version is None else version]}")


def create(df: DataFrame, path: str) -> int:
    """Version 1; a table that is there is a conflict."""
    return _attempt(df.sparkSession, path, lambda _: df)


def _attempt(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame]) -> int:
    marked = _marked(spark, path)
    last, snapshot = max(marked, default=0), uuid.uuid4().hex
    done = False
    try:
        change(spark.read.parquet(f"{path}/data/{marked[last]}") if marked else None).write.parquet(f"{path}/data/{snapshot}")
        done = _mark(spark, path, last + 1, snapshot)
    finally:
        if not done:  # what was written goes, whatever went wrong
            system, where = _system(spark, f"{path}/data/{snapshot}")
            system.delete(where, True)
    if not done:
        raise Conflict(f"version {last + 1} of {path} was made by another writer")
    return last + 1


def write(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """The version that ``change`` of the last one makes, a function of its rows: tried again once, on what is there then."""
    try:
        return _attempt(spark, path, change)
    except (Conflict, PySparkException):
        return _attempt(spark, path, change)
