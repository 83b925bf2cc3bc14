"""The catalog's writes as DataFrame -> DataFrame: each gives the table's next snapshot or the rows to append.

Parquet tables have no row-level update, so a write is a new snapshot; keys
decide by joins, and ids come from the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import delete_verdict


def insert_if_absent(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """Staged rows whose keys the target lacks, each key once (least row first): what an append would add."""
    rest = [c for c in staged.columns if c not in keys]
    once = staged.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else staged.distinct()
    return once.join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Target with the last change of each key in its place."""
    rest = [c for c in target.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return target.join(last.select(key), key, "left_anti").unionByName(last)


def set_if_blank(df: DataFrame, column: str, value: Column) -> DataFrame:
    """The column set where it is null or blank; ``saved`` says where it was."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    return df.withColumn("saved", blank).withColumn(column, F.when(F.col("saved"), value).otherwise(F.col(column)))


def assign_where_null(df: DataFrame, column: str, value: Column, condition: Column) -> DataFrame:
    """The column set where it is null and the condition holds; ``assigned`` says where."""
    return df.withColumn("assigned", F.col(column).isNull() & condition).withColumn(column, F.when(F.col("assigned"), value).otherwise(F.col(column)))


def partial_update(df: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Allowed columns take the change's value where it has one; other columns of a change are ignored."""
    new = changes.groupBy(key).agg(*[F.max(c).alias(f"new_{c}") for c in allowed if c in changes.columns])
    out = df.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in new.columns else F.col(c) for c in df.columns])


def delete_by_key(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def get_or_create(target: DataFrame, staged: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """What each staged key gets: the id the target has for it (``created`` false), else that of its least staged row."""
    known = target.groupBy(*keys).agg(F.min(id_col).alias("known"))
    asked = staged.groupBy(*keys).agg(F.min(id_col).alias("new"))
    return asked.join(known, keys, "left").select(*keys, F.coalesce("known", "new").alias(id_col), F.col("known").isNull().alias("created"))


def create(target: DataFrame, staged: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``staged`` with ``outcome``: duplicate where the target has the key or an earlier staged row takes it, else created."""
    first = staged.groupBy(*keys).agg(F.min(order).alias("first_"))
    out = staged.join(first, keys).join(target.select(*keys).distinct().withColumn("taken_", F.lit(True)), keys, "left")
    taken = F.coalesce("taken_", F.lit(False)) | (F.col(order) > F.col("first_"))
    return out.withColumn("outcome", F.when(taken, "duplicate").otherwise("created")).drop("first_", "taken_")


def new_sessions(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Sessions as they are stored: a project only where its id is above zero; ids that exist are refused."""
    return create(target, staged, ["session_id"], "id").withColumn("project_id", F.when(F.col("project_id") > 0, F.col("project_id")))


def new_tasks(staged: DataFrame, payload: list[str]) -> DataFrame:
    """Tasks as they are stored: pending, with their payload as JSON."""
    return staged.select("id", "project_id", F.lit("pending").alias("status"), F.to_json(F.struct(*payload)).alias("payload"))


#: The name that a user's first project has, which no other may take.
DEFAULT_PROJECT = "默认项目"


def new_projects(users: DataFrame, projects: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged projects with their outcome (blank and reserved names are refused), and default projects of users without one."""
    name = F.trim(F.coalesce("name", F.lit("")))
    out = staged.withColumn("outcome", F.when(name == "", "blank").when(name == DEFAULT_PROJECT, "reserved").otherwise("created"))
    missing = users.select("user_id").distinct().join(projects.where("is_default").select("user_id"), "user_id", "left_anti")
    return out, missing.select("user_id", F.lit(DEFAULT_PROJECT).alias("name"), F.lit(True).alias("is_default"))


def promote(users: DataFrame, phone: str | None) -> DataFrame:
    """``users`` with the role admin for the one whose phone is the setting's; no one where it is blank."""
    wanted = (phone or "").strip()
    hit = (F.trim("phone") == wanted) & (F.coalesce("role", F.lit("")) != "admin") if wanted else F.lit(False)
    return users.withColumn("promoted", F.coalesce(hit, F.lit(False))).withColumn("role", F.when(F.col("promoted"), "admin").otherwise(F.col("role")))


def registered(files: DataFrame, assets: DataFrame, extensions: list[str], target: Column) -> DataFrame:
    """Files of the listed extensions as assets below ``target``, with the id the catalog has or a new one."""
    ext = F.lower(F.regexp_extract("relative_path", r"(\.[^./]*)$", 1))
    staged = files.where(ext.isin(extensions)).select("project_id", target.alias("relative_path"), "id")
    return get_or_create(assets, staged, ["project_id", "relative_path"])


def deleted_files(asked: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their verdict (see ``delete_verdict``), and the assets that stay once the files of accepted ones are gone.

    asked: project_id, path, session_exists, archived, kind; assets: project_id, relative_path.
    """
    clean = F.ltrim(F.translate(F.trim(F.coalesce("path", F.lit(""))), "\\", "/"), F.lit("/"))
    judged = asked.withColumn("verdict", delete_verdict(F.col("path"), F.col("session_exists"), F.col("archived"), F.col("kind")))
    gone = judged.where("verdict = 'ok'").select("project_id", clean.alias("relative_path"))
    return judged, delete_by_key(assets, gone, ["project_id", "relative_path"])
