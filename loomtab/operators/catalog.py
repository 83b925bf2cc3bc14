"""The catalog's reads: sessions, projects, members and assets as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import last_part


def newest_first(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(key))


def latest(content: DataFrame, key: str = "session_id", version: str = "version", value: str = "content") -> DataFrame:
    """Latest version and its content by key, pre-aggregated: no sort of a key's history."""
    return content.groupBy(key).agg(F.max(version).alias("version"), F.max_by(value, version).alias("content"))


def with_latest(sessions: DataFrame, content: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions with their latest content; nulls where there is none."""
    return sessions.join(latest(content, key), key, "left")


def members_with_users(members: DataFrame, users: DataFrame, user_key: str = "user_id") -> DataFrame:
    """Members with what is known of their user, in member order."""
    return members.join(users, user_key, "left")


def accessible(own: DataFrame, shared: DataFrame, key: str = "session_id", order: str = "ord") -> DataFrame:
    """Own rows, then shared ones, each key once: the first wins."""
    both = own.withColumn("rank_", F.lit(0)).unionByName(shared.withColumn("rank_", F.lit(1)))
    rest = [c for c in own.columns if c != key]
    first = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("rank_", order)).alias("r"))
    return first.select(key, "r.*")


def owned_or_member(projects: DataFrame, members: DataFrame, user: int, project: str = "project_id", owner: str = "user_id") -> DataFrame:
    """Projects a user owns and those of others they are a member of, marked by ``via``."""
    owned = projects.where(F.col(owner) == user)
    joined = members.where(F.col(owner) == user).select(project).where(F.col(project).isNotNull() & (F.col(project) != 0)).distinct()
    others = projects.join(joined.join(owned.select(project), project, "left_anti"), project, "left_semi")
    return owned.withColumn("via", F.lit("owner")).unionByName(others.withColumn("via", F.lit("member")))


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "session_count") -> DataFrame:
    """Parents with the number of their children, zero included: one join, no lookup a parent."""
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page in a total order, with the number of all rows on each."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def dedupe_names(df: DataFrame, name: str, group: str, position: str) -> DataFrame:
    """Header cells as column names: blank ones by position, repeats numbered ``name_k`` in order."""
    trimmed = F.trim(F.coalesce(F.col(name), F.lit("")))
    named = df.withColumn("name_", F.when(trimmed == "", F.concat(F.lit("Unnamed: "), F.col(position).cast("string"))).otherwise(trimmed))
    k = F.row_number().over(Window.partitionBy(group, "name_").orderBy(position)) - 1
    return named.withColumn("column_name", F.when(k == 0, F.col("name_")).otherwise(F.concat_ws("_", "name_", k.cast("string")))).drop("name_")


def listed(df: DataFrame, key: str | None, order: str = "id", id_col: str | None = None) -> DataFrame:
    """Rows of every key, newest first, with their ``place`` from 1; rows whose ``id_col`` is blank are left out before."""
    if id_col:
        df = df.where(F.trim(F.coalesce(F.col(id_col), F.lit(""))) != "")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*([key] if key else [])).orderBy(F.desc(order))))


def first_of(df: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """One row for each key, that of least ``order``: a lookup that takes the first match, for all keys at once."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


#: Stretches into which one side of all pairs is dealt; each is a task's share, and the other side is sent to each.
TILES = 256
#: Rows of the other side that are sent as one list, and parts in which they are numbered for it.
LISTED, NUMBERED = 128, 16


def each_with_every(few: DataFrame, many: DataFrame) -> DataFrame:
    """Every row of ``few`` beside every row of ``many``: ``many`` is dealt out to tasks, which each read ``few`` and hold neither whole pairs nor both sides.

    ``few`` is sent in lists, so the join makes a row for a list and only the last step one for a pair. The coalesce keeps
    their number of tasks; it parts the two steps, or the join would hold all pairs of a row of ``many`` before it passes one on.
    """
    dealt = many.withColumn("tile_", F.pmod(F.xxhash64(*many.columns), F.lit(TILES)).cast("int")).repartition(TILES, "tile_")
    numbered = few.withColumn("part_", F.pmod(F.xxhash64(*few.columns), F.lit(NUMBERED)))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*few.columns))
    lists = numbered.withColumn("list_", F.floor((place - 1) / LISTED)).groupBy("part_", "list_").agg(F.collect_list(F.struct(*few.columns)).alias("few_"))
    sent = lists.select("few_", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))).alias("tile_")).repartition(TILES, "tile_")
    return dealt.join(sent, "tile_").coalesce(TILES).select(F.inline("few_"), *many.columns)


def reach(users: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """Columns user_id, id and via: projects a user owns, those of others they are a member of; one row with a null id for an admin, who reaches all.

    users: user_id, is_admin; projects: id, user_id; members: project_id, user_id. A project is listed once a user,
    as owner if they own it. What looks things up takes this form; ``reachable_projects`` lists an admin's projects.
    """
    office = users.select("user_id", F.coalesce("is_admin", F.lit(False)).alias("admin_"))
    plain = office.where("not admin_").select("user_id")
    owned = projects.join(plain, "user_id").select("user_id", "id")
    joined = members.join(plain, "user_id").select("user_id", F.col("project_id").alias("id")).where("id is not null and id <> 0").distinct()
    joined = joined.join(projects.select("id"), "id", "left_semi").join(owned, ["user_id", "id"], "left_anti").select("user_id", "id")
    every = office.where("admin_").select("user_id", F.lit(None).cast(projects.schema["id"].dataType).alias("id"))
    return owned.withColumn("via", F.lit("owner")).unionByName(joined.withColumn("via", F.lit("member"))).unionByName(every.withColumn("via", F.lit("admin")))


def reachable_projects(users: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """What ``reach`` has, with a row for every project of an admin: as many rows as there are pairs of admins and projects."""
    found = reach(users, projects, members)
    every = each_with_every(found.where("id is null").select("user_id"), projects.select("id"))
    return found.where("id is not null").unionByName(every.withColumn("via", F.lit("admin")))


def accessible_sessions(sessions: DataFrame, reached: DataFrame, projects: DataFrame, project: int | None = None) -> DataFrame:
    """Columns user_id, session_id, project_id and via: a user's own sessions, then those of projects they reach, each once; an admin's, those of all projects.

    ``reached`` is what ``reach`` has. Blank ids are left out; ``project`` keeps the sessions of one project, after
    sessions were made unique. Of a session's rows only those a user could be given by are joined. An admin gets the
    same row of a session as any other admin but for their own, so these are found once and given to each.
    """
    live = sessions.where("trim(coalesce(session_id, '')) <> ''").withColumn("project_id", F.nullif("project_id", F.lit(0)))
    own = live.select("user_id", "session_id", "id", "project_id", F.lit("own").alias("via"))
    through = reached.where("id is not null").select("user_id", F.col("id").alias("project_id"))
    shared = live.drop("user_id").join(through, "project_id").select("user_id", "session_id", "id", "project_id", F.lit("project").alias("via"))
    both = own.unionByName(shared)
    if project is not None:  # whoever has a row of the project; their other rows of the session decide whether it is the first
        asked = live.where(F.col("project_id") == project).select("session_id").distinct()
        both = both.join(asked, "session_id", "left_semi")
    first = both.groupBy("user_id", "session_id").agg(F.min_by(F.struct("project_id", "via"), F.struct(F.col("via") != "own", -F.col("id"))).alias("r"))
    out = first.select("user_id", "session_id", "r.*")
    admins = reached.where("id is null").select("user_id").distinct()
    last = live.join(projects.select(F.col("id").alias("project_id")), "project_id", "left_semi").groupBy("session_id").agg(F.max_by("project_id", "id").alias("project_id"))
    if project is not None:
        out, last = out.where(F.col("project_id") == project), last.where(F.col("project_id") == project)
    owners = live.join(admins, "user_id", "left_semi").groupBy("session_id").agg(F.collect_set("user_id").alias("owners_"))
    every = each_with_every(admins, last.join(owners, "session_id", "left").select("session_id", "project_id", "owners_"))
    every = every.where(~F.coalesce(F.array_contains("owners_", F.col("user_id")), F.lit(False)))
    return out.unionByName(every.select("user_id", "session_id", "project_id", F.lit("project").alias("via")))


def sees(asked: DataFrame, sessions: DataFrame, reached: DataFrame) -> DataFrame:
    """``asked`` (user_id, session_id, ...) with may: whether the user has the session, or reaches (as ``reach`` has it) the project of one of its rows."""
    live = sessions.where("trim(coalesce(session_id, '')) <> ''").withColumn("project_id", F.nullif("project_id", F.lit(0)))
    admin = reached.where("id is null").select("user_id", F.lit(True).alias("admin_")).distinct()
    own = live.select("user_id", "session_id", F.lit(True).alias("own_")).distinct()
    pairs = asked.select("user_id", "session_id").distinct().join(live.where("project_id is not null").select("session_id", F.col("project_id").alias("id")).distinct(), "session_id")
    through = pairs.join(reached.where("id is not null"), ["user_id", "id"], "left_semi").select("user_id", "session_id", F.lit(True).alias("reached_")).distinct()
    there = live.where("project_id is not null").select("session_id", F.lit(True).alias("there_")).distinct()
    out = asked.join(admin, "user_id", "left").join(own, ["user_id", "session_id"], "left").join(through, ["user_id", "session_id"], "left").join(there, "session_id", "left")
    may = F.coalesce("own_", F.lit(False)) | F.coalesce("reached_", F.lit(False)) | F.coalesce(F.col("admin_") & F.col("there_"), F.lit(False))
    return out.withColumn("may", may).drop("admin_", "own_", "reached_", "there_")


def original_names(files: DataFrame, assets: DataFrame) -> DataFrame:
    """``files`` with the original name that the catalog knows for a project's path, else the last part of the path."""
    known = assets.where("trim(coalesce(original_name, '')) <> ''").groupBy("project_id", "relative_path").agg(F.min_by("original_name", "id").alias("original_name"))
    return files.join(known, ["project_id", "relative_path"], "left").withColumn("original_name", F.coalesce("original_name", last_part(F.col("relative_path"))))


def default_first(projects: DataFrame) -> DataFrame:
    """A user's projects with their ``place``: the default one first, the others newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("is_default"), F.desc("id"))
    return projects.withColumn("place", F.row_number().over(w))
