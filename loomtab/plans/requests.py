"""Requests to the catalog, answered for all keys at once: every user's, project's or session's, not one of them.

A small catalog is made of the driver's tables, by the same expressions for Spark and for SQL: orders are sessions
(some without an id, a title or a project, some with the id of another), customers projects and users, parts assets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stages as G
from ..functions import text as T
from ..operators import catalog as C
from ..operators import events as E
from ..operators import mutations as M
from ..operators import names, rules
from ..operators import routing as R
from ..operators import uploads as U
from ..sources import tables
from .common import table

_SID = "CASE WHEN o_orderkey % 11 = 0 THEN ' ' WHEN o_orderkey % 13 = 0 THEN NULL ELSE 's' || (o_orderkey - o_orderkey % 2) END"
#: Table of the catalog -> (driver's table, columns, condition).
MADE = {
    "sessions": ("orders", {
        "id": "o_orderkey", "session_id": _SID, "user_id": "o_custkey",
        "project_id": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_custkey + 1 END",
        "title": "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END",
        "workspace_path": "'/ws/' || o_custkey || '/' || o_orderkey",
    }, "true"),
    "projects": ("customer", {"id": "c_custkey + 1", "user_id": "c_custkey - c_custkey % 3", "name": "c_name", "is_default": "c_custkey < 30", "archived": "c_acctbal < 0"}, "true"),
    "users": ("customer", {"user_id": "c_custkey", "phone": "'13' || (c_custkey + 10000)", "username": "c_name", "role": "CASE WHEN c_custkey % 13 = 4 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'user' END", "is_admin": "c_custkey % 13 = 4"}, "true"),
    "members": ("orders", {
        "id": "o_orderkey", "project_id": "CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 1499 + 1 END", "user_id": "o_custkey",
        "permissions": "CASE WHEN o_totalprice < 50000 THEN '[\"data_upload\",\"' || lower(o_orderstatus) || '\"]' WHEN o_totalprice < 90000 THEN '[\"' || o_orderpriority WHEN o_totalprice < 120000 THEN '[]' WHEN o_totalprice < 150000 THEN NULL ELSE '[\"' || o_orderpriority || '\"]' END",
        "joined_at": "o_orderdate",
    }, "true"),
    "assets": ("part", {"id": "p_partkey", "project_id": "p_size % 20", "relative_path": "'raw/' || replace(p_name, ' ', '_') || '.csv'", "original_name": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN ' ' ELSE p_type || '.csv' END"}, "true"),
    "tasks": ("events", {"id": "event_id", "project_id": "user_id", "kind": "event_type", "n": "event_id % 9"}, "true"),
}


def made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = MADE[name]
    return table(spark, sf_dir, source).where(where).selectExpr(*[f"{x} AS {c}" for c, x in columns.items()])


def _rows(spark: SparkSession, sf_dir: str, source: str, sql: str) -> DataFrame:
    """Rows of one SELECT that both dialects read alike, over one of the driver's tables."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f" FROM {source}", " FROM {source_}"), source_=table(spark, sf_dir, source))


def _with(*wanted: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(f'{x} AS {c}' for c, x in MADE[n][1].items())} FROM {MADE[n][0]} WHERE {MADE[n][2]})" for n in wanted)


_LIVE = "trim(coalesce(session_id, '')) <> ''"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"{_with('sessions')} SELECT session_id, arg_min(user_id, id) AS user_id, arg_min(workspace_path, id) AS workspace_path FROM sessions WHERE {_LIVE} GROUP BY session_id")
def session_lookup(spark, sf_dir):
    """Path and user of every session id, the first row that has it."""
    found = C.first_of(made(spark, sf_dir, "sessions").where(_LIVE), ["session_id"])
    return found.select("session_id", "user_id", "workspace_path")


@query(f"{_with('sessions')} SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC)::INTEGER AS place FROM sessions WHERE {_LIVE}")
def session_ids_by_user(spark, sf_dir):
    return C.listed(made(spark, sf_dir, "sessions"), "user_id", id_col="session_id").select("user_id", "session_id", "place")


@query(f"{_with('sessions')} SELECT user_id, session_id, nullif(trim(title), '') AS title, project_id, row_number() OVER (PARTITION BY user_id ORDER BY id DESC)::INTEGER AS place FROM sessions WHERE {_LIVE}")
def sessions_by_user(spark, sf_dir):
    own = C.listed(made(spark, sf_dir, "sessions"), "user_id", id_col="session_id")
    return own.select("user_id", "session_id", F.nullif(F.trim("title"), F.lit("")).alias("title"), "project_id", "place")


@query(f"{_with('sessions')} SELECT project_id, session_id, row_number() OVER (PARTITION BY project_id ORDER BY id DESC)::INTEGER AS place FROM sessions WHERE {_LIVE} AND project_id IS NOT NULL AND project_id <> 0")
def sessions_by_project(spark, sf_dir):
    own = made(spark, sf_dir, "sessions").where("project_id is not null and project_id <> 0")
    return C.listed(own, "project_id", id_col="session_id").select("project_id", "session_id", "place")


_REACH = """reach AS (
    SELECT u.user_id, p.id, CASE WHEN p.user_id = u.user_id THEN 'owner' ELSE 'member' END AS via FROM users u, projects p
    WHERE NOT u.is_admin AND (p.user_id = u.user_id OR EXISTS (SELECT 1 FROM members m WHERE m.user_id = u.user_id AND m.project_id = p.id))
    UNION ALL SELECT user_id, NULL, 'admin' FROM users WHERE is_admin)"""


_REACH_ALL = """reach AS (
    SELECT u.user_id, p.id, CASE WHEN u.is_admin THEN 'admin' WHEN p.user_id = u.user_id THEN 'owner' ELSE 'member' END AS via FROM users u, projects p
    WHERE u.is_admin OR p.user_id = u.user_id OR EXISTS (SELECT 1 FROM members m WHERE m.user_id = u.user_id AND m.project_id = p.id))"""


@query(f"{_with('users', 'projects', 'members')}, {_REACH_ALL} SELECT user_id, id, via FROM reach")
def reachable_projects(spark, sf_dir):
    return C.reachable_projects(*[made(spark, sf_dir, n) for n in ("users", "projects", "members")])


_SEEN = f"""{_with('users', 'projects', 'members', 'sessions')}, {_REACH_ALL}, every AS (
    SELECT user_id, session_id, id, nullif(project_id, 0) AS project_id, 'own' AS via FROM sessions WHERE {_LIVE}
    UNION ALL SELECT r.user_id, s.session_id, s.id, s.project_id, 'project' FROM reach r JOIN sessions s ON s.project_id = r.id WHERE {_LIVE.replace('session_id', 's.session_id')}
), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY via, id DESC) AS k FROM every), seen AS (SELECT user_id, session_id, project_id, via FROM ranked WHERE k = 1)"""


def _accessible(spark, sf_dir, project=None):
    users, projects, members = (made(spark, sf_dir, n) for n in ("users", "projects", "members"))
    return C.accessible_sessions(made(spark, sf_dir, "sessions"), C.reach(users, projects, members), projects, project)


@query(f"{_SEEN} SELECT * FROM seen")
def accessible_sessions(spark, sf_dir):
    return _accessible(spark, sf_dir)


@query(f"{_SEEN} SELECT * FROM seen WHERE project_id = 7")
def accessible_in_project(spark, sf_dir):
    return _accessible(spark, sf_dir, 7)


_OF_SESSIONS = "SELECT l_orderkey, l_linenumber, l_suppkey * 7 + l_linenumber AS user_id, 's' || (l_orderkey - l_orderkey % 2) AS session_id FROM lineitem"


@query(f"""{_with('users', 'projects', 'members', 'sessions')}, {_REACH}, live AS (SELECT user_id, session_id, nullif(project_id, 0) AS project_id FROM sessions WHERE {_LIVE}), a AS ({_OF_SESSIONS})
    SELECT a.*, EXISTS (SELECT 1 FROM live s WHERE s.session_id = a.session_id AND s.user_id = a.user_id) OR EXISTS (SELECT 1 FROM live s JOIN reach r ON r.id = s.project_id WHERE s.session_id = a.session_id AND r.user_id = a.user_id)
        OR EXISTS (SELECT 1 FROM reach r WHERE r.id IS NULL AND r.user_id = a.user_id) AND EXISTS (SELECT 1 FROM live s WHERE s.session_id = a.session_id AND s.project_id IS NOT NULL) AS may FROM a""")
def session_access(spark, sf_dir):
    """Requests of users for sessions: whether they may, admins included."""
    reach = C.reach(*[made(spark, sf_dir, n) for n in ("users", "projects", "members")])
    return C.sees(_rows(spark, sf_dir, "lineitem", _OF_SESSIONS), made(spark, sf_dir, "sessions"), reach).select("l_orderkey", "l_linenumber", "user_id", "session_id", "may")


@query(f"{_with('projects', 'sessions')} SELECT s.project_id AS id, p.name, p.user_id FROM (SELECT DISTINCT project_id FROM sessions WHERE project_id IS NOT NULL) s LEFT JOIN projects p ON p.id = s.project_id")
def project_lookup(spark, sf_dir):
    """Every project id that a session names, with the project where there is one."""
    asked = made(spark, sf_dir, "sessions").where("project_id is not null").select(F.col("project_id").alias("id")).distinct()
    return asked.join(C.first_of(made(spark, sf_dir, "projects"), ["id"], "name"), "id", "left").select("id", "name", "user_id")


@query(f"{_with('projects')} SELECT user_id, id, name, row_number() OVER (PARTITION BY user_id ORDER BY id DESC)::INTEGER AS place FROM projects")
def projects_by_user(spark, sf_dir):
    return C.listed(made(spark, sf_dir, "projects"), "user_id").select("user_id", "id", "name", "place")


@query(f"{_with('projects')} SELECT id, name, user_id, archived FROM projects ORDER BY id DESC")
def projects_listed(spark, sf_dir):
    return C.newest_first(made(spark, sf_dir, "projects")).select("id", "name", "user_id", "archived")


@query(f"{_with('projects')} SELECT user_id, id, is_default, row_number() OVER (PARTITION BY user_id ORDER BY is_default DESC, id DESC)::INTEGER AS place FROM projects")
def default_project_first(spark, sf_dir):
    return C.default_first(made(spark, sf_dir, "projects")).select("user_id", "id", "is_default", "place")


@query(f"{_with('projects', 'sessions')} SELECT s.id, s.session_id, s.project_id FROM sessions s JOIN projects p ON p.id = s.project_id WHERE {_LIVE.replace('session_id', 's.session_id')} AND NOT p.archived")
def sessions_of_active_projects(spark, sf_dir):
    active = made(spark, sf_dir, "projects").where("not archived").select(F.col("id").alias("project_id"))
    return made(spark, sf_dir, "sessions").where(_LIVE).join(active, "project_id", "left_semi").select("id", "session_id", "project_id")


@query(f"{_with('assets')} SELECT project_id, relative_path, min(id) AS id FROM assets GROUP BY ALL")
def asset_lookup(spark, sf_dir):
    return C.first_of(made(spark, sf_dir, "assets"), ["project_id", "relative_path"]).select("project_id", "relative_path", "id")


@query(f"{_with('assets')} SELECT project_id, id, relative_path, row_number() OVER (PARTITION BY project_id ORDER BY id DESC)::INTEGER AS place FROM assets")
def assets_by_project(spark, sf_dir):
    return C.listed(made(spark, sf_dir, "assets"), "project_id").select("project_id", "id", "relative_path", "place")


@query(f"{_with('users')} SELECT o_orderkey, u.username, u.role FROM (SELECT o_orderkey, '13' || (o_custkey + 10000) AS phone FROM orders) o LEFT JOIN users u ON u.phone = o.phone")
def user_by_phone(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'13' || (o_custkey + 10000) AS phone")
    return asked.join(C.first_of(made(spark, sf_dir, "users"), ["phone"], "user_id"), "phone", "left").select("o_orderkey", "username", "role")


#: A JSON array of plain strings, or nothing where it is null or broken; the default stands for both.
_PERMITTED = "CASE WHEN permissions IS NOT NULL AND json_valid(permissions) THEN array_to_string(CAST(permissions AS VARCHAR[]), ',') ELSE 'data_download' END"
_MEMBER = "strftime(joined_at, '%Y-%m-%dT%H:%M:%S')"


@query(f"{_with('members')}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id, user_id ORDER BY id) AS n FROM members) SELECT project_id, user_id, {_PERMITTED} AS permissions, {_MEMBER} AS joined_at FROM k WHERE n = 1")
def member_lookup(spark, sf_dir):
    """Each member of each project, permissions read and times in ISO form."""
    found = C.first_of(made(spark, sf_dir, "members"), ["project_id", "user_id"])
    return found.select("project_id", "user_id", F.array_join(T.permissions(F.col("permissions")), ",").alias("permissions"), G.iso_time(F.col("joined_at")).alias("joined_at"))


@query(f"{_with('members', 'users')} SELECT m.id, m.project_id, m.user_id, u.username, {_PERMITTED} AS permissions, {_MEMBER} AS joined_at FROM members m LEFT JOIN users u ON u.user_id = m.user_id")
def members_listed(spark, sf_dir):
    users = made(spark, sf_dir, "users").select("user_id", "username")
    own = C.members_with_users(made(spark, sf_dir, "members"), users)
    return own.select("id", "project_id", "user_id", "username", F.array_join(T.permissions(F.col("permissions")), ",").alias("permissions"), G.iso_time(F.col("joined_at")).alias("joined_at"))


@query(f"{_with('tasks')} SELECT project_id, id, kind, row_number() OVER (PARTITION BY project_id ORDER BY id DESC)::INTEGER AS place FROM tasks")
def tasks_by_project(spark, sf_dir):
    return C.listed(made(spark, sf_dir, "tasks"), "project_id").select("project_id", "id", "kind", "place")


# writes


@query(f"{_with('assets')}, t AS (SELECT project_id, relative_path, min(id) AS id FROM assets WHERE id % 3 = 0 GROUP BY ALL), s AS (SELECT project_id, relative_path, min(id + 100000) AS id FROM assets WHERE id % 3 <> 1 GROUP BY ALL) SELECT project_id, relative_path, coalesce(t.id, s.id) AS id, t.id IS NULL AS created FROM s LEFT JOIN t USING (project_id, relative_path)")
def asset_ids(spark, sf_dir):
    """The id that an insert-if-absent gives back: that of the row that is there, or the new one."""
    assets = made(spark, sf_dir, "assets").select("project_id", "relative_path", "id")
    staged = assets.where("id % 3 <> 1").withColumn("id", F.col("id") + 100000)
    return M.get_or_create(assets.where("id % 3 = 0"), staged, ["project_id", "relative_path"])


@query(f"""{_with('sessions')}, t AS (SELECT DISTINCT session_id FROM sessions WHERE id % 6 = 0 AND {_LIVE}), s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS k FROM sessions WHERE id % 6 <> 0 AND {_LIVE})
    SELECT id, session_id, CASE WHEN project_id > 0 THEN project_id END AS project_id, CASE WHEN k > 1 OR session_id IN (SELECT session_id FROM t) THEN 'duplicate' ELSE 'created' END AS outcome FROM s""")
def session_creation(spark, sf_dir):
    own = made(spark, sf_dir, "sessions").where(_LIVE)
    return M.new_sessions(own.where("id % 6 = 0"), own.where("id % 6 <> 0")).select("id", "session_id", "project_id", "outcome")


@query(f"""{_with('members')}, t AS (SELECT DISTINCT project_id, user_id FROM members WHERE id % 4 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY project_id, user_id ORDER BY id) AS k FROM members WHERE id % 4 <> 0 AND project_id IS NOT NULL)
    SELECT id, CASE WHEN k > 1 OR EXISTS (SELECT 1 FROM t WHERE t.project_id = s.project_id AND t.user_id = s.user_id) THEN 'duplicate' ELSE 'created' END AS outcome FROM s""")
def member_creation(spark, sf_dir):
    own = made(spark, sf_dir, "members").select("id", "project_id", "user_id").where("project_id is not null")
    return M.create(own.where("id % 4 = 0"), own.where("id % 4 <> 0"), ["project_id", "user_id"], "id").select("id", "outcome")


@query(f"{_with('tasks')} SELECT id, project_id, 'pending' AS status, CAST(json_object('kind', kind, 'n', n) AS VARCHAR) AS payload FROM tasks")
def task_creation(spark, sf_dir):
    return M.new_tasks(made(spark, sf_dir, "tasks"), ["kind", "n"])


_OFFERED = f"SELECT c_custkey AS id, c_custkey % 40 AS user_id, CASE WHEN c_custkey % 5 = 0 THEN ' ' || c_mktsegment WHEN c_custkey % 7 = 0 THEN ' {M.DEFAULT_PROJECT} ' WHEN c_custkey % 11 = 0 THEN '  ' END AS name FROM customer"


@query(f"SELECT id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'blank' WHEN trim(name) = '{M.DEFAULT_PROJECT}' THEN 'reserved' ELSE 'created' END AS outcome FROM ({_OFFERED})")
def project_creation(spark, sf_dir):
    return M.new_projects(made(spark, sf_dir, "users"), made(spark, sf_dir, "projects"), _rows(spark, sf_dir, "customer", _OFFERED))[0].select("id", "outcome")


@query(f"{_with('users', 'projects')} SELECT user_id, '{M.DEFAULT_PROJECT}' AS name, true AS is_default FROM users WHERE user_id NOT IN (SELECT user_id FROM projects WHERE is_default)")
def default_projects(spark, sf_dir):
    """Default projects to add for users without one."""
    users, projects = made(spark, sf_dir, "users"), made(spark, sf_dir, "projects")
    return M.new_projects(users, projects, projects)[1]


@query(f"{_with('users')} SELECT user_id, CASE WHEN phone = '1310012' THEN 'admin' ELSE role END AS role, phone = '1310012' AS promoted FROM users")
def admin_promotion(spark, sf_dir):
    return M.promote(made(spark, sf_dir, "users"), " 1310012 ").select("user_id", "role", "promoted")


_OUTPUTS = "SELECT p_partkey AS id, p_size % 20 AS project_id, 'out/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '.PNG' WHEN p_partkey % 5 = 1 THEN '.py' WHEN p_partkey % 5 = 2 THEN '.md' WHEN p_partkey % 5 = 3 THEN '.exe' ELSE '' END AS relative_path FROM part"
_KEPT = [".md", ".xlsx", ".xls", ".csv", ".tsv", ".json", ".html", ".htm", ".png", ".jpg", ".jpeg"]


@query(f"""WITH f AS ({_OUTPUTS}), s AS (SELECT project_id, 'outputs/' || relative_path AS relative_path, id FROM f WHERE lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) IN ({', '.join(repr(e) for e in _KEPT)})),
    t AS (SELECT project_id, relative_path, min(id + 500000) AS id FROM s WHERE id % 2 = 0 GROUP BY ALL), n AS (SELECT project_id, relative_path, min(id) AS id FROM s GROUP BY ALL)
    SELECT project_id, relative_path, coalesce(t.id, n.id) AS id, t.id IS NULL AS created FROM n LEFT JOIN t USING (project_id, relative_path)""")
def output_registration(spark, sf_dir):
    """Outputs of the kept extensions as assets below ``outputs/``, beside those that are there already."""
    files, target = _rows(spark, sf_dir, "part", _OUTPUTS), F.concat(F.lit("outputs/"), "relative_path")
    from .files import PROMOTED

    there = files.where("id % 2 = 0").select("project_id", target.alias("relative_path"), (F.col("id") + 500000).alias("id"))
    return M.registered(files, there, PROMOTED, target)


_WANTED = "SELECT o_orderkey AS id, o_custkey % 20 AS project_id, CASE WHEN o_orderkey % 4 = 0 THEN '/raw\\\\' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'outputs/' WHEN o_orderkey % 5 = 1 THEN 'raw/../' WHEN o_orderkey % 4 = 0 THEN '' ELSE 'raw/' END || lower(o_orderstatus) || '_' || (o_custkey % 3) || '.csv' AS path FROM orders"
_CLEAN = "ltrim(replace(trim(path), '\\', '/'), '/')"


@query(f"""WITH w AS ({_WANTED.replace(chr(92) * 2, chr(92))}), a AS (SELECT DISTINCT p_size % 20 AS project_id, 'raw/' || lower(substr(p_type, 1, 1)) || '_1.csv' AS path FROM part UNION SELECT DISTINCT p_size % 20, 'raw/f_0.csv' FROM part)
    SELECT id, CASE WHEN NOT starts_with({_CLEAN}, 'raw/') OR contains({_CLEAN}, '../') THEN 'bad_path' WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.project_id = w.project_id AND a.path = {_CLEAN.replace('path', 'w.path')}) THEN 'missing' ELSE 'ok' END AS verdict FROM w""")
def raw_copy_checks(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    there = part.selectExpr("p_size % 20 AS project_id", "'raw/' || lower(substr(p_type, 1, 1)) || '_1.csv' AS clean").unionByName(part.selectExpr("p_size % 20 AS project_id", "'raw/f_0.csv' AS clean")).distinct()
    asked = _rows(spark, sf_dir, "orders", _WANTED).withColumn("clean", F.ltrim(F.translate(F.trim("path"), "\\", "/"), F.lit("/")))
    found = asked.join(there.withColumn("exists", F.lit(True)), ["project_id", "clean"], "left")
    return found.select("id", U.raw_copy_verdict(F.col("path"), F.col("exists")).alias("verdict"))


@query(f"""{_with('assets')}, f AS (SELECT p_size % 20 AS project_id, 'raw/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.tsv' ELSE '.csv' END AS relative_path, p_partkey FROM part),
    n AS (SELECT project_id, relative_path, arg_min(original_name, id) AS original_name FROM assets WHERE trim(coalesce(original_name, '')) <> '' GROUP BY ALL)
    SELECT p_partkey, coalesce(original_name, regexp_extract(relative_path, '([^/]*)$', 1)) AS original_name FROM f LEFT JOIN n USING (project_id, relative_path)""")
def original_names(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size % 20 AS project_id", "'raw/' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '.tsv' ELSE '.csv' END AS relative_path")
    return C.original_names(files, made(spark, sf_dir, "assets")).select("p_partkey", "original_name")


@query("""WITH u AS (SELECT p_partkey, p_brand AS d, replace(p_type, ' ', '_') AS st, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part WHERE p_size >= 10),
    t AS (SELECT DISTINCT p_brand AS d, replace(p_type, ' ', '_') AS st, p_size AS n FROM part WHERE p_size < 10),
    g AS (SELECT d, st, unnest(range(0, m + 12)) AS n FROM (SELECT d, st, max(k) AS m FROM u GROUP BY ALL)),
    f AS (SELECT g.d, g.st, g.n, row_number() OVER (PARTITION BY g.d, g.st ORDER BY g.n) AS k FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.d = g.d AND t.st = g.st AND t.n = g.n))
    SELECT p_partkey, u.st || CASE WHEN f.n = 0 THEN '' ELSE ' (' || f.n || ')' END || '.csv' AS stored, f.n > 0 AS renamed FROM u JOIN f ON f.d = u.d AND f.st = u.st AND f.k = u.k""")
def unique_names(spark, sf_dir):
    """Uploads of all folders (brands), beside files that took some of the numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("directory"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("stem"), "p_size")
    uploads = part.where("p_size >= 10").select("p_partkey", "directory", F.concat("stem", F.lit(".csv")).alias("name"), F.col("p_partkey").alias("ord"))
    there = part.where("p_size < 10").select("directory", F.concat("stem", F.when(F.col("p_size") == 0, "").otherwise(F.concat(F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))), F.lit(".csv")).alias("name"))
    return names.allocate(uploads, there).select("p_partkey", "stored", "renamed")


# rules


_OFFERS = """SELECT p_partkey AS seq, CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 = 0 THEN 'builtin.table.csv' ELSE 'own.' || (p_partkey % 17) END AS format_id,
    CASE WHEN p_partkey % 5 = 0 THEN 'magic' ELSE 'text' END AS handler_id, CASE WHEN p_partkey % 6 = 0 THEN 'sound' WHEN p_partkey % 6 = 1 THEN 'binary' ELSE 'text' END AS category, p_size AS priority FROM part"""
_OUTCOME = "CASE WHEN trim(format_id) = '' THEN 'no_id' WHEN format_id LIKE 'builtin.%' THEN 'protected' WHEN handler_id = 'magic' THEN 'unknown_handler' WHEN category = 'sound' THEN 'unknown_category' ELSE 'stored' END"


def _changed(spark, sf_dir):
    custom = spark.range(7).selectExpr("'own.' || id AS format_id", "'text' AS category", "'text' AS handler_id", "-1 AS priority", "cast(id AS int) AS ordinal")
    return rules.upserted(custom, _rows(spark, sf_dir, "part", _OFFERS), ["table", "image", "text", "binary"], "seq")


@query(f"SELECT seq, {_OUTCOME} AS outcome FROM ({_OFFERS})")
def rule_offers(spark, sf_dir):
    return _changed(spark, sf_dir)[0].select("seq", "outcome")


@query(f"""WITH s AS (SELECT * FROM ({_OFFERS}) WHERE {_OUTCOME} = 'stored'), l AS (SELECT format_id, arg_max(category, seq) AS category, arg_max(priority, seq) AS priority, min(seq) AS first FROM s GROUP BY 1),
    c AS (SELECT 'own.' || i AS format_id, i AS ordinal FROM range(7) r(i)), n AS (SELECT format_id, 6 + row_number() OVER (ORDER BY first) AS ordinal FROM l WHERE format_id NOT IN (SELECT format_id FROM c))
    SELECT format_id, coalesce(l.category, 'text') AS category, coalesce(l.priority, -1)::INTEGER AS priority, ordinal::INTEGER AS ordinal FROM (SELECT * FROM c UNION ALL SELECT * FROM n) LEFT JOIN l USING (format_id)""")
def custom_rules(spark, sf_dir):
    """The table of custom rules after all offers."""
    return _changed(spark, sf_dir)[1].select("format_id", "category", F.col("priority").cast("int").alias("priority"), "ordinal")


@query("SELECT DISTINCT format_id, CASE WHEN format_id LIKE 'builtin.%' THEN 'protected' WHEN substr(format_id, 5)::INTEGER < 7 THEN 'deleted' ELSE 'unknown' END AS outcome FROM (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'builtin.table.csv' ELSE 'own.' || (p_partkey % 12) END AS format_id FROM part)")
def rule_deletions(spark, sf_dir):
    custom = spark.range(7).selectExpr("'own.' || id AS format_id", "cast(id AS int) AS ordinal")
    asked = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_partkey % 10 = 0 THEN ' builtin.table.csv' ELSE 'own.' || (p_partkey % 12) END AS format_id")
    return rules.deleted(custom, asked)[0]


_IDS = ", ".join(f"('{r[0]}', '{r[2]}')" for r in rules.BUILTIN)


@query(f"WITH r AS (SELECT * FROM (VALUES ('own.text', 'text'), {_IDS}) v(format_id, handler_id)), k AS (SELECT list(format_id ORDER BY format_id) AS ids FROM r) SELECT p_partkey, q.format_id, r.handler_id FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'own.text' WHEN p_partkey % 2 = 0 THEN ids[p_partkey % 9 + 1] ELSE 'none.' || p_brand END AS format_id FROM part, k) q LEFT JOIN r USING (format_id)")
def rule_lookup(spark, sf_dir):
    known = rules.rules(spark, [{"format_id": "own.text", "category": "text", "handler_id": "text", "extensions": ["mdx"]}])
    ids = sorted(["own.text", *(r[0] for r in rules.BUILTIN)])
    name = F.when(F.col("p_partkey") % 9 == 0, "own.text").when(F.col("p_partkey") % 2 == 0, F.element_at(F.array(*map(F.lit, ids)), (F.col("p_partkey") % 9 + 1).cast("int"))).otherwise(F.concat(F.lit("none."), "p_brand"))
    return rules.by_id(known, table(spark, sf_dir, "part").select("p_partkey", name.alias("format_id"))).select("p_partkey", "format_id", "handler_id")


# workspaces and routing


_LISTED = "SELECT o_custkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'main.py' WHEN o_orderkey % 3 = 1 THEN 'raw/x' || o_orderkey || CASE WHEN o_totalprice < 60000 THEN '.CSV' WHEN o_totalprice < 100000 THEN '.bin' ELSE '' END ELSE 'd/SESSION_MEMORY.md' END AS name FROM orders"
_DIGESTS = "SELECT o_custkey AS session_id, CASE WHEN o_orderkey % 5 = 0 THEN ' Table ' WHEN o_orderkey % 5 = 1 THEN 'binary' END AS file_type, CASE WHEN o_orderkey % 7 = 0 THEN 'a/b.log' WHEN o_orderkey % 7 = 1 THEN '.csv' END AS relative_path FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 2 = 0"
_TYPES = ", ".join(repr(e) for e in R.DATA_EXTENSIONS)


@query(f"""WITH d AS ({_DIGESTS}), l AS ({_LISTED}), e AS (
    SELECT session_id FROM d WHERE lower(trim(coalesce(file_type, ''))) IN ('table', 'image', 'text', 'document', 'imaging') OR lower(regexp_extract(regexp_extract(coalesce(relative_path, ''), '([^/]*)$', 1), '^\\.*[^.].*?(\\.[^.]*)$', 1)) IN ({_TYPES})
    UNION SELECT session_id FROM l WHERE regexp_extract(name, '([^/]*)$', 1) NOT IN ('SESSION_MEMORY.md', 'main.py') AND lower(regexp_extract(name, '(\\.[^./]*)$', 1)) IN ({_TYPES}))
    SELECT c_custkey AS session_id, c_custkey IN (SELECT session_id FROM e) AS data FROM customer""")
def analyzable_workspaces(spark, sf_dir):
    spaces = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return R.analyzable(spaces, _rows(spark, sf_dir, "orders", _DIGESTS), _rows(spark, sf_dir, "orders", _LISTED))


@query("SELECT c_custkey AS session_id, coalesce((SELECT bool_or(o_orderstatus = 'F') FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 140000), false) AS code FROM customer")
def workspaces_with_code(spark, sf_dir):
    writes = table(spark, sf_dir, "orders").where("o_totalprice > 140000").selectExpr("o_custkey AS session_id", "CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderkey % 2 = 0 THEN false END AS success")
    return R.code_written(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), writes)


_STATE = """SELECT event_id, event_id % 2 = 0 AS plan, event_id % 3 <> 0 AS code, event_id % 5 < 3 AS ran, event_id % 7 < 4 AS failed, event_id % 11 <> 0 AS data, event_id % 13 = 0 AS done,
    CASE WHEN event_type = 'view' THEN ' coder ' WHEN event_type = 'click' THEN 'planner' WHEN event_type = 'error' THEN 'worker' WHEN event_type = 'signup' THEN 'reporter' END AS last, CAST(event_id % 8 AS INTEGER) AS corrections, value > 50 AS en FROM events"""


@query(f"""WITH s AS ({_STATE}), t AS (SELECT *, trim(coalesce(last, '')) AS l, ran AND failed AS wrong FROM s) SELECT event_id, concat_ws(chr(10),
    'last_completed_stage=' || CASE WHEN l = '' THEN '{R.NOTHING}' ELSE l END,
    'plan_ok=' || CASE WHEN plan THEN 'True' ELSE 'False' END || ' code_ok=' || CASE WHEN code THEN 'True' ELSE 'False' END || ' worker_ran=' || CASE WHEN ran THEN 'True' ELSE 'False' END || ' worker_success=' || CASE WHEN NOT ran THEN 'None' WHEN failed THEN 'False' ELSE 'True' END,
    'reporter_done=' || CASE WHEN done THEN 'True' ELSE 'False' END || ' correction_attempts=' || corrections, 'has_analyzable_data=' || CASE WHEN data THEN 'True' ELSE 'False' END,
    CASE WHEN en THEN '{R.ROLES['en']}' ELSE '{R.ROLES['zh']}' END, CASE WHEN NOT data AND plan AND NOT done THEN CASE WHEN en THEN '{R.NO_DATA['en']}' ELSE '{R.NO_DATA['zh']}' END END,
    CASE WHEN l = 'coder' AND code AND data THEN '{R.CODE_DONE}' WHEN wrong AND corrections >= 5 THEN '{R.FIXES_SPENT}' WHEN wrong THEN '{R.FIX_CODE}' END,
    CASE WHEN NOT plan THEN '{R.NO_PLAN}' WHEN l = 'planner' AND data THEN '{R.PLANNED}' WHEN l = 'worker' AND ran AND NOT failed THEN '{R.RAN}' WHEN l = 'reporter' AND done THEN '{R.REPORTED}' END) AS hint FROM t""")
def supervisor_hints(spark, sf_dir):
    return _rows(spark, sf_dir, "events", _STATE).select("event_id", R.hint(F.col("en")).alias("hint"))


# the event log and uploads


_BEFORE = "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type || CASE WHEN event_id % 50 = 0 THEN '*' ELSE '' END AS event, event_id FROM events WHERE event_id % 3 <> 0 OR user_id % 4 = 0"
_AFTER = "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_type AS event, event_id FROM events WHERE user_id % 4 < 3 OR event_id % 3 <> 0 AND (user_id % 8 < 7 OR event_id % 2 = 0)"


@query(f"""WITH b AS ({_BEFORE}), a AS ({_AFTER}), n AS (SELECT session_id, count(*) AS n FROM b GROUP BY 1), m AS (SELECT session_id, count(*) AS m, max(place) AS top FROM a GROUP BY 1),
    c AS (SELECT a.session_id, max(a.place) AS place FROM a JOIN b ON b.session_id = a.session_id AND b.place = a.place AND b.event <> a.event GROUP BY 1)
    SELECT a.session_id, a.event FROM a JOIN m ON m.session_id = a.session_id LEFT JOIN n ON n.session_id = a.session_id LEFT JOIN c ON c.session_id = a.session_id
    WHERE m.m > coalesce(n.n, 0) AND a.place = m.top OR m.m = n.n AND a.place = c.place""")
def event_increments(spark, sf_dir):
    """What readers of every session are sent after its log has grown, stayed as long, or shrunk."""
    return E.increments(_rows(spark, sf_dir, "events", _BEFORE), _rows(spark, sf_dir, "events", _AFTER))


@query("""WITH e AS (SELECT user_id AS session_id, event_id AS version, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'streaming_ended' ELSE 'stage_result' END AS type FROM events),
    s AS (SELECT user_id AS session_id, min(event_id) + (max(event_id) - min(event_id)) // 3 AS seen FROM events GROUP BY 1), k AS (SELECT e.*, CASE WHEN version <= seen THEN 'snapshot' ELSE 'tail' END AS part FROM e JOIN s USING (session_id)),
    l AS (SELECT session_id, arg_max(type, version) IN ('error', 'streaming_error', 'streaming_ended') AS over FROM k WHERE part = 'snapshot' GROUP BY 1), t AS (SELECT session_id, min(version) AS first FROM k WHERE part = 'tail' AND type IN ('error', 'streaming_error', 'streaming_ended') GROUP BY 1)
    SELECT k.session_id, k.version, k.type, k.part FROM k LEFT JOIN l USING (session_id) LEFT JOIN t USING (session_id) WHERE part = 'snapshot' OR NOT coalesce(over, false) AND (first IS NULL OR version <= first)""")
def snapshot_and_tail(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id AS session_id", "event_id AS version", "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'streaming_ended' ELSE 'stage_result' END AS type")
    seen = log.groupBy("session_id").agg(F.expr("min(version) + (max(version) - min(version)) div 3").alias("seen"))
    return E.snapshot_then_tail(log, seen).select("session_id", "version", "type", "part")


_FRAMES = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ': note' || chr(10) ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '' END || 'data: ' || CASE WHEN event_id % 7 = 0 THEN substr(props, 2) ELSE props END || ' ' || chr(10) || chr(10) || 'data:' || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' {\"v\":' || user_id || '}' END || CASE WHEN event_id % 2 = 0 THEN chr(10) ELSE '' END AS text FROM events"


@query(f"""WITH f AS ({_FRAMES}), l AS (SELECT event_id, unnest(string_split(text, chr(10))[1:-2]) AS line, generate_subscripts(string_split(text, chr(10))[1:-2], 1) - 1 AS place FROM f),
    p AS (SELECT event_id, place::INTEGER AS place, trim(substr(trim(line), 6)) AS payload FROM l WHERE starts_with(trim(line), 'data:')) SELECT * FROM p WHERE payload <> '' AND json_valid(payload)""")
def sse_payloads(spark, sf_dir):
    return E.sse_events(_rows(spark, sf_dir, "events", _FRAMES))


@query("SELECT user_id AS session_id, event_id, (coalesce((SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view'), 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS version FROM events e WHERE event_type <> 'view'")
def appended_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    log = e.where("event_type = 'view'").select("session_id", F.col("event_id").alias("version"))
    return E.appended(log, e.where("event_type <> 'view'")).select("session_id", "event_id", "version")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s <= 0 THEN 'empty' WHEN s > 2147483648 THEN 'too_large' ELSE 'ok' END AS verdict FROM (SELECT *, CAST(l_quantity * 90000000 - 180000000 AS BIGINT) AS s FROM lineitem)")
def upload_sizes(spark, sf_dir):
    size = (F.col("l_quantity") * 90000000 - 180000000).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", U.size_verdict(size).alias("verdict"))


@query("SELECT event_id, greatest(0, 86400 - date_diff('second', ts, TIMESTAMP '2024-01-03 00:00:00'))::BIGINT AS remaining FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def upload_remaining(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.remaining_seconds(F.col("ts"), F.to_timestamp(F.lit("2024-01-03 00:00:00"))).cast("long").alias("remaining"))


_CHECKED = "SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN ' ' WHEN doc_id % 5 = 2 THEN upper({}) || ' ' WHEN doc_id % 5 = 3 THEN {} ELSE '00' END AS checksum FROM documents"


@query(f"SELECT doc_id, sha256(t) AS actual, trim(coalesce(checksum, '')) = '' OR lower(trim(checksum)) = sha256(t) AS matches FROM ({_CHECKED.format(*['sha256(coalesce(text, ' + repr('') + '))'] * 2)})")
def part_checksums(spark, sf_dir):
    """Checksums of real bytes against what was declared, in either case."""
    parts = _rows(spark, sf_dir, "documents", _CHECKED.format(*["sha2(coalesce(text, ''), 256)"] * 2)).withColumn("content", F.to_binary("t", F.lit("utf-8")))
    return U.verified(parts).select("doc_id", "actual", "matches")


@query("""WITH c AS (SELECT conv_id AS upload_id, turn AS part, coalesce(text, '') AS t FROM conversations WHERE (conv_id + turn) % 6 <> 5), m AS (SELECT conv_id AS upload_id, count(*) AS total, sum(strlen(coalesce(text, ''))) + CASE WHEN conv_id % 4 = 3 THEN 1 ELSE 0 END AS size FROM conversations GROUP BY conv_id),
    s AS (SELECT m.upload_id, m.total, m.size, count(c.part) AS held, coalesce(sum(strlen(t)), 0) AS n, string_agg(t, '' ORDER BY part) AS whole FROM m LEFT JOIN c ON c.upload_id = m.upload_id AND part < total GROUP BY ALL)
    SELECT upload_id, CASE WHEN held < total THEN 'incomplete' WHEN n <> size THEN 'size' ELSE 'ok' END AS outcome, n::BIGINT AS n_bytes, CASE WHEN held >= total AND n = size THEN sha256(whole) END AS sha256 FROM s""")
def merged_uploads(spark, sf_dir):
    """Parts joined as bytes where all are there and the size is the declared one."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), F.col("turn").alias("part"), F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8")).alias("content"))
    size = F.sum(F.octet_length("content")) + F.when(F.col("upload_id") % 4 == 3, 1).otherwise(0)
    return U.merged_uploads(c.where("(upload_id + part) % 6 <> 5"), c.groupBy("upload_id").agg(F.count("*").alias("total"), size.alias("size"))).select("upload_id", "outcome", "n_bytes", "sha256")


@query("""WITH f AS (SELECT event_id, event_id % 6 AS k, date_trunc('second', ts) AS ts FROM events) SELECT event_id, CASE WHEN k = 0 THEN 'remove_missing' WHEN k IN (1, 2) THEN 'remove_corrupt' WHEN date_diff('second', ts, TIMESTAMP '2024-01-03 00:00:00') > 86400 THEN 'expired' ELSE 'keep' END AS verdict FROM f""")
def upload_sweep(spark, sf_dir):
    """Folders whose manifest is missing, broken, without a time, or too old."""
    said = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    manifest = F.when(F.col("event_id") % 6 == 1, F.concat(F.lit('{"created_at": "'), said)).when(F.col("event_id") % 6 == 2, F.lit('{"size": 3}')).when(F.col("event_id") % 6 > 2, F.concat(F.lit('{"created_at": "'), said, F.lit('", "size": 3}')))
    return U.sweep(table(spark, sf_dir, "events").select("event_id", manifest.alias("manifest")), F.to_timestamp(F.lit("2024-01-03 00:00:00"))).select("event_id", "verdict")


# commands, deletions, headers, decisions


_COMMANDS = "SELECT p_partkey AS id, p_size % 6 AS session_id, CASE WHEN p_size % 7 = 0 THEN 'python ' WHEN p_size % 7 = 1 THEN ' python3 ' ELSE 'python3  ' END || p_type || CASE WHEN p_size % 5 = 0 THEN '.sh' ELSE '.py' END || CASE WHEN p_size % 11 = 0 THEN '; rm' WHEN p_size % 11 = 1 THEN ' x' ELSE ' ' END AS command FROM part"
_SCRIPTS = "SELECT p_size % 6 AS session_id, p_type || '.py' AS relative_path FROM part WHERE p_partkey % 3 = 0"


@query(f"""WITH c AS ({_COMMANDS}), s AS (SELECT DISTINCT * FROM ({_SCRIPTS})), m AS (SELECT *, regexp_extract(command, '^python3\\s+(\\S+)\\s*$', 1) AS script FROM c)
    SELECT id, CASE WHEN regexp_matches(command, '[;|&`$<>]') OR NOT ends_with(script, '.py') THEN 'refused' WHEN s.relative_path IS NULL THEN 'missing' ELSE 'ok' END AS verdict FROM m LEFT JOIN s ON s.session_id = m.session_id AND s.relative_path = m.script""")
def runnable_commands(spark, sf_dir):
    return R.runnable(_rows(spark, sf_dir, "part", _COMMANDS), _rows(spark, sf_dir, "part", _SCRIPTS)).select("id", "verdict")


_ASKED = "SELECT p_size % 20 AS project_id, 'raw/' || replace(p_name, ' ', '_') || '.csv' AS path, p_partkey % 3 <> 0 AS session_exists, p_partkey % 5 = 0 AS archived, CASE WHEN p_partkey % 4 = 0 THEN 'directory' WHEN p_partkey % 7 > 0 THEN 'file' END AS kind FROM part WHERE p_partkey % 2 = 0"


@query(f"{_with('assets')}, g AS (SELECT project_id, path FROM ({_ASKED}) WHERE session_exists AND NOT archived AND kind = 'file') SELECT id, project_id, relative_path FROM assets a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = a.project_id AND g.path = a.relative_path)")
def assets_after_deletions(spark, sf_dir):
    """Assets that stay after requests to delete files, of which some are refused."""
    return M.deleted_files(_rows(spark, sf_dir, "part", _ASKED), made(spark, sf_dir, "assets"))[1].select("id", "project_id", "relative_path")


@query("SELECT p_brand AS x, p_type AS x_1, p_name AS \"Unnamed: 2\" FROM part WHERE p_partkey >= (SELECT p_partkey FROM part ORDER BY 1 OFFSET 7 LIMIT 1)")
def repaired_header(spark, sf_dir):
    """A table whose data begins at its eighth row, under given names of which two are equal and one blank."""
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), "p_brand", "p_type", "p_name")
    return tables.repaired(raw, 7, ["x", "x", " "])[0]


_REPLIES = """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'so:' || chr(10) || '```json' || chr(10) ELSE 'I say ' END || '{"next_stage": "' || CASE WHEN event_type = 'error' THEN 'coder' WHEN event_type = 'click' THEN 'worker' WHEN event_type = 'view' THEN 'nowhere' ELSE 'finish' END || '", "reason": "' || CASE WHEN event_id % 10 = 0 THEN repeat('r', 2001) ELSE 'r' || user_id END
    || CASE WHEN event_id % 3 = 0 THEN '"}' WHEN event_id % 3 = 1 THEN '", }' ELSE '' END || CASE WHEN event_id % 4 = 0 THEN chr(10) || '```' ELSE '' END AS reply FROM events"""


@query("""SELECT event_id, CASE WHEN event_type = 'view' OR event_id % 10 = 0 THEN '-' WHEN event_type = 'error' THEN 'coder' WHEN event_type = 'click' THEN 'worker' ELSE 'finish' END AS next_stage, CASE WHEN event_type = 'view' OR event_id % 10 = 0 THEN '-' ELSE 'r' || user_id END AS reason FROM events""")
def mended_decisions(spark, sf_dir):
    """Decisions from replies with prose, fences, trailing commas and objects that are cut off."""
    made_ = _rows(spark, sf_dir, "events", _REPLIES).select("event_id", G.decision(F.col("reply")).alias("d"))
    return made_.select("event_id", F.coalesce("d.next_stage", F.lit("-")).alias("next_stage"), F.coalesce("d.reason", F.lit("-")).alias("reason"))
