"""What admins reach is listed whole, against plain Python."""

import pytest

from loomtab.operators import catalog as C

USERS = [(1, False), (2, True), (3, None), (4, True)]
PROJECTS = [(10, 1), (11, 2), (12, 3)]
MEMBERS = [(11, 1), (10, 1), (0, 3), (None, 3), (99, 3), (12, 2)]
SESSIONS = [(1, "a", 1, 10), (2, "a", 3, 11), (3, "b", 2, 12), (4, "b", 3, 10), (5, "c", 4, None), (6, "c", 1, 12), (7, " ", 2, 11), (8, None, 3, 10), (9, "d", 3, 99), (10, "e", 3, 0), (11, "f", 9, 11)]


@pytest.fixture
def catalog(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return [made(USERS, "user_id long, is_admin boolean"), made(PROJECTS, "id long, user_id long"), made(MEMBERS, "project_id long, user_id long"), made(SESSIONS, "id long, session_id string, user_id long, project_id long")]


def _reached():
    out = set()
    for user, admin in USERS:
        for project, owner in PROJECTS:
            if admin or owner == user or (project, user) in MEMBERS:
                out.add((user, project, "admin" if admin else "owner" if owner == user else "member"))
    return out


def test_admins_reach_every_project(catalog):
    users, projects, members, _ = catalog
    got = [tuple(r) for r in C.reachable_projects(users, projects, members).select("user_id", "id", "via").collect()]
    assert len(got) == len(set(got)) and set(got) == _reached()


def _seen():
    best = {}
    for i, session, owner, project in SESSIONS:
        if session is None or not session.strip():
            continue
        rows = [(owner, ("own", -i), project or None)] + [(u, ("project", -i), p) for u, p, _ in _reached() if p == project]
        for user, rank, own in rows:
            if (user, session) not in best or rank < best[user, session][0]:
                best[user, session] = rank, own
    return {(u, s, p, rank[0]) for (u, s), (rank, p) in best.items()}


@pytest.mark.parametrize("project", [None, 10, 12])
def test_admins_see_every_session_of_projects(catalog, project):
    users, projects, members, sessions = catalog
    found = C.accessible_sessions(sessions, C.reach(users, projects, members), projects, project)
    got = [tuple(r) for r in found.select("user_id", "session_id", "project_id", "via").collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in _seen() if project is None or x[2] == project}
    assert project or {u for u, _, _, _ in got} >= {2, 4}


@pytest.mark.parametrize("listed", [1, 3, 128])
def test_pairs_are_made_after_the_join(spark, monkeypatch, listed):
    """The join passes on a row for each list, in a step of its own; the pairs, null ones too, come from the step above."""
    monkeypatch.setattr(C, "LISTED", listed)
    few = spark.createDataFrame([(i,) for i in [None, *range(40)]], "user_id long")
    many = spark.range(50).selectExpr("id", "if(id % 2 = 0, 's' || id, null) AS name")
    pairs = C.each_with_every(few, many)
    assert pairs.columns == ["user_id", "id", "name"]
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == 41 * 50 and set(got) == {(u, i, f"s{i}" if i % 2 == 0 else None) for u in [None, *range(40)] for i in range(50)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate inline") < plan.index("Repartition 256, false") < plan.index("Join Inner")
