"""Queries over texts, paths and contents that vary from row to row, held against SQL that parses them by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import stages as G
from ..functions import text as T
from ..operators import rules
from ..operators import stats as D
from .common import table
from .requests import _rows

_NL = "chr(10)"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CODE = f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '```python' || {_NL} || text || {_NL} || '```' WHEN 1 THEN '```' || {_NL} || text || {_NL} || '```' || {_NL} WHEN 2 THEN text WHEN 3 THEN '```python ' || text
    WHEN 4 THEN replace(text, {_NL}, {_NL} || '```' || {_NL} || '  ') WHEN 5 THEN 'intro' || {_NL} || '```python' || {_NL} || 'x = 1' || {_NL} || '```' || {_NL} || text || ' ```' END AS code FROM documents"""


def unfenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in fences of several kinds, open ones and ones inside included, without them."""
    code = T.unfence(F.col("code"))
    return _rows(spark, sf_dir, "documents", _CODE).select("doc_id", F.length(code).alias("n"), F.sha2(code, 256).alias("code_sha256"))


_MEMORY = f"""SELECT doc_id, '# memory' || {_NL} || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## 3. before' || {_NL} || text || {_NL} END
    || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '## 4. digest of ' || doc_id || {_NL} || text || {_NL} WHEN 2 THEN '##  4.' || {_NL} || {_NL} || 'a ## 5. b' || {_NL} ELSE '## 4. one' || {_NL} || '## 14. more ' || source || {_NL} || text || {_NL} || '## 4. two' || {_NL} END
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '## 5. after ' || doc_id || {_NL} || lang || {_NL} || '  ' END AS memory FROM (SELECT doc_id, lang, source, replace(coalesce(text, ''), '#', '') AS text FROM documents)"""


def memory_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory documents around whole texts, without their fourth section: in the middle, at the end, twice, right before another, or not there."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "source", "replace(coalesce(text, ''), '#', '') AS text")
    made = spark.sql(_MEMORY.split(" FROM (")[0] + " FROM {docs}", docs=docs)
    left = G.without_digest(F.col("memory"))
    return made.select("doc_id", F.length(left).alias("n"), F.sha2(left, 256).alias("memory_sha256"))


def flattened_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON strings, as lists of strings and parts, and as they are."""
    t, k = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9 ]", ""), F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit('"'), t, F.lit('"'))).when(k == 1, F.concat(F.lit('[{"type": "text", "text": "'), t, F.lit('"}, "'), "lang", F.lit('"]')))
    content = content.when(k == 2, F.concat(F.lit('["'), "source", F.lit('", {"text": "'), t, F.lit('"}, {"text": "end"}]'))).otherwise(F.concat(F.lit("said "), t))
    said = G.flattened(content)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(said).alias("n"), F.sha2(said, 256).alias("said_sha256"))


_PLACES = """SELECT doc_id, '/w/' || source || '/p' AS project_root, '/w/' || source || '/old ' || lang AS session_root, 's' || doc_id % 9 AS session,
    '/w/' || source || CASE WHEN doc_id % 3 = 0 THEN '/p/raw/' ELSE '/old ' || lang || '/p/' END || substr(text, 1, doc_id % 23) || doc_id || '.csv' AS path FROM documents"""


def asset_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _rows(spark, sf_dir, "documents", _PLACES)
    return own.select("doc_id", G.asset_path(*[F.col(c) for c in ("path", "project_root", "session_root", "session")]).alias("path"))


def session_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of sessions with and without a project, below names that vary, and the session that a file in them tells."""
    host = F.get(F.split("url", "/"), F.lit(2))
    project = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string")))
    folder = N.session_folder(F.coalesce(host, F.lit("u")), project, F.concat(F.lit("s-"), F.col("page_id").cast("string")))
    path = F.concat(folder, F.when(F.col("page_id") % 2 == 0, "/raw/a.csv").otherwise("/b"))
    return table(spark, sf_dir, "pages").select("page_id", folder.alias("folder"), N.session_of(path).alias("session_id"))


_PARTS = f"SELECT doc_id, split_part(text, {_NL}, 1) AS analysis, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE split_part(text, {_NL}, 2) END AS steps, CASE WHEN doc_id % 4 = 0 THEN split_part(text, {_NL}, 3) WHEN doc_id % 4 = 1 THEN chr(9) END AS given FROM documents"


def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of which the text, the analysis or the steps are missing, blank or there, from whole lines of documents."""
    own = _rows(spark, sf_dir, "documents", _PARTS)
    a, s = F.col("analysis"), F.col("steps")
    return own.select("doc_id", F.sha2(G.final_plan(F.col("given"), a, s), 256).alias("plan_sha256"), G.plan_is_valid(a, s).alias("valid"))


#: Rules that a person added: one that outranks the built-in ones by extension, one by content type, two that tie by magic.
CUSTOM = [
    {"format_id": "own.csv", "category": "table", "handler_id": "own", "extensions": ["csv"], "priority": 1},
    {"format_id": "own.mime", "category": "text", "handler_id": "text", "extensions": [], "mime_types": ["Application/X-Own"], "priority": 5},
    {"format_id": "own.magic.a", "category": "binary", "handler_id": "binary", "extensions": [], "magic_prefixes": ["CA FE"], "priority": 3},
    {"format_id": "own.magic.b", "category": "text", "handler_id": "text", "extensions": [], "magic_prefixes": ["cafeba"], "priority": 3},
    {"format_id": "own.off", "category": "text", "handler_id": "text", "extensions": ["png"], "priority": 9, "enabled": False},
]
_MIMES = ["", "text/csv; charset=utf-8", "IMAGE/PNG", "application/x-own", "application/pdf", "x/unknown"]
_MAGICS = ["", "cafebabe00000000", "89504e470d0a1a0a", "255044462d312e34", "504b030400000000"]
_EXTENSIONS = ["", ".csv", ".PNG", ".pdf", ".xyz", ".docx", ".txt"]
_pick = lambda values, n: f"CASE {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
_FILES = f"SELECT doc_id, source || '/' || doc_id || {_pick(_EXTENSIONS, 'doc_id % 7')} AS path, {_pick(_MIMES, 'n_chars % 6')} AS mime, {_pick(_MAGICS, '(doc_id + n_chars) % 5')} AS magic FROM documents"


def resolved_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, content type and first bytes at once, under custom rules that tie, outrank and are off."""
    files = _rows(spark, sf_dir, "documents", _FILES)
    found = rules.resolve(files, rules.rules(spark, CUSTOM, ("builtin.text.plain",)), mime=F.col("mime"), magic=F.col("magic"))
    return found.select("doc_id", F.coalesce("format_id", F.lit("")).alias("format_id"), "category", "handler_id")


def _rules_sql() -> str:
    rows = [(r["format_id"], r["category"], r["handler_id"], [f".{e}" for e in r["extensions"]], [m.lower() for m in r.get("mime_types", [])], [m.lower().replace(" ", "") for m in r.get("magic_prefixes", [])], r["priority"], 0) for r in CUSTOM if r.get("enabled", True)]
    rows += [(*row, 100, 1) for row in rules.BUILTIN if row[0] != "builtin.text.plain"]
    shown = lambda v: f"[{', '.join(repr(x) for x in v)}]::VARCHAR[]" if isinstance(v, list | tuple) else repr(v)
    return "(VALUES " + ", ".join(f"({', '.join(map(shown, row))}, {i})" for i, row in enumerate(rows)) + ") AS r(format_id, category, handler_id, exts, mimes, magics, priority, builtin, ordinal)"


#: Tables of the info query: columns with what they are called where nothing is null.
INFOS = {
    "part": [("p_partkey", "int64"), ("p_name", "object"), ("p_brand", "object"), ("p_type", "object"), ("p_size", "int64"), ("p_retailprice", "float64")],
    "labels": [("doc_id", "int64"), ("quality", "int64"), ("toxic", "int64")],
    "events": [("event_id", "int64"), ("ts", "datetime64[ns]"), ("user_id", "int64"), ("event_type", "object"), ("value", "float64"), ("props", "object")],
}


def info_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, of which some columns have nulls, as a data frame's info prints them."""
    frames = []
    for name, columns in INFOS.items():
        first, second = columns[0][0], columns[1][0]
        own = table(spark, sf_dir, name).select(*[F.when(F.col(first) % 3 > 0, F.col(c)).alias(c) if c == second else F.col(c) for c, _ in columns])
        frames.append(D.info_text(own).select(F.lit(name).alias("name"), "info"))
    return reduce(DataFrame.unionByName, frames)


def _info_sql(name: str, columns: list[tuple[str, str]]) -> str:
    first, second = columns[0][0], columns[1][0]
    kinds = [(c, "float64" if c == second and t == "int64" else t) for c, t in columns]
    count = lambda c: f"count(CASE WHEN {first} % 3 > 0 THEN {c} END)" if c == second else f"count({c})"
    wide, deep = max(6, *(len(c) for c, _ in kinds)), max(5, *(len(t) for _, t in kinds))
    rows = " || ".join(f"' {i}   {c.ljust(wide)}  ' || rpad({count(c)} || ' non-null', 14, ' ') || '  {t.ljust(deep)}' || {_NL}" for i, (c, t) in enumerate(kinds))
    tally = ", ".join(f"{k}({sum(t == k for _, t in kinds)})" for k in sorted({t for _, t in kinds}))
    head = f"' #   {'Column'.ljust(wide)}  Non-Null Count  {'Dtype'.ljust(deep)}' || {_NL} || '---  {'------'.ljust(wide)}  --------------  {'-----'.ljust(deep)}'"
    return f"""SELECT '{name}' AS name, '<class ''pandas.core.frame.DataFrame''>' || {_NL} || 'RangeIndex: ' || count(*) || ' entries, 0 to ' || (count(*) - 1) || {_NL} || 'Data columns (total {len(kinds)} columns):' || {_NL} ||
        {head} || {_NL} || {rows} || 'dtypes: {tally}' AS info FROM {name}"""


QUERIES = {f.__name__: f for f in (
    info_texts, unfenced_texts, memory_sections, flattened_messages, asset_locations, session_folders, plan_documents, resolved_contents,
)}
ORACLES = {
    "info_texts": " UNION ALL ".join(_info_sql(*x) for x in INFOS.items()),
    "unfenced_texts": f"""WITH c AS ({_CODE}), u AS (SELECT doc_id, {_TRIM.format("regexp_replace(regexp_replace(regexp_replace(coalesce(code, ''), '(?m)^```python[ ' || chr(9) || '-' || chr(13) || ']*', '', 'g'), '(?m)^```[ ' || chr(9) || '-' || chr(13) || ']*', '', 'g'), '[ ' || chr(9) || '-' || chr(13) || ']*```' || chr(10) || '?$', '', 'g')")} AS code FROM c)
        SELECT doc_id, length(code)::INTEGER AS n, sha256(code) AS code_sha256 FROM u""",
    "memory_sections": f"""WITH m AS ({_MEMORY}), l AS (SELECT doc_id, unnest(string_split(memory, {_NL})) AS line, generate_subscripts(string_split(memory, {_NL}), 1) AS i FROM m),
        s AS (SELECT doc_id, max(i) AS last, min(i) FILTER (WHERE regexp_matches(line, '^##\\s*4\\.')) AS start FROM l GROUP BY doc_id),
        e AS (SELECT l.doc_id, min(i) AS stop FROM l JOIN s USING (doc_id) WHERE i > start AND regexp_matches(line, '^##\\s*\\d+\\.(\\s|$)') GROUP BY l.doc_id),
        k AS (SELECT s.doc_id, start, coalesce(string_agg(line, {_NL} ORDER BY i) FILTER (WHERE start IS NULL OR i < start OR i >= stop), '') AS memory FROM s JOIN l USING (doc_id) LEFT JOIN e ON e.doc_id = s.doc_id GROUP BY ALL),
        t AS (SELECT doc_id, CASE WHEN start IS NULL THEN memory ELSE {_TRIM.format("memory")} END AS memory FROM k)
        SELECT doc_id, length(memory)::INTEGER AS n, sha256(memory) AS memory_sha256 FROM t""",
    "flattened_messages": """WITH t AS (SELECT *, regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]', '', 'g') AS t FROM documents),
        c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"' || t || '"' WHEN 1 THEN '[{"type": "text", "text": "' || t || '"}, "' || lang || '"]' WHEN 2 THEN '["' || source || '", {"text": "' || t || '"}, {"text": "end"}]' ELSE 'said ' || t END AS c FROM t),
        f AS (SELECT doc_id, CASE WHEN NOT json_valid(c) THEN c WHEN json_type(c) = 'ARRAY' THEN array_to_string(list_transform(json_extract(c, '$[*]'), lambda x: coalesce(json_extract_string(x, '$.text'), json_extract_string(x, '$'))), '') ELSE json_extract_string(c, '$') END AS said FROM c)
        SELECT doc_id, length(said)::INTEGER AS n, sha256(said) AS said_sha256 FROM f""",
    "asset_locations": f"""SELECT doc_id, CASE WHEN starts_with(path, project_root || '/') THEN substr(path, length(project_root) + 2) ELSE 'legacy/' || session || '/' || substr(path, length(session_root) + 2) END AS path FROM ({_PLACES})""",
    "session_folders": """WITH p AS (SELECT page_id, coalesce(string_split(url, '/')[3], 'u') AS u FROM pages)
        SELECT page_id, u || CASE WHEN page_id % 3 > 0 THEN '/p' || page_id % 7 || '/sessions/s-' ELSE '/s-' END || page_id AS folder, 's-' || page_id AS session_id FROM p""",
    "plan_documents": f"""WITH p AS (SELECT doc_id, {_TRIM.format("coalesce(analysis, '')")} AS a, {_TRIM.format("coalesce(steps, '')")} AS s, {_TRIM.format("coalesce(given, '')")} AS g FROM ({_PARTS}))
        SELECT doc_id, sha256(CASE WHEN g <> '' THEN g WHEN a = '' AND s = '' THEN '' ELSE '{G.HEADINGS[0]}' || {_NL} || {_NL} || a || {_NL} || {_NL} || '{G.HEADINGS[1]}' || {_NL} || {_NL} || s END) AS plan_sha256, a <> '' AND s <> '' AS valid FROM p""",
    "resolved_contents": f"""WITH f AS (SELECT doc_id, lower(regexp_extract(path, '\\.[^./]*$')) AS ext, lower(trim(string_split(mime, ';')[1])) AS mime, magic FROM ({_FILES})),
        c AS (SELECT f.doc_id, r.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY r.builtin, r.priority DESC, r.ordinal) AS k FROM f JOIN {_rules_sql()} ON ext <> '' AND list_contains(exts, ext) OR mime <> '' AND list_contains(mimes, mime) OR len(list_filter(magics, lambda m: starts_with(magic, m))) > 0)
        SELECT f.doc_id, coalesce(format_id, '') AS format_id, coalesce(category, 'binary') AS category, coalesce(handler_id, 'binary') AS handler_id FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND k = 1""",
}
