"""Queries over files: documents and pages stand for a workspace's inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import text as T
from ..operators import catalog, names, rules
from ..sources import workspace
from .common import table

#: Extensions that the inventory deals out by id, with some that no rule knows.
EXTENSIONS = [".csv", ".TXT", ".json", ".pdf", ".bin", ".xlsx", ".png", ".dcm", "", ".docx", ".tsv"]
_PATHS = "concat(source, '/', CAST(doc_id AS VARCHAR), list_extract([{}], CAST(doc_id % {} AS INTEGER) + 1))".format(", ".join(f"'{e}'" for e in EXTENSIONS), len(EXTENSIONS))
_RULES = "(VALUES " + ", ".join(f"('{e}', '{r[0]}', '{r[1]}', '{r[2]}')" for r in rules.BUILTIN for e in r[3]) + ") AS rules(ext, format_id, category, handler_id)"
_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_RESOLVED = f"""resolved AS (
    SELECT doc_id, path, n_chars, coalesce(format_id, '') AS format_id, coalesce(category, 'binary') AS category, coalesce(handler_id, 'binary') AS handler_id, {_EXT} AS ext
    FROM (SELECT doc_id, n_chars, {_PATHS} AS path FROM documents) LEFT JOIN {_RULES} ON rules.ext = {_EXT}
)"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    return docs.select("doc_id", "n_chars", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resolve(inventory(spark, sf_dir), rules.rules(spark))


def asset_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _resolved(spark, sf_dir).groupBy("category", "handler_id").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("total_chars"))
    return r.orderBy("category", "handler_id")


def format_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc_id", "path", F.coalesce("format_id", F.lit("")).alias("format_id"), "category", "handler_id")


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rollup_text(rules.category_counts(_resolved(spark, sf_dir)))


def upload_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.allowed(_resolved(spark, sf_dir)).groupBy("ext").agg(F.count("*").alias("n_files"))


def supported_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extensions a reader supports, with how many files of the inventory have them."""
    files = inventory(spark, sf_dir).groupBy(N.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n_files"))
    return rules.supported_extensions(rules.rules(spark)).join(files, "extension", "left").fillna(0, "n_files")


def legacy_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _resolved(spark, sf_dir).where("category = 'table'")
    hint = F.when(F.col("ext") == ".csv", "csv").otherwise("excel")
    return own.select("doc_id", "path", hint.alias("hint"))


def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.when(F.col("doc_id") % 3 == 0, F.lit("text/declared")).when(F.col("doc_id") % 3 == 1, F.lit(""))
    return inventory(spark, sf_dir).select("doc_id", N.guess_mime(F.col("path"), declared, F.array().cast("array<string>")).alias("mime"))


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    preview, lines, cut = workspace.text_digest(F.col("text"))
    return docs.select("doc_id", preview, lines, cut, T.shorten(F.col("text"), 400, "...").alias("excerpt"))


def json_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, keys, count, _, _ = workspace.json_summary(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", "props").select("event_id", kind, F.array_join(keys, ",").alias("json_keys"), count.cast("long"))


def header_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cells = part.select((F.col("p_partkey") % 10).alias("table_id"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_brand")).alias("cell"))
    return catalog.dedupe_names(cells, "cell", "table_id", "p_partkey").select("table_id", F.col("p_partkey").alias("position"), "column_name")


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rows.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").limit(5)


def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", N.base_name(F.col("url")).alias("base"), N.safe_name(F.col("url")).alias("safe"))


def unique_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of uploads to one folder in order of arrival, nothing there yet."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("d").alias("directory"), F.col("p_partkey").alias("ord"), F.concat(F.regexp_replace("p_brand", "#", ""), F.lit(".csv")).alias("name"))
    return names.allocate(part, part.select("directory", "name").limit(0)).select("p_partkey", "stored")


def path_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    path = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("/", F.col("o_custkey").cast("string"), F.lit("p1"), F.lit("sessions"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")), F.lit("raw"), F.lit("a.csv")))
    path = path.otherwise(F.concat_ws("/", F.col("o_custkey").cast("string"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")), F.lit("a.csv")))
    return o.select("o_orderkey", path.alias("path")).select("o_orderkey", N.session_of(F.col("path")).alias("session_id"))


def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.when(F.col("o_orderkey") % 3 == 0, "../").when(F.col("o_orderkey") % 3 == 1, "a/../b/").otherwise("raw/../../")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(up, F.col("o_orderkey").cast("string")).alias("path"))
    return o.select("o_orderkey", N.is_safe_relative(F.col("path")).alias("is_safe"))


def file_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 13 == 0, "main.py").when(F.col("doc_id") % 17 == 0, "Data_dump").otherwise(N.last_part(F.col("path")))
    return inventory(spark, sf_dir).select(N.bucket_of(name, rules.extensions_by_category()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_files"))


def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _resolved(spark, sf_dir)
    return files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("project")).agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_bytes"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


#: Extensions of session outputs that a project keeps.
PROMOTED = [".md", ".xlsx", ".xls", ".csv", ".tsv", ".json", ".html", ".htm", ".png", ".jpg", ".jpeg"]


def promotable_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _resolved(spark, sf_dir).where(F.col("ext").isin(PROMOTED))
    return own.select("doc_id", F.concat(F.lit("outputs/"), F.col("path")).alias("asset_path"), "category")


def content_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("relative_path"), F.when(F.col("page_id") % 2 == 0, F.to_binary(F.col("html"), F.lit("utf-8"))).otherwise(F.unhex(F.lit("ff00fe"))).alias("content"))
    return workspace.payload(raw).select("relative_path", "encoding", F.length("content").cast("long").alias("n_chars"))


def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.tree(inventory(spark, sf_dir).select(F.col("path").alias("relative_path"), F.col("n_chars").alias("size_bytes")))


QUERIES = {f.__name__: f for f in (
    asset_rollup, format_resolution, category_rollup, upload_allowlist, supported_extensions, legacy_tables, mime_guess, text_preview, json_summary, header_dedupe, sample_rows,
    safe_filename, unique_name, path_session_id, safe_paths, file_buckets, archive_manifest, promotable_outputs, content_payload, directory_tree,
)}
_MIME = "(VALUES " + ", ".join(f"('{e}', '{m}')" for e, m in N.MIME_BY_EXTENSION.items()) + ") AS known(ext, mime)"
_BUCKETS = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in es)}) THEN '{c}'" for c, es in rules.extensions_by_category().items())
ORACLES = {
    "asset_rollup": f"WITH {_RESOLVED} SELECT category, handler_id, count(*) AS n_files, sum(n_chars)::BIGINT AS total_chars FROM resolved GROUP BY ALL",
    "format_resolution": f"WITH {_RESOLVED} SELECT doc_id, path, format_id, category, handler_id FROM resolved",
    "category_rollup": f"WITH {_RESOLVED}, n AS (SELECT category, count(*) AS k, list_position(['table','image','text','document','imaging','binary'], category) AS place FROM resolved GROUP BY category) SELECT string_agg(category || '=' || k, ', ' ORDER BY place) AS summary FROM n",
    "upload_allowlist": f"WITH {_RESOLVED} SELECT ext, count(*) AS n_files FROM resolved WHERE category <> 'binary' GROUP BY ext",
    "supported_extensions": f"SELECT extension, count(path) AS n_files FROM (SELECT DISTINCT ext AS extension FROM {_RULES}) LEFT JOIN (SELECT path, {_EXT} AS e FROM (SELECT {_PATHS} AS path FROM documents)) ON e = extension GROUP BY extension",
    "legacy_tables": f"WITH {_RESOLVED} SELECT doc_id, path, CASE WHEN ext = '.csv' THEN 'csv' ELSE 'excel' END AS hint FROM resolved WHERE category = 'table'",
    "mime_guess": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'text/declared' ELSE coalesce(known.mime, 'application/octet-stream') END AS mime FROM (SELECT doc_id, {_PATHS} AS path FROM documents) LEFT JOIN {_MIME} ON known.ext = {_EXT}",
    "text_preview": """SELECT doc_id, substr(text, 1, 4000) AS preview,
        (CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END)::BIGINT AS line_count,
        length(text) >= 4000 AS preview_truncated,
        CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 400 THEN substr(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1, 380) || '...' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS excerpt FROM documents WHERE text IS NOT NULL""",
    "json_summary": "SELECT event_id, 'dict' AS json_type, array_to_string(json_keys(props), ',') AS json_keys, len(json_keys(props))::BIGINT AS json_key_count FROM events",
    "header_dedupe": """WITH c AS (SELECT p_partkey % 10 AS table_id, p_partkey AS position, CASE WHEN p_partkey % 7 = 0 THEN 'Unnamed: ' || p_partkey ELSE p_brand END AS name FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY position) - 1 AS k FROM c)
        SELECT table_id, position, CASE WHEN k = 0 THEN name ELSE name || '_' || k END AS column_name FROM n""",
    "sample_rows": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem ORDER BY 1, 2, 3, 4 LIMIT 5",
    "safe_filename": r"""WITH b AS (SELECT page_id, CASE WHEN trim(regexp_extract(url, '([^/]*)$', 1)) = '' THEN 'file' ELSE trim(regexp_extract(url, '([^/]*)$', 1)) END AS base FROM pages),
        e AS (SELECT *, regexp_extract(base, '^\.*[^.].*?(\.[^.]*)$', 1) AS raw FROM b),
        s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(left(base, length(base) - length(raw)), '[^\w.\- ()]+', '_', 'g'), '_{2,}', '_', 'g'), ' {2,}', ' ', 'g'), ' ._') AS stem,
              trim(regexp_replace(ltrim(raw, '.'), '[^\w.\- ()]+', '', 'g'), '._') AS tail FROM e)
        SELECT page_id, base, substr(CASE WHEN stem = '' THEN 'file' ELSE stem END || CASE WHEN tail = '' THEN '' ELSE '.' || tail END, 1, 200) AS safe FROM s""",
    "unique_name": """WITH n AS (SELECT p_partkey, replace(p_brand, '#', '') AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part)
        SELECT p_partkey, stem || CASE WHEN k = 0 THEN '' ELSE ' (' || k || ')' END || '.csv' AS stored FROM n""",
    "path_session_id": "SELECT o_orderkey, 's' || o_orderkey AS session_id FROM orders",
    "safe_paths": "SELECT o_orderkey, o_orderkey % 3 = 1 AS is_safe FROM orders",
    "file_buckets": f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'main.py' WHEN doc_id % 17 = 0 THEN 'Data_dump' ELSE regexp_extract({_PATHS}, '([^/]*)$', 1) END AS path FROM documents),
        e AS (SELECT path, {_EXT} AS ext FROM f)
        SELECT CASE {_BUCKETS} WHEN ext = '.py' THEN 'code' WHEN lower(path) LIKE 'data%' THEN 'table' ELSE 'other' END AS bucket, count(*) AS n_files FROM e GROUP BY 1""",
    "archive_manifest": f"WITH {_RESOLVED} SELECT split_part(path, '/', 1) AS project, count(*) AS n_files, sum(n_chars)::BIGINT AS n_bytes, min(path) AS first_path, max(path) AS last_path FROM resolved GROUP BY 1",
    "promotable_outputs": f"WITH {_RESOLVED} SELECT doc_id, 'outputs/' || path AS asset_path, category FROM resolved WHERE ext IN ({', '.join(repr(e) for e in PROMOTED)})",
    "content_payload": "SELECT CAST(page_id AS VARCHAR) AS relative_path, CASE WHEN page_id % 2 = 0 THEN 'utf-8' ELSE 'base64' END AS encoding, (CASE WHEN page_id % 2 = 0 THEN length(html) ELSE 4 END)::BIGINT AS n_chars FROM pages",
    "directory_tree": f"""WITH f AS (SELECT {_PATHS} AS path, n_chars FROM documents)
        SELECT path, split_part(path, '/', 1) AS parent, 2::INTEGER AS depth, 'file' AS kind, n_chars AS size_bytes FROM f
        UNION SELECT DISTINCT split_part(path, '/', 1), '', 1::INTEGER, 'directory', NULL FROM f""",
}
