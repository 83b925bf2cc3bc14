"""Texts that an analysis keeps or passes on, of all sessions at once, and digests of files through the rules and handlers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digest, memory, rules
from ..operators import events as E
from ..operators import stats as S
from ..operators.ordered import spread
from .common import table
from .files import _EXT, _RESOLVED, _resolved

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_NL = "chr(10)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _short(text: str, most: int) -> str:
    t = f"trim(coalesce({text}, ''), {_BLANK})"
    return f"CASE WHEN length({t}) > {most} THEN substr({t}, 1, {most - 20}) || {_NL} || '…（已截断）' ELSE {t} END"


_DIGESTS = f"""WITH d AS (SELECT doc_id, lang, n_chars, text AS p FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, '## file_type' || {_NL} || {_NL} || lang || {_NL} || {_NL} || '## size' || {_NL} || {_NL} || '### n' || {_NL} || {_NL} || n_chars || {_NL} || {_NL} || '### tags' || {_NL} || {_NL} || '- ' || lang || {_NL} || '- x' || {_NL} || {_NL} || '## preview' || {_NL} || {_NL} ||
    CASE WHEN length(trim(p, {_BLANK})) > 240 OR contains(p, {_NL}) THEN '```' || {_NL} || rtrim(p, {_BLANK}) || {_NL} || '```' ELSE p END || {_NL} || {_NL} AS markdown FROM d"""


@query(_DIGESTS.replace("text AS p", "substr(text, 1, 260) AS p"))
def digest_headings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    made = F.to_json(F.struct(F.col("lang").alias("file_type"), F.struct(F.col("n_chars").alias("n"), F.array("lang", F.lit("x")).alias("tags")).alias("size"), F.substring("text", 1, 260).alias("preview")))
    return d.select("doc_id", memory.digest_markdown(made).alias("markdown"))


@query(_DIGESTS)
def whole_digest_headings(spark, sf_dir):
    """Digests whose preview is the whole text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    size = F.struct(F.col("n_chars").alias("n"), F.array("lang", F.lit("x")).alias("tags")).alias("size")
    return d.select("doc_id", memory.digest_markdown(F.to_json(F.struct(F.col("lang").alias("file_type"), size, F.col("text").alias("preview")))).alias("markdown"))


@query(f"""WITH e AS (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_id % 9 = 0 THEN '' ELSE 's' || user_id END AS who, CASE event_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'phase_start' WHEN 2 THEN 'milestone' ELSE 'other' END AS kind,
    CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN props || {_NL} || event_type || {_NL} ELSE props || ' ' END AS c FROM events)
    SELECT event_id, {_NL} || repeat('=', 80) || {_NL} || '### ' || stamp || ' · 会话 `' || CASE WHEN who = '' THEN 'unknown' ELSE who END || '`' || {_NL} || {_NL} || '- **类型：** ' || CASE kind WHEN 'llm' THEN 'LLM 交互' WHEN 'phase_start' THEN '阶段开始' WHEN 'milestone' THEN '里程碑' ELSE kind END || {_NL} ||
    '- **标识：** `' || event_type || '`' || {_NL} || {_NL} || '---' || {_NL} || {_NL} || CASE WHEN kind = 'llm' THEN '#### 正文' ELSE '#### 详情' END || {_NL} || {_NL} ||
    CASE WHEN c IS NULL THEN '（无）' WHEN trim(c, {_BLANK}) = '' THEN '（空）' WHEN contains(c, {_NL}) THEN '```' || {_NL} || rtrim(c, {_BLANK}) || {_NL} || '```' ELSE rtrim(c, {_BLANK}) END || {_NL} AS entry FROM e""")
def log_entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    content = F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 5 == 0, "  ").when(n % 3 == 0, F.concat("props", F.lit("\n"), "event_type", F.lit("\n"))).otherwise(F.concat("props", F.lit(" ")))
    kind = F.when(n % 4 == 0, "llm").when(n % 4 == 1, "phase_start").when(n % 4 == 2, "milestone").otherwise("other")
    who = F.when(n % 9 == 0, "").otherwise(F.concat(F.lit("s"), F.col("user_id").cast("string")))
    return e.select("event_id", memory.log_entry(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), who, F.col("event_type"), kind, content).alias("entry"))


#: Rows of which a task writes the sections.
SECTIONS = 10_000
_OUT = "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE repeat(p_name, p_size * 6) END"
_ERR = "CASE WHEN p_size % 4 = 0 THEN repeat(p_type || ' ', p_size * 8) END"
_FILE = lambda out, err: f"'- 文件 `' || p_brand || '.py`: success=' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || ', returncode=' || (p_size % 2) || CASE WHEN {_short(out, 2500)} <> '' THEN {_NL} || '  - stdout 摘录:' || {_NL} || '```' || {_NL} || {_short(out, 2500)} || {_NL} || '```' ELSE '' END || CASE WHEN {_short(err, 2500)} <> '' THEN {_NL} || '  - stderr 摘录:' || {_NL} || '```' || {_NL} || {_short(err, 2500)} || {_NL} || '```' ELSE '' END"  # noqa: E731, E501


@query(f"""WITH r AS (SELECT p_partkey, p_size, '- 整体成功: ' || CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END || CASE WHEN p_size % 5 <> 0 THEN {_NL} || '- 汇总错误: ' || {_short("repeat(p_brand, 300)", 2000)} ELSE '' END || {_NL} || {_FILE(_OUT, _ERR)} || {_NL} || {_FILE(_ERR, _OUT)} || CASE WHEN p_size % 6 <> 0 THEN {_NL} || '- 聚合日志摘录:' || {_NL} || '```' || {_NL} || {_short("repeat(p_name, 400)", 4000)} || {_NL} || '```' ELSE '' END AS t FROM part)
    SELECT p_partkey, sha256(CASE WHEN p_size % 10 = 0 THEN '（尚未执行 Worker）' ELSE {_short("t", 10000)} END) AS section FROM r""")
def worker_sections(spark, sf_dir):
    """Results of two scripts a row, texts over and under every bound."""
    even = F.col("p_size") % 2 == 0
    of = lambda out, err: F.struct(F.concat("p_brand", F.lit(".py")).alias("path"), even.alias("success"), (F.col("p_size") % 2).alias("returncode"), F.expr(out).alias("stdout"), F.expr(err).alias("stderr"))
    section = memory.worker_section(F.when(F.col("p_size") % 10 != 0, even), F.array(F.lit(None).cast("string"), F.when(F.col("p_size") % 5 != 0, F.repeat("p_brand", F.lit(300))).otherwise("")), F.array(of(_OUT, _ERR), of(_ERR, _OUT)), F.when(F.col("p_size") % 6 != 0, F.repeat("p_name", F.lit(400))).otherwise(" "))
    return spread(table(spark, sf_dir, "part"), SECTIONS).select("p_partkey", F.sha2(section, 256).alias("section"))


@query(f"""SELECT doc_id, '{memory.CONTEXT['en'][0]}' || {_NL} || '{memory.CONTEXT['en'][1]}' || {_NL} || '["raw/' || doc_id || '.csv", "' || source || '"]' || CASE WHEN doc_id % 3 = 0 THEN {_NL} || '{memory.CONTEXT['en'][2]}' || lang ELSE '' END ||
    CASE WHEN coalesce(text, '') <> '' THEN {_NL} || '{memory.CONTEXT['en'][3]}' || {_NL} || CASE WHEN length(text) > 12000 THEN substr(text, 1, 11980) || {_NL} || '...(truncated)' ELSE text END ELSE '' END AS context FROM documents""")
def coder_contexts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    files = F.array(F.concat(F.lit("raw/"), F.col("doc_id").cast("string"), F.lit(".csv")), F.lit("x/SESSION_MEMORY.md"), F.col("source"))
    return d.select("doc_id", memory.coder_context(files, F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.col("text"), "en").alias("context"))


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(text, ''), {_BLANK}) <> '' THEN trim(text, {_BLANK}) WHEN doc_id % 2 = 0 THEN lang ELSE 'No files uploaded' END AS info FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text FROM documents)")
def file_infos(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", memory.file_info(text, F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("info"))


@query("SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'end' ELSE 'supervisor' END AS next FROM events")
def planner_branches(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", memory.planner_branch(error).alias("next"))


_PART = (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double"))


@query(f"SELECT 'rows: ' || count(*) || ', columns: 6' || " + " || ".join(f"{_NL} || ' {i}  ' || rpad('{c}', 13, ' ') || '  ' || count({c}) || ' non-null  {t}'" for i, (c, t) in enumerate(_PART)) + " AS info FROM part")
def table_infos(spark, sf_dir):
    """A table's profile as text: rows, columns, non-null values and types."""
    profile = S.profile(table(spark, sf_dir, "part"))
    columns = F.transform(F.array_sort(F.collect_list(F.struct("position", F.col("column_name").alias("name"), "non_null", "type"))), lambda c: F.struct(c["name"].alias("name"), c["non_null"].alias("non_null"), c["type"].alias("type")))
    return profile.agg(F.max("n_rows").alias("rows"), columns.alias("columns")).select(memory.table_info(F.col("rows"), F.col("columns")).alias("info"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name WHEN 2 THEN 'one Table' END AS s, c_nationkey % 3 AS n FROM customer), b AS (SELECT *, CASE WHEN coalesce(s, '') <> '' THEN s WHEN n > 0 THEN '共 ' || n || ' 个表格文件' ELSE '未发现表格文件' END AS base FROM s)
    SELECT c_custkey, CASE WHEN n > 0 AND NOT contains(base, '表格') AND NOT contains(lower(base), 'table') THEN base || '（其中 ' || n || ' 个为表格）' ELSE base END AS summary FROM b""")
def legacy_summaries(spark, sf_dir):
    summary = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, "one Table")
    return table(spark, sf_dir, "customer").select("c_custkey", memory.legacy_summary(summary, F.col("c_nationkey") % 3).alias("summary"))


@query(f"""WITH {_RESOLVED}, f AS (SELECT split_part(path, '/', 1) AS project, list(CASE WHEN doc_id % 2 = 0 THEN 'raw/' ELSE 'outputs/' END || doc_id || ext ORDER BY CASE WHEN doc_id % 2 = 0 THEN 'raw/' ELSE 'outputs/' END || doc_id || ext) AS files FROM resolved WHERE doc_id % 5 <> 0 GROUP BY 1)
    SELECT project, sha256(CAST(json_object('project_id', project, 'archived_at', '2024-01-03T00:00:00', 'files', files) AS VARCHAR)) AS manifest FROM f""")
def archive_manifests(spark, sf_dir):
    """The manifest of each project's archive: files of its two folders, in order."""
    files = _resolved(spark, sf_dir).where("doc_id % 5 <> 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), F.concat(F.when(F.col("doc_id") % 2 == 0, "raw/").otherwise("outputs/"), F.col("doc_id").cast("string"), "ext").alias("path"))
    return files.groupBy("project").agg(F.array_sort(F.collect_list("path")).alias("files")).select("project", F.sha2(F.to_json(F.struct(F.col("project").alias("project_id"), F.lit("2024-01-03T00:00:00").alias("archived_at"), "files")), 256).alias("manifest"))


@query(f"WITH {_RESOLVED} SELECT path AS relative_path, category AS file_category, n_chars AS size_bytes, nullif(format_id, '') AS format_id, handler_id, category <> 'binary' AS deep_parse FROM resolved")
def catalog_entries(spark, sf_dir):
    return rules.catalog_entry(_resolved(spark, sf_dir).withColumn("size_bytes", F.col("n_chars")))


_LINES = f"(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, {_NL}, '')) + CASE WHEN ends_with(text, {_NL}) THEN 0 ELSE 1 END END)"


@query(f"""WITH {_RESOLVED} SELECT r.doc_id, r.handler_id, strlen(coalesce(d.text, ''))::BIGINT AS size_bytes, r.category AS file_type, nullif(r.format_id, '') AS format_id, CASE WHEN r.handler_id = 'text' THEN {_LINES} END::BIGINT AS line_count,
    CASE WHEN r.handler_id = 'text' THEN sha256(substr(coalesce(d.text, ''), 1, 4000)) END AS preview_sha256 FROM resolved r JOIN documents d USING (doc_id) WHERE r.ext NOT IN ('.csv', '.tsv', '.xlsx', '.pdf', '.dcm', '.docx')""")
def workspace_digest(spark, sf_dir):
    """Files through rules and handlers: the texts of documents as contents of files by the names of the inventory."""
    files = _resolved(spark, sf_dir).where("ext not in ('.csv', '.tsv', '.xlsx', '.pdf', '.dcm', '.docx')")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.to_binary(F.coalesce("text", F.lit("")), F.lit("utf-8")).alias("content"))
    read = files.join(texts, "doc_id").select("path", "handler_id", "content", "category", "format_id")
    made, at = digest.digests(read), lambda f: F.get_json_object("digest", f"$.{f}")
    number = F.regexp_extract("path", r"/([0-9]+)[^/]*$", 1).cast("long")
    return made.select(number.alias("doc_id"), "handler_id", "size_bytes", at("file_type").alias("file_type"), at("format_id").alias("format_id"), at("line_count").cast("long").alias("line_count"), F.when(F.col("handler_id") == "text", F.sha2(F.coalesce(at("preview"), F.lit("")), 256)).alias("preview_sha256"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN {_short('text', 3000)} ELSE '' END AS excerpt FROM documents")
def report_excerpts(spark, sf_dir):
    text = F.when(F.col("doc_id") % 4 != 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", E.report_excerpt(text).alias("excerpt"))


@query(f"""WITH {_RESOLVED} SELECT doc_id, path FROM resolved WHERE NOT EXISTS (SELECT 1 FROM resolved d WHERE d.path = resolved.path AND d.n_chars > 900)""")
def undigested_files(spark, sf_dir):
    files = _resolved(spark, sf_dir).select("doc_id", "path", "n_chars")
    return digest.undigested(files, files.where("n_chars > 900")).select("doc_id", "path")


_SAID = lambda t, none: f"coalesce(nullif(trim(coalesce({t}, ''), {_BLANK}), ''), '{none}')"
_MEMORY = {
    "at": "'2024-01-03 00:00:00'", "event": "lang", "status": "CASE WHEN doc_id % 2 = 0 THEN 'live' END", "session": "'s' || doc_id", "workspace": "CASE WHEN doc_id % 3 = 0 THEN '/ws/' || source END", "language": "lang", "title": "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END",
    "note": "'note ' || source", "input": "text", "digest": "CASE WHEN doc_id % 4 > 0 THEN text || text END", "analysis": "CASE WHEN doc_id % 3 > 0 THEN text END", "steps": "source", "summary": "CASE WHEN doc_id % 7 = 0 THEN text END", "mode": "CASE WHEN doc_id % 2 = 1 THEN 'fix' END",
    "report": "CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END", "issues": "CASE WHEN doc_id % 6 = 0 THEN ' none ' END", "worker": "'worker ' || lang", "fixes": "doc_id % 4",
}
_M = {k: f"({v})" for k, v in _MEMORY.items()}
_2 = f"{_NL} || {_NL}"


def _memory_sql() -> str:
    parts = [
        f"'# 会话记忆 (Session Memory)' || {_2} || '> 自动维护的压缩摘要，对应流水线状态与工作区现状；长文本已截断。  ' || {_NL} || '> 最后更新: ' || {_M['at']} || ' · 事件: ' || {_SAID(_M['event'], '—')} || ' · 流式状态: ' || {_SAID(_M['status'], '—')}",
        f"'## 1. 会话元数据' || {_2} || '| 字段 | 值 |' || {_NL} || '|------|-----|' || {_NL} || '| session_id | `' || {_M['session']} || '` |' || {_NL} || '| 工作区路径 | `' || {_SAID(_M['workspace'], '（未知）')} || '` |' || {_NL} || '| 语言 | ' || lang || ' |' || {_NL} || '| 会话标题 | ' || {_SAID(_M['title'], '（未设置）')} || ' |' || {_NL} || '| Supervisor 上限参考 | 24 次 |' || {_NL} || '| Coder 修正上限参考 | 5 次 |'",
        f"'## 2. 用户目标与输入' || {_2} || {_M['note']} || {_2} || '**当前轮用户输入摘要**' || {_2} || {_short(_M['input'], 4000)}",
        f"'## 3. 工作区清单' || {_2} || '**根目录文件（相对路径）:** ' || CASE WHEN doc_id % 2 = 0 THEN 'a.csv, main.py' ELSE '（空）' END || {_2} || '- **数据文件:** ' || CASE WHEN doc_id % 2 = 0 THEN 'a.csv' ELSE '—' END || {_NL} || '- **图片:** —' || {_NL} || '- **文本:** —' || {_NL} || '- **文档:** —' || {_NL} || '- **医学影像:** —' || {_NL} || '- **代码文件:** ' || CASE WHEN doc_id % 2 = 0 THEN 'main.py' ELSE '—' END || {_NL} || '- **其他:** —'",
        f"'## 4. 数据与 Schema 摘要' || {_2} || coalesce(nullif({_short(_M['digest'], 12000)}, ''), '（无）')",
        f"'## 5. 规划状态' || {_2} || '**需求解析**' || {_2} || coalesce(nullif({_short(_M['analysis'], 8000)}, ''), '（尚无）') || {_2} || '**步骤分解**' || {_2} || coalesce(nullif({_short(_M['steps'], 8000)}, ''), '（尚无）') || {_2} || '**规划摘要 (planner_summary)**' || {_2} || coalesce(nullif({_short(_M['summary'], 8000)}, ''), '（尚无）')",
        f"'## 6. 代码与修正' || {_2} || '- **目标入口:** main.py' || {_NL} || '- **最近一次模式:** ' || {_SAID(_M['mode'], '—')} || {_NL} || '- **修正次数:** ' || {_M['fixes']} || {_2} || CASE WHEN doc_id % 2 = 0 THEN '- `main.py` 写入成功=True ' || {_NL} || '- `x.py` 写入成功=False 错误: ' || lang ELSE '（尚无写入记录）' END",
        f"'## 7. 执行履历与错误账本' || {_2} || {_M['worker']}", f"'## 8. 编排决策摘要（最近至多 8 条）' || {_2} || '- 第 1 次 supervisor → **coder**；理由: ' || lang",
        f"'## 9. 报告与结论' || {_2} || '- **Reporter 状态:** ' || CASE WHEN doc_id % 3 = 0 THEN '已完成' ELSE '未完成' END || CASE WHEN {_short(_M['report'], 3000)} <> '' THEN '；摘录:' || {_NL} || '```' || {_NL} || {_short(_M['report'], 3000)} || {_NL} || '```' ELSE '' END",
        f"'## 10. 开放问题与假设' || {_2} || {_SAID(_M['issues'], '（无）')}",
        f"'## 11. 轻量时间线' || {_2} || '（详见服务器编排日志与 session_content；此处仅记录本轮压缩视图。）' || {_2} || '---' || {_NL} || '*文件路径（相对工作区根）: `SESSION_MEMORY.md`*' || {_NL}",
    ]
    joined = f" || {_2} || ".join(parts)
    return f"SELECT doc_id, sha256({joined}) AS document FROM documents"


@query(_memory_sql())
def memory_documents(spark, sf_dir):
    """The memory document of a session for each row, sections over and under their bounds."""
    d, even = table(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0
    none = F.array().cast("array<string>")
    write = lambda path, ok, error: F.struct(F.lit(path).alias("path"), F.lit(ok).alias("success"), error.alias("error"))
    columns = {k: F.expr(v) for k, v in _MEMORY.items()} | {
        "files": F.when(even, F.array(F.lit("a.csv"), F.lit("main.py"))).otherwise(none), "paths": none, "done": F.col("doc_id") % 3 == 0,
        "buckets": F.when(even, F.create_map(F.lit("table"), F.array(F.lit("a.csv")), F.lit("code"), F.array(F.lit("main.py")))).otherwise(F.create_map().cast("map<string,array<string>>")),
        "writes": F.when(even, F.array(write("main.py", True, F.lit("")), write("x.py", False, F.col("lang")))).otherwise(F.array().cast("array<struct<path:string,success:boolean,error:string>>")),
        "trace": F.array(F.struct(F.lit(1).alias("invoke"), F.lit("coder").alias("next"), F.col("lang").alias("reason"), F.lit("").alias("feedback"))),
    }
    return d.select("doc_id", F.sha2(memory.memory_document(columns), 256).alias("document"))
