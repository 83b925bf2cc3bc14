"""Routing decisions as an ordered chain of rewrites: each rule sees what the one before made of the route.

Rows have route (the decision), and the state: plan, code, ran, failed, data,
done, force (booleans), last (stage), invocations, replans, corrections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import extension, last_part
from ..functions.text import allowed_command

#: Bounds of the loop.
MOST_INVOCATIONS, MOST_CORRECTIONS, MOST_REPLANS = 24, 5, 4

_STATE = ("plan", "code", "ran", "failed", "data", "done", "force")


def _rules() -> list[tuple[str, Column]]:
    """(rule, new route or null) in order, over the columns of the state."""
    r, plan, code, ran, failed, data, done, force = (F.col(c) for c in ("route", *_STATE))
    next_step = F.when(~code, "coder").when(~ran, "worker").otherwise("reporter")
    return [
        ("forced", F.when(force & ~r.isin("reporter", "finish"), "reporter")),
        ("early_finish", F.when((r == "finish") & ~done, F.when(~plan, "planner").when(code & ran | ~data, "reporter").otherwise(next_step))),
        ("needs_plan", F.when(~plan & r.isin("coder", "worker", "reporter"), "planner")),
        ("needs_code", F.when(plan & (r == "worker") & ~code & data, "coder")),
        ("needs_run", F.when(plan & (r == "reporter") & ~ran & data, F.when(code, "worker").otherwise("coder"))),
        ("finished", F.when(done & (r != "finish"), "finish")),
        ("too_many_steps", F.when((F.col("invocations") >= MOST_INVOCATIONS) & ~done & plan & code & ~r.isin("reporter", "finish"), "reporter")),
        ("too_many_plans", F.when((r == "planner") & (F.col("replans") >= MOST_REPLANS) & plan, F.when(~data, "reporter").otherwise(next_step))),
        ("code_again", F.when(plan & code & (F.col("last") == "coder") & (r == "coder") & data, "worker")),
        ("too_many_fixes", F.when(plan & code & (F.col("corrections") >= MOST_CORRECTIONS) & ran & failed & (r == "coder") & data, "worker")),
        ("no_data", F.when(plan & ~data & ~done & r.isin("coder", "worker"), "reporter")),
    ]


def clamp(states: DataFrame) -> DataFrame:
    """``states`` with the final route and ``rule``, the last rule that changed it (null: none did)."""
    out = states.withColumn("rule", F.lit(None).cast("string"))
    for name, route in _rules():
        out = out.withColumn("new_", route).withColumns({"route": F.coalesce("new_", "route"), "rule": F.when(F.col("new_").isNotNull(), name).otherwise(F.col("rule"))}).drop("new_")
    return out


def should_correct(failed: Column, ran: Column, code: Column, corrections: Column) -> Column:
    return ran & failed & code & (corrections < MOST_CORRECTIONS)


def should_keep_code(failed: Column, ran: Column, code: Column, corrections: Column) -> Column:
    return ran & failed & code & (corrections >= MOST_CORRECTIONS)


#: What counts as data to analyse, and names that never do.
DATA_TYPES = ("table", "image", "text", "document", "imaging")
DATA_EXTENSIONS = (
    ".xlsx", ".xls", ".csv", ".tsv", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".txt", ".md", ".json", ".yaml", ".yml", ".xml", ".html", ".htm", ".log", ".pdf", ".docx", ".dcm", ".dicom",
)
NO_DATA_NAMES = ("SESSION_MEMORY.md", "main.py")


def analyzable(workspaces: DataFrame, digests: DataFrame, listed: DataFrame, key: str = "session_id") -> DataFrame:
    """``workspaces`` with ``data``: whether a digest says so by type or extension, or a listed name by its extension.

    digests: key, file_type, relative_path; listed: key, name. One aggregated flag a workspace; no list is gathered.
    """
    typed = F.lower(F.trim(F.coalesce("file_type", F.lit("")))).isin(*DATA_TYPES)
    by_digest = digests.select(key, (typed | extension(F.coalesce("relative_path", F.lit(""))).isin(*DATA_EXTENSIONS)).alias("data"))
    base = last_part(F.col("name"))
    by_name = listed.select(key, (~base.isin(*NO_DATA_NAMES) & extension(F.col("name")).isin(*DATA_EXTENSIONS)).alias("data"))
    found = by_digest.unionByName(by_name).groupBy(key).agg(F.bool_or("data").alias("data"))
    return workspaces.join(found, key, "left").withColumn("data", F.coalesce("data", F.lit(False)))


def code_written(workspaces: DataFrame, writes: DataFrame, key: str = "session_id") -> DataFrame:
    """``workspaces`` with ``code``: whether any write of code succeeded; none means no."""
    found = writes.groupBy(key).agg(F.bool_or(F.coalesce("success", F.lit(False))).alias("code"))
    return workspaces.join(found, key, "left").withColumn("code", F.coalesce("code", F.lit(False)))


#: What a hint says, in order.
ROLES = {
    "en": "Role split: Coder stdout = verifiable stats/facts only; Reporter writes narrative conclusions and recommendations from logs—avoid duplication.",
    "zh": "职责边界：Coder 脚本只应输出统计/事实类结果（stdout）；叙述性结论与建议由 Reporter 根据日志撰写，二者勿重复。",
}
NO_DATA = {
    "en": "No analyzable data files: choose reporter (explain that user must upload tables/text/documents/imaging); do not choose coder/worker.",
    "zh": "工作区无可分析数据：应选择 reporter 说明需上传表格/文本/文档/影像等；勿选择 coder/worker。",
}
CODE_DONE = "代码已写入/修正：应选择 worker 重新执行（勿再次进入 coder）。"
FIXES_SPENT = "Worker 未成功且已达 Coder 修正上限：应选择 worker 重跑或 reporter 收敛，勿再 generate 覆盖代码。"
FIX_CODE = "Worker 未成功：通常应选择 coder，并在 feedback_for_next 中粘贴 stderr/关键错误。"
NO_PLAN, PLANNED = "当前无有效规划：应选择 planner。", "规划刚完成：通常应选择 coder。"
RAN, REPORTED = "执行成功：通常应选择 reporter。", "报告已流式完成：必须选择 finish。"
NOTHING = "(无)"


def hint(english: Column) -> Column:
    """What the supervisor is told of a state (columns as in ``clamp``, ``failed`` only where it ran): fixed lines, then those that apply."""
    plan, code, ran, data, done = (F.col(c) for c in ("plan", "code", "ran", "data", "done"))
    last, wrong = F.trim(F.coalesce("last", F.lit(""))), F.col("ran") & F.col("failed")
    said = lambda c: F.when(c, "True").otherwise("False")
    success = F.when(ran, said(~F.col("failed"))).otherwise("None")
    lines = [
        F.concat(F.lit("last_completed_stage="), F.when(last == "", NOTHING).otherwise(last)),
        F.concat(F.lit("plan_ok="), said(plan), F.lit(" code_ok="), said(code), F.lit(" worker_ran="), said(ran), F.lit(" worker_success="), success),
        F.concat(F.lit("reporter_done="), said(done), F.lit(" correction_attempts="), F.coalesce("corrections", F.lit(0)).cast("string")),
        F.concat(F.lit("has_analyzable_data="), said(data)),
        F.when(english, ROLES["en"]).otherwise(ROLES["zh"]),
        F.when(~data & plan & ~done, F.when(english, NO_DATA["en"]).otherwise(NO_DATA["zh"])),
        F.when((last == "coder") & code & data, CODE_DONE).when(wrong, F.when(F.coalesce("corrections", F.lit(0)) >= MOST_CORRECTIONS, FIXES_SPENT).otherwise(FIX_CODE)),
        F.when(~plan, NO_PLAN).when((last == "planner") & data, PLANNED).when((last == "worker") & ran & ~F.col("failed"), RAN).when((last == "reporter") & done, REPORTED),
    ]
    return F.concat_ws("\n", *lines)


def runnable(commands: DataFrame, scripts: DataFrame, key: str = "session_id") -> DataFrame:
    """``commands`` (key, command) with ``verdict``: refused (not of the allowed form), missing (no such script there), or ok."""
    asked = commands.withColumn("script", allowed_command(F.col("command")))
    there = scripts.select(key, F.col("relative_path").alias("script")).distinct().withColumn("there_", F.lit(True))
    verdict = F.when(F.col("script").isNull(), "refused").when(F.col("there_").isNull(), "missing").otherwise("ok")
    return asked.join(there, [key, "script"], "left").withColumn("verdict", verdict).drop("there_")
