"""Column functions over what passes between the stages of an analysis: plans, decisions, results, traces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _BLANKS, shorten, tail

#: Headings of a plan, and what a silent success reports.
HEADINGS = ("## 需求解析", "## 步骤分解")
SILENT = "代码执行未产生任何可见输出，请检查是否编写了入口逻辑（如 demo 测试代码或 main 函数）。"
NO_TRACE = "（尚无）"
#: The heading of a memory document's fourth section, and that of any numbered section.
_FOURTH, _NUMBERED = r"^##\s*4\.\s*[^\n]*\n", r"^##\s*\d+\.\s+"
#: The parts of a decision's line in a memory document, and of a cell and a line in a table dump.
DECIDED, DECIDED_NEXT, DECIDED_WHY, DECIDED_MORE = "- 第 ", " 次 supervisor → **", "**；理由: ", "\n  - 反馈摘录: "
CELL, NO_CELL, LINE, LINE_END = "列{}='", "空值", "行", "："
STAGES = ("planner", "coder", "worker", "reporter", "finish")


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))


def plan_text(analysis: Column, steps: Column) -> Column:
    """Both sections under their headings; empty where both are blank."""
    a, s = stripped(analysis), stripped(steps)
    made = F.concat(F.lit(f"{HEADINGS[0]}\n\n"), a, F.lit(f"\n\n{HEADINGS[1]}\n\n"), s)
    return F.when((a == "") & (s == ""), "").otherwise(made)


def final_plan(text: Column, analysis: Column, steps: Column) -> Column:
    """The plan's text, made anew from its sections where it is blank."""
    return F.when(stripped(text) == "", plan_text(analysis, steps)).otherwise(stripped(text))


def plan_is_valid(analysis: Column, steps: Column) -> Column:
    return (stripped(analysis) != "") & (stripped(steps) != "")


_DECISION = "next_stage string, feedback_for_next string, reason string"


def decision(content: Column) -> Column:
    """Struct (next_stage, feedback_for_next, reason) from a reply that holds a JSON object; null where it doesn't.

    A fenced block that holds an object goes first; else the text from the first brace to the last, or to the end
    where none closes. What does not parse is mended: commas before a brace go, then an open text and an open object
    are closed. Stages that are unknown and texts beyond their bounds make no decision.
    """
    text = stripped(content)
    blocks = F.transform(F.split(text, "```"), lambda b: F.regexp_replace(stripped(b), r"^(?i:json)\s*", ""))
    fenced = F.get(F.filter(blocks, lambda b: F.startswith(b, F.lit("{"))), 0)
    source = F.coalesce(F.when(F.contains(text, F.lit("```")), fenced), text)
    whole, open_ = F.regexp_extract(source, r"(?s)\{.*\}", 0), F.regexp_extract(source, r"(?s)\{.*", 0)
    found = F.when(whole != "", whole).otherwise(open_)
    tidy = F.regexp_replace(found, r",(\s*\})", "$1")
    # a lambda's variable is worked out once, however often its fields are asked for
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    parsed = lambda t: F.from_json(F.when(F.try_parse_json(t).isNotNull(), t), _DECISION)
    mended = once(tidy, lambda t: F.coalesce(parsed(t), parsed(F.concat(t, F.lit('"}'))), parsed(F.concat(t, F.lit("}")))))

    def checked(made: Column) -> Column:
        feedback, reason = F.coalesce(made["feedback_for_next"], F.lit("")), F.coalesce(made["reason"], F.lit(""))
        ok = made["next_stage"].isin(*STAGES) & (F.length(feedback) <= 8000) & (F.length(reason) <= 2000)
        return F.when(ok, F.struct(made["next_stage"].alias("next_stage"), feedback.alias("feedback_for_next"), reason.alias("reason")))

    return once(mended, checked)


def error_text(messages: Column, results: Column, most: int = 12_000) -> Column:
    """Messages, then the error output of failed scripts by path; results: array of (path, success, stderr)."""
    said = F.filter(messages, lambda m: m.isNotNull() & (m != ""))
    failed = F.filter(results, lambda r: ~F.coalesce(r["success"], F.lit(False)) & (F.coalesce(r["stderr"], F.lit("")) != ""))
    lines = F.transform(failed, lambda r: F.concat(F.coalesce(r["path"], F.lit("")), F.lit(": "), r["stderr"]))
    none = F.array().cast("array<string>")
    return F.substring(F.array_join(F.concat(F.coalesce(said, none), F.coalesce(lines, none)), "\n"), 1, most)


def with_silence(success: Column, logs: Column, errors: Column) -> Column:
    """Errors, with one more where a success printed nothing."""
    return F.when(success & (F.coalesce(logs, F.lit("")) == ""), F.array_append(errors, F.lit(SILENT))).otherwise(errors)


def trace_section(trace: Column, n: int = 8, most: int = 400) -> Column:
    """Lines for the last decisions; trace: array of (invoke, next, reason, feedback)."""
    def lines(t: Column) -> Column:
        head = F.concat(F.lit(DECIDED), t["invoke"].cast("string"), F.lit(DECIDED_NEXT), F.coalesce(t["next"], F.lit("")), F.lit(DECIDED_WHY), shorten(t["reason"], most))
        more = shorten(t["feedback"], most)
        return F.when(more == "", head).otherwise(F.concat(head, F.lit(DECIDED_MORE), more))

    return F.when(F.size(F.coalesce(trace, F.array().cast("array<struct<invoke:int,next:string,reason:string,feedback:string>>"))) < 1, NO_TRACE).otherwise(F.array_join(F.transform(tail(trace, n), lines), "\n"))


def without_digest(memory: Column) -> Column:
    """A memory document without its fourth section, up to the next numbered heading or the end."""
    text = F.coalesce(memory, F.lit(""))
    cut = F.regexp_replace(text, rf"(?ms)\A(.*?){_FOURTH}.*?(?:(?={_NUMBERED})|\z)(.*)\z", "$1$2")
    return F.when(F.regexp_like(text, F.lit(f"(?m){_FOURTH}")), stripped(cut)).otherwise(text)


def log_id(dialogue: Column) -> Column:
    """Letters, digits, hyphens and underscores of an id; ``unknown`` where nothing is left."""
    kept = F.regexp_replace(F.coalesce(dialogue, F.lit("")), r"[^\p{L}\p{N}_-]", "")
    return F.when(kept == "", "unknown").otherwise(kept)


def asset_path(path: Column, project_root: Column, session_root: Column, session: Column) -> Column:
    """Path below the project, or below ``legacy/<session>`` for files of sessions outside it."""
    below = lambda root: F.substring(path, F.length(root) + 2, F.length(path))
    inside = F.startswith(path, F.concat(project_root, F.lit("/")))
    return F.when(inside, below(project_root)).otherwise(F.concat(F.lit("legacy/"), session, F.lit("/"), below(session_root)))


def iso_time(ts: Column) -> Column:
    """ISO text of a timestamp; microseconds only where they are not zero."""
    micros = F.date_format(ts, "SSSSSS")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def flattened(content: Column) -> Column:
    """Text of a message given as a JSON string or a list of strings and {"text": ...} parts."""
    parts = F.from_json(content, "array<variant>")
    said = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), p.cast("string")))
    return F.coalesce(F.array_join(said, ""), F.try_variant_get(F.try_parse_json(content), "$", "string"), content)


def coordinates(cells: list[str], position: Column) -> Column:
    """One line of a table dump: each cell with its row and column number."""
    shown = [F.concat(F.lit(CELL.format(i)), F.coalesce(F.btrim(F.col(f"`{c}`").cast("string"), F.lit(_BLANKS)), F.lit(NO_CELL)), F.lit("'")) for i, c in enumerate(cells)]
    return F.concat(F.lit(LINE), position.cast("string"), F.lit(LINE_END), F.concat_ws(" | ", *shown))


def delete_verdict(path: Column, session_exists: Column, archived: Column, kind: Column) -> Column:
    """Why a file may not be deleted, in the order of the checks; ``ok`` otherwise. kind: file, directory or null."""
    from .files import is_safe_relative, last_part

    clean = F.ltrim(F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/"), F.lit("/"))
    unsafe = (clean == "") | ~is_safe_relative(clean) | F.array_contains(F.split(clean, "/"), "..")
    return (
        F.when(~session_exists, "no_session").when(archived, "archived").when(unsafe, "bad_path").when(last_part(clean) == "SESSION_MEMORY.md", "protected")
        .when(kind == "directory", "directory").when(kind.isNull(), "missing").otherwise("ok")
    )
