"""Column functions over file names, paths and contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The length of a stored name, and what it may not hold (beside letters and digits of any script).
NAME_LIMIT = 200
NOT_IN_NAMES = r"(?U)[^\w.\- ()]+"

#: Declared content types by extension, used where an upload declares none.
MIME_BY_EXTENSION = {
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".json": "application/json",
    ".txt": "text/plain; charset=utf-8",
    ".md": "text/plain; charset=utf-8",
    ".log": "text/plain; charset=utf-8",
    ".yaml": "application/x-yaml",
    ".yml": "application/x-yaml",
    ".xml": "application/xml",
    ".html": "text/html; charset=utf-8",
    ".htm": "text/html; charset=utf-8",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".dcm": "application/dicom",
    ".dicom": "application/dicom",
}


def last_part(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; leading dots of a name do not start one."""
    return F.lower(F.regexp_extract(last_part(path), r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    """The name without its extension."""
    return F.substring(name, 1, F.length(name) - F.length(extension(name)))


def base_name(name: Column, fallback: str = "file") -> Column:
    """Last part of a path with either kind of slash, trimmed; the fallback where nothing is left."""
    base = F.trim(last_part(F.translate(F.coalesce(name, F.lit("")), "\\", "/")))
    return F.when(base == "", fallback).otherwise(base)


def safe_name(name: Column, fallback: str = "file") -> Column:
    """A name of word characters, dots, hyphens, spaces and parentheses, of at most NAME_LIMIT characters.

    Other runs become one underscore in the stem and nothing in the extension. What is replaced by what, and in which
    order, is fixed: names that exist were made so.
    """
    base, odd = base_name(name, fallback), NOT_IN_NAMES
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(stem(base), odd, "_"), "_{2,}", "_"), " {2,}", " ")
    body = F.btrim(body, F.lit(" ._"))
    raw = F.substring(base, F.length(stem(base)) + 1, F.length(base))
    tail = F.btrim(F.regexp_replace(F.ltrim(raw, F.lit(".")), odd, ""), F.lit("._"))
    return F.substring(F.concat(F.when(body == "", fallback).otherwise(body), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail))), 1, NAME_LIMIT)


def magic_prefix(content: Column) -> Column:
    """First eight bytes as lower-case hex."""
    return F.lower(F.hex(F.substring(content, 1, 8)))


def clean_mime(mime: Column) -> Column:
    """Content type without parameters; null where blank."""
    return F.nullif(F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1)))), F.lit(""))


def guess_mime(name: Column, declared: Column, rule_mimes: Column) -> Column:
    """Declared type, else that of the extension, else the rule's first, else bytes."""
    known = F.create_map(*[F.lit(x) for pair in MIME_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.nullif(declared, F.lit("")), F.element_at(known, extension(name)), F.get(rule_mimes, 0), F.lit("application/octet-stream"))


def session_of(path: Column) -> Column:
    """Session id of a path below the root: user/project/sessions/<id>/..., or the older user/<id>/..."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) >= 4) & (F.get(parts, 2) == "sessions"), F.get(parts, 3)).otherwise(F.get(parts, 1))


def session_folder(user: Column, project: Column, session: Column) -> Column:
    """A session's folder below the root: user/project/sessions/<id>, or user/<id> without a project."""
    return F.when(project.isNull(), F.concat_ws("/", user, session)).otherwise(F.concat_ws("/", user, project, F.lit("sessions"), session))


def is_safe_relative(path: Column) -> Column:
    """Whether a relative path stays below its root once dots are resolved."""
    zero = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        depth = F.when(part == "..", acc["depth"] - 1).when(part.isin("", "."), acc["depth"]).otherwise(acc["depth"] + 1)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    text = F.trim(F.coalesce(path, F.lit("")))
    return (text != "") & ~F.startswith(text, F.lit("/")) & F.aggregate(F.split(text, "/"), zero, step, lambda acc: acc["ok"])


def bucket_of(name: Column, by_category: dict[str, list[str]]) -> Column:
    """Display bucket of a workspace file; names that start with ``data`` count as data where no extension decides."""
    ext = extension(F.lower(name))
    out = None
    for category, extensions in by_category.items():
        out = (out if out is not None else F).when(ext.isin(extensions), category)
    return out.when(ext == ".py", "code").when(F.startswith(F.lower(name), F.lit("data")), "table").otherwise("other")
