"""Column functions over texts that pass between pipeline stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a cut, and the fences of a code block, in the order in which they are removed.
CUT_MARK = "\n…（已截断）"
FENCES = (r"(?m)^```python\s*", r"(?m)^```\s*", r"\s*```$")
_BLANKS = " \t\n\r\f\u000b"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once however often ``f`` names it; under a condition or in a lambda it would be made anew each time."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shorten(text: Column, most: int, mark: str = CUT_MARK) -> Column:
    """Trimmed text; one longer than ``most`` keeps most - 20 characters and the mark."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return once(trimmed, lambda t: F.when(F.length(t) > most, F.concat(F.substring(t, 1, max(0, most - 20)), F.lit(mark))).otherwise(t))


def line_count(text: Column) -> Column:
    """Lines as a reader iterates over them: a last line without its end counts, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))


def unfence(code: Column) -> Column:
    """Code without the fences of a markdown block."""
    out = F.coalesce(code, F.lit(""))
    for fence in FENCES:
        out = F.regexp_replace(out, fence, "")
    return F.btrim(out, F.lit(_BLANKS))


def sse(payload: Column) -> Column:
    """One server-sent event frame of a JSON payload."""
    return F.concat(F.lit("data: "), payload, F.lit("\n\n"))


def permissions(raw: Column) -> Column:
    """JSON array of permission codes; the default where it is null or malformed."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array(F.lit("data_download")))


#: Characters that no command may hold, and the one form that commands have.
NOT_IN_COMMANDS, COMMAND = r"[;|&`$<>]", r"^python3\s+(\S+)\s*$"


def allowed_command(command: Column) -> Column:
    """Script that a ``python3 <script>.py`` command names; null for any other command."""
    script = F.regexp_extract(command, COMMAND, 1)
    return F.when(~F.regexp_like(command, F.lit(NOT_IN_COMMANDS)) & F.endswith(script, F.lit(".py")), script)


def tail(items: Column, n: int = 8) -> Column:
    """The last n elements; all of them where there are fewer."""
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))


def is_json(text: Column) -> Column:
    """Whether all of a text is one JSON value: the parser by itself takes a value with anything after it."""
    one = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.try_parse_json(one).isNotNull() & (F.json_array_length(one) == 1), F.lit(False))
