"""Delimited tables as a reader of unknown files sees them: the header is a row of data until it is promoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import extension
from . import delimited

SAMPLE_ROWS = 5
#: Cell texts that mean no value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class RaggedTable(ValueError):
    """A row has more cells than the first one."""


def read_raw(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None) -> DataFrame:
    """All rows as strings c0, c1, ... with ``pos``; short rows are filled with nulls, a longer one is an error.

    The width is that of the first record. ``pos`` follows the file's order. The file is read by blocks, as ``delimited`` has it.
    """
    found = delimited.records(spark, path, separator, encoding, strict=True)
    shape = delimited.shapes(found).first()
    if shape is None:
        raise ValueError("the file is empty")
    if shape.ragged:
        raise RaggedTable(f"a row has more than {shape.width} cells")
    cell = lambda i: F.get("cells", F.lit(i))
    return found.select((F.shiftleft("record", 16) + F.col("part")).alias("pos"), *[F.when(~cell(i).isin(NA_TOKENS), cell(i)).alias(f"c{i}") for i in range(shape.width)])


def unique_names(cells: list[str | None], strict: bool = False) -> list[str]:
    """Column names of header cells; repeats are numbered, which can collide again unless ``strict``."""
    seen: dict[str, int] = {}
    taken: set[str] = set()
    out = []
    for i, cell in enumerate(cells):
        name = (cell or "").strip() or f"Unnamed: {i}"
        k = seen[name] = seen.get(name, -1) + 1
        made = name if not k else f"{name}_{k}"
        while strict and made in taken:
            k = seen[name] = seen[name] + 1
            made = f"{name}_{k}"
        taken.add(made)
        out.append(made)
    return out


def promote_header(raw: DataFrame, row: int = 0, names: list[str] | None = None) -> DataFrame:
    """The table below its header row; columns whose header cell is blank or a number hold numbers where they can.

    ``row`` and ``names`` repair a header that isn't the first row. A table of a header alone has no columns.
    """
    cells = [c for c in raw.columns if c != "pos"]
    head = raw.orderBy("pos").limit(row + 1).collect()
    if len(head) <= row or raw.limit(row + 2).count() <= row + 1:
        return raw.limit(0).select()
    values = [head[row][c] for c in cells]
    made = unique_names(names or values)

    def typed(c: str, header: str | None) -> Column:
        numeric = header is None or header.strip().replace(".", "", 1).lstrip("-").isdigit()
        return F.coalesce(F.col(c).try_cast("double").cast("string"), F.col(c)) if numeric else F.col(c)

    body = raw.where(F.col("pos") > head[row]["pos"])
    return body.select(*[typed(c, v).alias(n) for c, v, n in zip(cells, values, made, strict=True)])


def repaired(table: DataFrame, start: int, names: list[str], place: str = "pos") -> tuple[DataFrame, bool]:
    """The table from its row ``start`` on, its columns named anew and made unique, and whether that was done.

    A start that is not below the number of rows leaves the table as it is. ``place`` orders rows and is no column;
    only a count and one row's place come to the driver.
    """
    cells = [c for c in table.columns if c != place]
    if start >= table.count() or len(names) != len(cells):
        return table.drop(place), False
    first = table.select(place).orderBy(place).offset(start).limit(1).first()[0]
    body = table.where(F.col(place) >= first)
    return body.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cells, unique_names(names), strict=True)]), True


def sample(raw: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return raw.orderBy("pos").limit(rows)


def read_hint(path: Column) -> Column:
    """How a script should read the file: only .csv is read as text."""
    return F.when(extension(path) == ".csv", F.lit("pd.read_csv(path)")).otherwise(F.lit("pd.read_excel(path)"))


def export(df: DataFrame, directory: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", separator).csv(directory)
