"""Workspace files as rows: inventory, tree, content payloads and text digests."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.files import extension, magic_prefix
from ..functions.text import line_count
from ..operators.ordered import file_system, written

MEMORY_FILE = "SESSION_MEMORY.md"
PREVIEW_CHARS, KEYS = 4000, 50
_FOUND = "relative_path string, path string, kind string, size_bytes long"


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies directly in each directory; links to directories are not followed."""
    for frame in frames:
        for above, uri in frame[["relative_path", "path"]].itertuples(index=False):
            system, where = file_system(uri)
            rows = []
            for x in system.get_file_info(fs.FileSelector(where, allow_not_found=True)):
                directory = x.type == fs.FileType.Directory
                if directory and system.type_name == "local" and os.path.islink(x.path):
                    continue
                rows.append((f"{above}/{x.base_name}".lstrip("/"), f"{uri.rstrip('/')}/{x.base_name}", "directory" if directory else "file", None if directory else x.size))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=["relative_path", "path", "kind", "size_bytes"])
                    rows = []
            yield pd.DataFrame(rows, columns=["relative_path", "path", "kind", "size_bytes"])


def listing(spark: SparkSession, root: str, depth: int | None = None) -> DataFrame:
    """relative_path, path and size_bytes of all files below a root, names with a leading dot or underscore included.

    The frontier, a table of directories, is expanded one level a round by tasks that list them through Arrow's file
    systems (local, HDFS, object stores); the driver only asks whether a level has directories. A missing root is empty.
    """
    level, files = spark.createDataFrame([("", root)], "relative_path string, path string"), []
    while depth is None or len(files) < depth:
        # directories are dealt by name: those of one parent are listed by many tasks
        found = written(level.select("relative_path", "path").repartition("path").mapInPandas(_listed, _FOUND), "listing")
        files.append(found.where("kind = 'file'").drop("kind"))
        level = found.where("kind = 'directory'")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, files)


def _wanted(dotfiles: bool, dot_directories: bool) -> Column:
    parts = F.split("relative_path", "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.size(parts) - 1)
    dotted = F.startswith(name, F.lit("."))
    hidden = dotted & (F.lit(not dotfiles) | F.endswith(name, F.lit(".crc"))) | F.lit(not dot_directories) & F.exists(folders, lambda f: F.startswith(f, F.lit(".")))
    return (name != MEMORY_FILE) & ~hidden


def scan(spark: SparkSession, root: str, depth: int | None = None, dotfiles: bool = False, dot_directories: bool = True) -> DataFrame:
    """Inventory of a workspace folder, sorted by path.

    Files whose name starts with a dot and the memory file are left out; a
    missing root is an empty inventory. ``depth`` 1 lists direct files only.
    """
    own = listing(spark, root, depth).where(_wanted(dotfiles, dot_directories))
    return own.select("relative_path", "size_bytes", F.size(F.split("relative_path", "/")).alias("depth")).orderBy("relative_path")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for name, uri in frame.itertuples(index=False):
            system, where = file_system(uri)
            with system.open_input_stream(where) as f:
                content = f.read()
            yield pd.DataFrame({"relative_path": [name], "content": [content], "size_bytes": [len(content)]})


def contents(spark: SparkSession, root: str, dotfiles: bool = False, dot_directories: bool = True) -> DataFrame:
    """relative_path, content and size_bytes of the files that ``scan`` lists, read by executors one file at a time."""
    own = listing(spark, root).where(_wanted(dotfiles, dot_directories)).select("relative_path", "path")
    return own.repartition("path").mapInPandas(_read, "relative_path string, content binary, size_bytes long")


def project_tree(inventory: DataFrame, roots: tuple[str, ...] = ("raw", "outputs", "archive")) -> DataFrame:
    """The tree below a project's folders, with a folder of its own for each that holds nothing."""
    own = tree(inventory.where(F.split_part("relative_path", F.lit("/"), F.lit(1)).isin(*roots)))
    stubs = inventory.sparkSession.createDataFrame([(r, "", 1, "directory", None) for r in roots], own.schema)
    return own.unionByName(stubs).distinct()


def tree(inventory: DataFrame) -> DataFrame:
    """Flat directory tree: path, parent, depth and kind of every file and of every folder above one."""
    parts = F.split("relative_path", "/")
    levels = inventory.select("relative_path", "size_bytes", parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    nodes = levels.select(
        F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"), "depth",
        F.when(F.col("depth") == F.size("p"), "file").otherwise("directory").alias("kind"), F.when(F.col("depth") == F.size("p"), F.col("size_bytes")).alias("size_bytes"),
    )
    return nodes.distinct()


def payload(files: DataFrame) -> DataFrame:
    """Content as text where it is UTF-8, else as base64."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("relative_path", F.when(text.isNotNull(), "utf-8").otherwise("base64").alias("encoding"), F.coalesce(text, F.base64("content")).alias("content"))


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType())]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """The first encoding of the ladder that decodes all bytes."""

    def one(raw: bytes) -> tuple[str, str]:
        for name in ("utf-8", "gbk", "latin-1"):
            try:
                return name, bytes(raw or b"").decode(name)
            except UnicodeDecodeError:
                continue
        raise AssertionError("latin-1 decodes anything")

    return pd.DataFrame([one(x) for x in content], columns=["encoding", "text"])


def text_digest(text: Column) -> list[Column]:
    """Preview, line count and whether the preview reached its limit."""
    return [F.substring(text, 1, PREVIEW_CHARS).alias("preview"), line_count(text).cast("long").alias("line_count"), (F.length(text) >= PREVIEW_CHARS).alias("preview_truncated")]


def json_summary(text: Column) -> list[Column]:
    """Type of a JSON text, keys of an object, length of an array and keys of its first item; nulls where it doesn't parse."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    is_object, is_array = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY"))
    keys = F.json_object_keys(text)
    return [
        F.when(is_object, "dict").when(is_array, "list").otherwise(F.lower(kind)).alias("json_type"), F.when(is_object, F.slice(keys, 1, KEYS)).alias("json_keys"),
        F.when(is_object, F.size(keys)).alias("json_key_count"), F.when(is_array, F.json_array_length(text)).alias("json_length"),
        F.slice(F.json_object_keys(F.when(is_array, F.get_json_object(text, "$[0]"))), 1, KEYS).alias("json_item_keys"),
    ]


def digests(files: DataFrame) -> DataFrame:
    """One row a text file: encoding, preview, line count and JSON summary (for .json)."""
    read = files.withColumn("d", decoded("content")).select("relative_path", F.octet_length("content").alias("size_bytes"), magic_prefix(F.col("content")).alias("magic"), "d.*")
    is_json = extension(F.col("relative_path")) == ".json"
    summary = json_summary(F.when(is_json, F.col("text")))
    return read.select("relative_path", "size_bytes", "magic", "encoding", *text_digest(F.col("text")), *summary)
