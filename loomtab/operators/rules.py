"""Format rules: which handler and category a file gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.files import clean_mime, extension

#: The built-in rules (id, category, handler, extensions, content types, magic prefixes), in order.
BUILTIN = [
    ("builtin.table.xlsx", "table", "table", [".xlsx", ".xls"], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"], []),
    ("builtin.table.csv", "table", "table", [".csv", ".tsv"], ["text/csv", "text/tab-separated-values"], []),
    ("builtin.image.raster", "image", "image", [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp"], ["image/png", "image/jpeg", "image/gif", "image/webp", "image/bmp"], []),
    ("builtin.text.plain", "text", "text", [".txt", ".md", ".log"], ["text/plain"], []),
    ("builtin.text.structured", "text", "text", [".json", ".yaml", ".yml", ".xml", ".html", ".htm"], ["application/json", "application/x-yaml", "application/xml", "text/html"], []),
    ("builtin.document.pdf", "document", "document_pdf", [".pdf"], ["application/pdf"], ["25504446"]),
    ("builtin.document.docx", "document", "document_docx", [".docx"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], []),
    ("builtin.imaging.dicom", "imaging", "imaging_dicom", [".dcm", ".dicom"], ["application/dicom"], []),
]
#: Categories that are parsed in depth, and the order of a roll-up.
DEEP = ("table", "image", "text", "document", "imaging")
ROLLUP_ORDER = ("table", "image", "text", "document", "imaging", "binary")
SCHEMA = "format_id string, category string, handler_id string, extensions array<string>, mime_types array<string>, magic_prefixes array<string>, priority int, builtin boolean, enabled boolean, ordinal int"


def extensions_by_category() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for _, category, _, extensions, _, _ in BUILTIN:
        out.setdefault(category, []).extend(extensions)
    return out


def rules(spark: SparkSession, custom: list[dict] | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Custom rules, then the built-in ones; ``ordinal`` is the order that breaks ties."""
    rows = [
        (r["format_id"], r["category"], r["handler_id"], [e.lower() if e.startswith(".") else f".{e.lower()}" for e in r["extensions"]],
         [m.lower() for m in r.get("mime_types", [])], [m.lower().replace(" ", "") for m in r.get("magic_prefixes", [])], int(r.get("priority", 0)), False, bool(r.get("enabled", True)))
        for r in custom or []
    ] + [(*row, 100, True, row[0] not in disabled) for row in BUILTIN]
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], SCHEMA)


def resolve(files: DataFrame, rules_: DataFrame, path: str = "path", mime: Column | None = None, magic: Column | None = None) -> DataFrame:
    """``files`` with format_id, category and handler_id of the best rule; category binary where none matches.

    Candidates are found by equi-joins on what rules list (extensions, content
    types) rather than by testing every file against every rule; magic prefixes
    are few and go by length. The rule table is a dimension of a few rows that
    a person keeps, so it is broadcast. Custom rules go first, then priority,
    then the order of the table; of each file only the best candidate's rank is
    carried, as a minimum that pre-aggregates by extension and type.
    """
    live = rules_.where("enabled").select("*", F.struct(F.col("builtin").cast("int").alias("b"), (-F.col("priority")).alias("p"), F.col("ordinal").alias("o")).alias("rank"))
    pick = ["rank", "format_id", "category", "handler_id"]

    def best(keyed: DataFrame, key: str) -> DataFrame:
        return keyed.groupBy(key).agg(F.min(F.struct(*pick)).alias(f"by_{key}"))

    out = files.withColumn("ext", extension(F.col(path)))
    out = out.join(F.broadcast(best(live.select(*pick, F.explode("extensions").alias("ext")), "ext")), "ext", "left")
    found = [F.when(F.col("ext") != "", F.col("by_ext"))]
    if mime is not None:
        out = out.withColumn("mime_", clean_mime(mime)).join(F.broadcast(best(live.select(*pick, F.explode("mime_types").alias("mime_")), "mime_")), "mime_", "left")
        found.append(F.col("by_mime_"))
    if magic is not None:
        prefixes = live.select(*pick, F.explode("magic_prefixes").alias("prefix"))
        for n in sorted({r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()}):
            key = f"magic_{n}"
            out = out.withColumn(key, F.substring(magic, 1, n)).join(F.broadcast(best(prefixes.where(F.length("prefix") == n).withColumnRenamed("prefix", key), key)), key, "left")
            found.append(F.col(f"by_{key}"))
    choice = F.least(*found) if len(found) > 1 else found[0]
    return out.withColumn("choice_", choice).select(
        *files.columns, "ext", F.col("choice_.format_id").alias("format_id"), F.coalesce("choice_.category", F.lit("binary")).alias("category"), F.coalesce("choice_.handler_id", F.lit("binary")).alias("handler_id")
    )


def allowed(resolved: DataFrame) -> DataFrame:
    """Files that may be uploaded: a rule matched and its category is parsed in depth."""
    return resolved.where(F.col("format_id").isNotNull() & F.col("category").isin(*DEEP))


def supported_extensions(rules_: DataFrame) -> DataFrame:
    """Distinct extensions of enabled rules of deep categories."""
    return rules_.where(F.col("enabled") & F.col("category").isin(*DEEP)).select(F.explode("extensions").alias("extension")).distinct()


def category_counts(resolved: DataFrame) -> DataFrame:
    """Files by category; ``place`` is the order in which a summary names them."""
    place = F.array_position(F.array(*map(F.lit, ROLLUP_ORDER)), F.col("category")).cast("int")
    return resolved.groupBy("category").agg(F.count("*").alias("n_files")).withColumn("place", place)


def rollup_text(counts: DataFrame) -> DataFrame:
    """One row: ``table=3, text=1`` in roll-up order. ``counts`` has a row a category."""
    items = F.array_sort(F.collect_list(F.struct("place", "category", "n_files")))
    return counts.agg(F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["category"], x["n_files"].cast("string"))), ", ").alias("summary"))


def upserted(custom: DataFrame, offered: DataFrame, handlers: list[str], order: str = "at") -> tuple[DataFrame, DataFrame]:
    """Offered rules with ``outcome``, and the table of custom rules with the accepted ones, the last of each id, in their places.

    Refused are a blank id, one of the built-in rules, an unknown handler and an unknown category, in that order. A
    rule that replaces another keeps its ordinal; new ones follow in order of arrival.
    """
    name = F.trim(F.coalesce("format_id", F.lit("")))
    outcome = (
        F.when(name == "", "no_id").when(F.startswith(name, F.lit("builtin.")), "protected").when(~F.col("handler_id").isin(*handlers), "unknown_handler")
        .when(~F.col("category").isin(*DEEP, "binary"), "unknown_category").otherwise("stored")
    )
    judged = offered.withColumn("outcome", outcome)
    rest = [c for c in custom.columns if c not in ("format_id", "ordinal")]
    last = judged.where("outcome = 'stored'").groupBy("format_id").agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("first_"))
    base = custom.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("base_"))
    new = last.join(custom.select("format_id"), "format_id", "left_anti").select("format_id", "r", F.row_number().over(Window.orderBy("first_")).alias("n_"))  # rules that people keep: few
    new = new.join(F.broadcast(base)).select("format_id", "r.*", (F.col("base_") + F.col("n_") - 1).cast("int").alias("ordinal"))
    old = custom.join(last.select("format_id", "r"), "format_id", "left")
    kept = old.select("format_id", *[F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c) for c in rest], "ordinal")
    return judged, kept.unionByName(new)


def deleted(custom: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asked ids with ``outcome`` (protected, deleted, unknown), and the custom rules that stay."""
    ids = asked.withColumn("format_id", F.trim(F.coalesce("format_id", F.lit("")))).distinct()
    have = custom.select("format_id").distinct().withColumn("have_", F.lit(True))
    built_in = F.startswith("format_id", F.lit("builtin."))
    judged = ids.join(have, "format_id", "left").withColumn("outcome", F.when(built_in, "protected").when(F.col("have_"), "deleted").otherwise("unknown")).drop("have_")
    return judged, custom.join(judged.where("outcome = 'deleted'").select("format_id"), "format_id", "left_anti")


def by_id(rules_: DataFrame, asked: DataFrame) -> DataFrame:
    """The rule of each asked id, custom ones first; null columns where there is none."""
    rest = [c for c in rules_.columns if c != "format_id"]
    first = rules_.groupBy("format_id").agg(F.min_by(F.struct(*rest), F.struct(F.col("builtin").cast("int"), "ordinal")).alias("r"))
    return asked.join(first, "format_id", "left").select(*asked.columns, "r.*")


def catalog_entry(resolved: DataFrame) -> DataFrame:
    """What the catalog says of a file (columns path, size_bytes and those of ``resolve``)."""
    deep = F.col("format_id").isNotNull() & F.col("category").isin(*DEEP)
    return resolved.select(F.col("path").alias("relative_path"), F.col("category").alias("file_category"), "size_bytes", "format_id", "handler_id", deep.alias("deep_parse"))
