"""Statistics that analysts ask for: describe, value counts, grouped counts, table profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Parts into which a column's values are cut by approximate quantiles; each is a task's share of the exact work.
PARTS = 128
_QUARTILES = (0.25, 0.5, 0.75)


def _place(x: Column, bounds: list[float], low: int, high: int) -> Column:
    """How many of ``bounds`` are below x, between low and high: a comparison for each halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(x <= bounds[middle], _place(x, bounds, low, middle)).otherwise(_place(x, bounds, middle + 1, high))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = _QUARTILES) -> DataFrame:
    """Exact quantiles (linear between neighbours): columns column_name and quantiles (array of double), nulls left out.

    Values are counted first, so what goes on is one row for each distinct value. Approximate quantiles, a bounded
    array a column, cut these rows into parts; running sums within parts and the parts' totals give each value its
    ranks, and only the values that hold a wanted rank are kept. No task sees a whole column.
    """
    doubles = [F.col(f"`{c}`").cast("double") for c in columns]
    bounds = df.agg(*[F.approx_percentile(x, [i / PARTS for i in range(1, PARTS)], PARTS).alias(f"b{i}") for i, x in enumerate(doubles)]).first()
    cuts = [sorted(set(bounds[f"b{i}"] or [])) for i in range(len(columns))]
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), x.alias("x")) for i, x in enumerate(doubles)])).alias("v")).select("v.*").where("x is not null")
    counts = each.groupBy("c", "x").agg(F.count("*").alias("n"))
    part = F.lit(0)
    for i, own in enumerate(cuts):
        part = F.when(F.col("c") == i, _place(F.col("x"), own, 0, len(own))).otherwise(part)
    counts = counts.withColumn("part", part)
    totals = counts.groupBy("c", "part").agg(F.sum("n").alias("m"))  # at most PARTS rows a column
    before = Window.partitionBy("c").orderBy("part")
    totals = totals.select("c", "part", F.coalesce(F.sum("m").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("c")).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("c", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).join(F.broadcast(totals), ["c", "part"]).withColumn("last", F.col("before") + F.col("upto") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("total") - 1)).alias("r")) for k, q in enumerate(at)])
    near = ranked.select("c", "x", "first", "last", F.explode(wanted).alias("w")).select("c", "x", "first", "last", "w.*")
    low, high = F.floor("r"), F.ceil("r")
    near = near.where((low.between(F.col("first"), F.col("last"))) | (high.between(F.col("first"), F.col("last"))))
    pick = lambda rank: F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("x")))
    ends = near.groupBy("c", "k", "r").agg(pick(low).alias("a"), pick(high).alias("b")).withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * (F.col("r") - F.floor("r")))
    made = ends.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda s: s["q"]).alias("quantiles"))
    return made.select(F.element_at(F.array(*map(F.lit, columns)), F.col("c") + 1).alias("column_name"), "quantiles")


def describe(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One row a column: count, mean, std, min, quartiles (linear) and max."""
    made = []
    for c in columns:
        x = F.col(c).cast("double")
        made.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.round(F.avg(x), digits).alias("mean"), F.round(F.stddev_samp(x), digits).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    plain = df.agg(F.array(*made).alias("rows")).select(F.inline("rows"))
    quarter = lambda i: F.round(F.get("quantiles", F.lit(i)), digits)
    return plain.join(F.broadcast(quantiles(df, columns)), "column_name", "left").select("column_name", "n", "mean", "std", "min", quarter(0).alias("p25"), quarter(1).alias("p50"), quarter(2).alias("p75"), "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """One row a column: its place, type, rows and non-null values."""
    made = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type"), F.count("*").alias("n_rows"), F.count(F.col(f"`{f.name}`")).alias("non_null")) for i, f in enumerate(df.schema)]
    return df.agg(F.array(*made).alias("rows")).select(F.inline("rows"))


#: How an info text begins, its headings, and beyond how many columns and rows it leaves out lines and counts.
_CLASS, _HEADINGS, _MOST_COLUMNS, _MOST_ROWS = "<class 'pandas.core.frame.DataFrame'>", (" # ", "Column", "Non-Null Count", "Dtype"), 100, 1_690_785


def _dtype(kind: T.DataType, nulls: Column) -> Column:
    """What a column of a type is called in an info text; numbers with nulls are floats, and truths with nulls are objects."""
    if isinstance(kind, T.IntegralType):
        return F.when(nulls > 0, "float64").otherwise("int64")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return F.lit("float64")
    if isinstance(kind, T.BooleanType):
        return F.when(nulls > 0, "object").otherwise("bool")
    return F.lit("datetime64[ns]" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "object")


def info_text(df: DataFrame) -> DataFrame:
    """One row, info: a table's rows, columns, non-null values and types, as a data frame's info prints them (without memory).

    One pass of counts. Tables of over 100 columns have a line for all of them, those of over 1,690,785 rows no counts.
    """
    fields = df.schema.fields
    counted = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    n = F.col("n")
    types = F.array(*[_dtype(f.dataType, n - F.col(f"c{i}")) for i, f in enumerate(fields)]) if fields else F.array().cast("array<string>")
    index = F.concat(F.lit("RangeIndex: "), n.cast("string"), F.lit(" entries"), F.when(n > 0, F.concat(F.lit(", 0 to "), (n - 1).cast("string"))).otherwise(""))
    names = [f.name for f in fields]
    kinds = F.array_sort(F.array_distinct("t"))
    tally = F.array_join(F.transform(kinds, lambda k: F.concat(k, F.lit("("), F.size(F.filter("t", lambda x: x == k)).cast("string"), F.lit(")"))), ", ")
    if not fields:
        body = F.lit("Empty DataFrame")
    elif len(fields) > _MOST_COLUMNS:
        body = F.lit(f"Columns: {len(names)} entries, {names[0]} to {names[-1]}")
    else:
        shown = F.when(n <= _MOST_ROWS, F.array(*[F.concat(F.col(f"c{i}").cast("string"), F.lit(" non-null")) for i in range(len(names))]))
        columns = [F.array(*[F.lit(f" {i}") for i in range(len(names))]), F.array(*map(F.lit, names)), shown, F.col("t")]
        lines = []
        for at in range(-2, len(names)):
            cells = []
            for head, values in zip(_HEADINGS, columns, strict=True):
                width = F.greatest(F.lit(len(head)), F.array_max(F.transform(values, F.length)))
                cell = F.lit(head) if at == -2 else F.lit("-" * len(head)) if at == -1 else F.get(values, F.lit(at))
                cells.append(F.when(values.isNotNull(), F.rpad(cell, width, F.lit(" "))))  # a column of counts that is left out is null
            lines.append(F.concat_ws("  ", *cells))
        body = F.concat_ws("\n", F.lit(f"Data columns (total {len(names)} columns):"), *lines)
    end = [F.concat(F.lit("dtypes: "), tally)] if fields else []
    return counted.withColumn("t", types).select(F.concat_ws("\n", F.lit(_CLASS), index, body, *end).alias("info"))


def sketched(df: DataFrame, keys: list[str], counted: str, bits: int = 14) -> DataFrame:
    """A stored state for each of ``keys``: rows, and a sketch of the distinct values of ``counted`` that can be merged without the rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(counted, F.lit(bits)).alias("sketch"))


def merged_sketches(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and about how many distinct values several stored states have together; of ``2**bits`` registers the error is about 1.04 / sqrt of that."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))
