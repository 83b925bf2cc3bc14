"""Unique names for uploads that arrive together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import NAME_LIMIT, safe_name, stem
from .ordered import ROWS, in_order, written

#: Digits of the numbers that names can carry.
_DIGITS = 15
_LIST = ["d", "safe"]


def _suffix(name: Column) -> Column:
    """The extension with its dot, in the name's own case."""
    return F.substring(name, F.length(stem(name)) + 1, F.length(name))


def _room(digits: Column, end: Column) -> Column:
    """Characters of a stem that fit beside a number of so many digits."""
    return F.greatest(F.lit(1), NAME_LIMIT - 3 - digits - F.length(end))


def _form(n: Column) -> Column:
    """The n-th form of a name of columns safe, first (its stem) and end: itself for 0, else ``stem (n).ext`` with as much of the stem as fits."""
    number = n.cast("string")
    return F.when(n == 0, F.col("safe")).otherwise(F.concat(F.substring("first", F.lit(1), _room(F.length(number), F.col("end"))), F.lit(" ("), number, F.lit(")"), F.col("end")))


def _numbers(lists: DataFrame, strings: DataFrame) -> DataFrame:
    """Columns d, safe, n and the further columns of ``strings`` (d, taken, ...): which forms of which lists the strings are.

    A string is the form 0 of the list of its name, and form n of lists whose stem, cut to the room beside n, it begins
    with; both are equal keys, so strings of one folder do not all meet.
    """
    further = [c for c in strings.columns if c not in ("d", "taken")]
    plain = strings.select("d", F.col("taken").alias("safe"), *further).join(lists.select(*_LIST), _LIST, "left_semi").select(*_LIST, F.lit(0).cast("long").alias("n"), *further)
    body = stem(F.col("taken"))
    part = lambda k: F.regexp_extract(body, rf"(?s)^(.*) \(([1-9][0-9]{{0,{_DIGITS - 1}}})\)$", k)
    parsed = strings.select("*", F.nullif(part(2), F.lit("")).cast("long").alias("n"), part(1).alias("prefix"), _suffix(F.col("taken")).alias("end")).where("n is not null")
    prefixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(_DIGITS)), lambda k: F.substring("first", F.lit(1), _room(k, F.col("end")))))
    keyed = lists.select("d", "safe", "first", "end", F.explode(prefixes).alias("prefix"))
    return plain.unionByName(parsed.join(keyed, ["d", "prefix", "end"]).where(_form(F.col("n")) == F.col("taken")).select(*_LIST, "n", *further)).distinct()


def _proposals(asking: DataFrame, taken: DataFrame | None, rows: int) -> DataFrame:
    """``asking`` (d, safe, o, start, nth, ...) with n: of the numbers from ``start`` on that ``taken`` (d, safe, n, start) leaves free, the ``nth`` from 0.

    Of taken numbers t0 < t1 < ... from the start on, the i-th leaves t_i - start - i free ones below it, so the number is
    start + nth + |{i: t_i - start - i <= nth}|: a running count over uploads and taken numbers in one order, less the
    count where the list begins.
    """
    plain = F.col("start") + F.col("nth")
    if taken is None:
        return asking.withColumn("n", plain)
    gone = in_order(taken.where("n >= start"), [*_LIST, "n"], "taken-numbers", rows=rows)
    first = gone.groupBy(*_LIST).agg(F.min("place_").alias("from_"))
    gaps = gone.join(first, _LIST).select(*_LIST, (F.col("n") - F.col("start") - F.col("place_") + F.col("from_")).alias("at"), F.lit(0).alias("own"))
    both = in_order(asking.withColumns({"at": F.col("nth"), "own": F.lit(1)}).unionByName(gaps, allowMissingColumns=True), [*_LIST, "at", "own", "nth"], "numbered-uploads", 1 - F.col("own"), rows)
    before = both.groupBy(*_LIST).agg(F.min(F.col("sum_") - (1 - F.col("own"))).alias("base_"))
    return both.where("own = 1").join(before, _LIST).select(*asking.columns, (plain + F.col("sum_") - F.col("base_")).alias("n"))


def allocate(uploads: DataFrame, existing: DataFrame, directory: str = "directory", name: str = "name", order: str = "ord", rows: int = ROWS) -> DataFrame:
    """Columns of ``uploads``, then safe, stored and renamed: the first free ``stem (N).ext`` of the upload's directory, in order of arrival.

    ``order`` is total within a directory. Names that are taken are found by rounds: all uploads propose, the earliest
    upload that proposes a name keeps it for now, and in each list (uploads of one name to one directory) everyone from
    the first loser on proposes the next numbers, without those that are taken or that earlier uploads of other lists
    hold. A name that was proposed stays with that upload or goes to an earlier one, so whoever passed it over was right
    to, and when nobody loses all have what they would have got one after another. Lists are numbered through
    ``in_order``: neither a directory nor a list is one group. Names of ``existing`` that are null or empty do not
    count. Input columns named safe, stored or renamed are replaced; null names get the fallback's name.
    """
    kept = [c for c in uploads.columns if c not in ("safe", "stored", "renamed")]
    folder = F.to_json(F.struct(F.col(f"`{directory}`").alias("d"))).alias("d")  # null is a folder like any other
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    # tables, so that what made a name is worked out once
    asked = written(uploads.select(row.alias("row"), folder, F.col(f"`{order}`").alias("o"), safe_name(F.col(f"`{name}`")).alias("safe")), "uploads")
    taken = existing.select(folder, F.col(f"`{name}`").alias("taken")).where("taken is not null and taken <> ''").distinct()
    parts = {"first": stem(F.col("safe")), "end": _suffix(F.col("safe"))}
    lists = asked.select(*_LIST).distinct().withColumns(parts)
    zero = F.lit(0).cast("long")
    gone = None if taken.isEmpty() else written(_numbers(lists, taken), "taken")
    placed = in_order(asked.select(*_LIST, "o"), [*_LIST, "o"], "upload-order", rows=rows)
    begins = placed.groupBy(*_LIST).agg(F.min("place_").alias("from_"))
    asking = placed.join(begins, _LIST).select(*_LIST, "o", zero.alias("start"), (F.col("place_") - F.col("from_")).alias("nth")).withColumn("k", F.col("nth"))
    settled, blocked = None, None if gone is None else gone.withColumn("start", zero)
    while True:
        made = _proposals(asking, blocked, rows).withColumns(parts).select(*_LIST, "o", "k", "n", _form(F.col("n")).alias("stored"))
        state = written(made if settled is None else settled.unionByName(made), "proposals")
        contested = state.groupBy("d", "stored").agg(F.min("o").alias("holder"), F.count("*").alias("c")).where("c > 1")
        if contested.isEmpty():
            break
        lost = state.join(written(contested.select("d", "stored", "holder"), "contested"), ["d", "stored"]).where("o > holder")
        losers = written(lost.groupBy(*_LIST).agg(F.min(F.struct("o", "n", "k")).alias("x")).select(*_LIST, F.col("x.o").alias("o_"), F.col("x.n").alias("n_"), F.col("x.k").alias("k_")), "losers")
        asking = state.join(losers, _LIST).where("o >= o_").select(*_LIST, "o", (F.col("n_") + 1).alias("start"), (F.col("k") - F.col("k_")).alias("nth"), "k")
        settled = state.join(losers, _LIST, "left").where("o_ is null or o < o_").select(*state.columns)
        held = _numbers(losers.select(*_LIST).withColumns(parts), state.select("d", F.col("stored").alias("taken"), "o")).join(losers, _LIST).where("o < o_ and n > n_").select(*_LIST, "n")
        every = held if gone is None else held.unionByName(gone)
        blocked = written(every.join(losers, _LIST).select(*_LIST, "n", (F.col("n_") + 1).alias("start")).distinct(), "blocked")
    out = asked.join(state.select("d", "safe", "o", "stored"), ["d", "safe", "o"])
    return out.select("row.*", "safe", "stored", (F.col("stored") != F.col("safe")).alias("renamed"))
