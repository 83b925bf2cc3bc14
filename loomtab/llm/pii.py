"""Personal data: base patterns, then terms that reveal them, on DataFrames alone.

Base kinds (email, ip, card, phone) are found by one regular expression each and
checked (parts, digits, Luhn). The expressions are possessive where the match
cannot need to give back, so long runs take linear time; offsets are running
sums of the lengths of matches and of what lies between them.

What is protected are the kinds (and their union, ``any``) and each value that is
found. Units that may disclose them are the words of texts that hold one, outside
of what was found, and for words of digits and other characters also their shape
(which of the two, and the power of two of the length): a code that occurs once
says nothing by itself, but codes of its shape do. Over distinct texts of the
whole corpus, with p(x) the share of texts that hold x, a thing carries
IC(x) = -log2 p(x) bits, and a unit t tells PMI(t; x) = log2 p(x | t) / p(x) of
them. p(x | t) is Wilson's lower bound at ``Z`` deviations, so what is seen seldom
tells little and no count cuts a pair off. A unit that makes a thing likely
(p(x | t) at least ``CERTAIN``) and tells at least ``GENERALISE`` of its information
is replaced by the class of its form in every text where it stands; one that
tells at least ``REMOVE`` is removed. Of a kind, each value is evidence in one
text only, so that near copies of a text are not taken for many witnesses.

Since n texts that all hold both give a bound of n / (n + Z^2), a unit seen with
a thing in fewer than ``LEAST`` texts cannot reach CERTAIN; such pairs are left
out before units are counted in the corpus, which changes no result. Copies of
a text count once. Sides are broadcast only if their rows, counted, are at
most ``SMALL``; hot things are pre-aggregated. Texts are shuffled only where
something is marked in them.

Rows: null and empty texts have no spans; repeated rows get one result each;
ids and other columns are not part of any statistic; an empty table has none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import id_key, keyed, let, table, written

Z, CERTAIN, GENERALISE, REMOVE, SMALL = 5.0, 0.25, 0.6, 0.8, 200_000
#: Follows from Z and CERTAIN: n / (n + Z^2) >= CERTAIN.
LEAST = math.ceil(Z * Z * CERTAIN / (1 - CERTAIN) - 1e-9)
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in a form that never backtracks over what it has taken.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to match at all.
_HINTS = {"email": "@", "ip": ".", "phone": "+"}
_TERM = r"[\p{L}\p{N}_]++(?:['’-][\p{L}\p{N}_]++)*+"
_SPAN = "array<struct<start: int, stop: int, value: string>>"
_MARKS = "array<struct<start: int, stop: int, action: string>>"


def running(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of int, in chunks of about the root of its size.

    Appending one by one copies what there is; over chunks that is n ** 1.5 steps in all, not n ** 2.
    """

    def one(part: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(add(F.get(acc, F.size(acc) - 1), x))))
        return F.aggregate(part, F.array().cast("array<int>"), step)

    def chunked(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        inner = F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / width).cast("int")), lambda c: one(F.slice(xs, c * width + 1, width)))
        joined = lambda parts, before: F.flatten(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.transform(part, lambda x: add(F.get(before, i - 1), x)))))
        return let(inner, lambda parts: let(one(F.transform(parts, lambda p: F.get(p, F.size(p) - 1))), lambda before: joined(parts, before)))

    return let(xs, lambda xs: F.when(F.size(xs) > 16, chunked(xs)).otherwise(one(xs)))


def matches(text: Column, pattern: str, valid: Callable[[Column], Column] = lambda m: F.lit(True)) -> Column:
    """Array of (start, stop, value) of the matches that are valid; offsets in code points."""

    def placed(found: Column) -> Column:
        steps = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, g: F.char_length(g) + F.char_length(m))
        spans = F.zip_with(found, running(steps, lambda a, b: a + b), lambda m, stop: F.struct((stop - F.char_length(m)).alias("start"), stop.alias("stop"), m.alias("value")))
        return F.when(F.size(found) > 0, F.filter(spans, lambda s: valid(s["value"]))).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = F.split(m, r"\.")
        return F.forall(part, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one base kind."""
    none = F.array().cast(_SPAN)
    found = matches(text, PATTERNS[kind], lambda m: _valid(kind, m))
    if kind == "card":  # sixteen digits at least, whatever lies between them
        return F.when(F.length(_digits(text)) >= 16, found).otherwise(none)
    return F.when(F.contains(text, F.lit(_HINTS[kind])), found).otherwise(none)


def _all(make: Callable[[str, Column], Column]) -> Column:
    """One array of make(kind, span) over the spans of all base kinds."""

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: make(kind, s))

    return F.concat(*map(of, KINDS))


def _replaced(text: Column, marks: Column) -> Column:
    """``text`` with each mark (start, stop, put) put in its place; marks that begin inside an earlier one are dropped."""

    def put(marks: Column, tops: Column) -> Column:
        before = lambda i: F.coalesce(F.get(tops, i - 1), F.lit(0))
        part = lambda m, i: F.when(m["start"] >= before(i), F.concat(F.substring(text, before(i) + 1, m["start"] - before(i)), m["put"])).otherwise("")
        return F.concat(F.array_join(F.transform(marks, part), ""), F.substring(text, before(F.size(marks)) + 1, F.char_length(text)))

    return let(F.array_sort(marks), lambda marks: let(running(F.transform(marks, lambda m: m["stop"]), F.greatest), lambda tops: put(marks, tops)))


def found_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k, h, id, one array of base spans a kind, and outside: what a text with spans says beside them, else null."""
    docs = keyed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select("*", *[base_spans(F.col("text"), kind).alias(kind) for kind in KINDS])
    blanks = _all(lambda kind, s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(" ").alias("put")))
    outside = F.when(sum(F.size(kind) for kind in KINDS) > 0, _replaced(F.col("text"), blanks))
    return docs.select("k", "h", "id", *KINDS, outside.alias("outside"))


def _shape(word: Column) -> Column:
    """The class of a word of digits and other characters; no word looks like it."""
    return F.concat(F.lit("<code:"), F.floor(F.log2(F.char_length(word))).cast("string"), F.lit(">"))


def _is_code(word: Column) -> Column:
    return F.regexp_like(word, F.lit("[0-9]")) & F.regexp_like(word, F.lit("[^0-9]"))


def units(text: Column) -> Column:
    """The distinct lower-cased words of a text, and the shapes of those that mix digits with others."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))
    return let(words, lambda ws: F.concat(ws, F.array_distinct(F.transform(F.filter(ws, _is_code), _shape))))


def _sized(df: DataFrame) -> DataFrame:
    """A written table, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def lower_bound(both: Column, of: Column) -> Column:
    """Wilson's lower bound, Z deviations down, of a share seen ``both`` times in ``of``."""
    p, zz = both / of, Z * Z
    return (p + zz / (2 * of) - Z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / of + zz / (4 * of * of))) / (1 + zz / of)


def disclosing(df: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """Columns unit and action (generalise or remove) of the units over the thresholds; ``found`` as a written table."""
    value = lambda kind, s: F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value"))
    held = found.where("outside is not null")
    values = written(held.select("h", F.explode(F.array_distinct(_all(value))).alias("x")).select("h", "x.*").distinct(), "pii-values")
    by_text = written(found.groupBy("h").agg(F.count("*").alias("n")), "pii-texts")
    total = by_text.count()
    # a kind is held by the texts that hold a value of it; its evidence is one text a value
    kinds = values.select("h", F.explode(F.array("kind", F.lit("any"))).alias("thing"))
    sizes = kinds.distinct().groupBy("thing").agg(F.count("*").alias("n_thing"))
    witness = values.groupBy("kind", "value").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    common = witness.where(F.col("n") >= LEAST).select("kind", "value", F.concat_ws(":", "kind", "value").alias("thing"), F.col("n").alias("n_thing"))
    common = written(common, "pii-common")
    evidence = witness.select("h", F.explode(F.array("kind", F.lit("any"))).alias("thing")).distinct()
    evidence = evidence.unionByName(values.join(_sized(common), ["kind", "value"]).select("h", "thing"))
    things = sizes.unionByName(common.select("thing", "n_thing")).where(F.col("n_thing") < total)
    texts = held.groupBy("h").agg(F.first("outside").alias("outside")).select("h", F.explode(units(F.col("outside"))).alias("unit"))
    pairs = texts.join(evidence, "h").groupBy("thing", "unit").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= LEAST)
    pairs = written(pairs, "pii-pairs")
    wanted = _sized(written(pairs.select("unit").distinct(), "pii-units"))
    copied = _sized(written(by_text.where("n > 1").select(F.col("h").alias("copy")), "pii-copies"))
    # texts that occur once are counted as rows, before any exchange; only those with copies go by their hash
    rows = df.select(F.xxhash64(text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(copied, F.col("h") == F.col("copy"), "left")
    seen = rows.select("copy", F.explode_outer(units(F.col("text"))).alias("unit")).join(wanted, "unit").groupBy("unit", "copy").agg(F.count("*").alias("n"))
    counts = seen.groupBy("unit").agg(F.sum(F.when(F.col("copy").isNull(), F.col("n")).otherwise(1)).alias("n_unit"))
    scored = pairs.join(things, "thing").join(counts, "unit")
    sure = lower_bound(F.col("n_both").cast("double"), F.greatest("n_unit", "n_both").cast("double"))
    bits = F.log2(F.lit(float(total)) / F.col("n_thing"))
    scored = scored.select("unit", sure.alias("sure"), ((F.log2(sure) + bits) / bits).alias("share"))
    listed = scored.where((F.col("sure") >= CERTAIN) & (F.col("share") >= GENERALISE))
    return listed.groupBy("unit").agg(F.when(F.max("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def _beside_base(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Of term places (k, h, start, stop, action) those that no base span of the same document touches: a sorted merge."""
    base = found.join(terms.select("k", "h").distinct(), ["k", "h"], "left_semi").select("k", "h", F.explode(_all(lambda kind, s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))).alias("s"))
    rows = terms.unionByName(base.select("k", "h", "s.*", F.lit(None).cast("string").alias("action")))
    order = Window.partitionBy("k", "h").orderBy("start", F.col("action").isNotNull())
    own = F.when(F.col("action").isNull(), F.col("stop"))
    before = F.max(own).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("action").isNull(), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = rows.select("*", before.alias("before"), after.alias("after")).where("action is not null")
    return marked.where((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("stop")) >= F.col("stop"))).drop("before", "after")


def protect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base spans of all rows (k, h, id, one array a kind), and terms (k, h, array of start, stop, action) of documents that have any."""
    found = written(found_spans(df, id_col, text_col), "pii-spans")
    listed = _sized(written(disclosing(df, found, text_col), "pii-listed"))
    docs = keyed(df, id_col, text_col).where("text is not null").select("k", "h", "text")
    hits = docs.select("k", "h", F.explode(units(F.col("text"))).alias("unit")).join(listed, "unit").distinct()
    hits = written(hits.groupBy("k", "h").agg(F.map_from_entries(F.collect_list(F.struct("unit", "action"))).alias("listed")), "pii-hits")
    action = lambda w: F.greatest(F.try_element_at("listed", w), F.when(_is_code(w), F.try_element_at("listed", _shape(w))))
    named = F.transform(matches(F.col("text"), _TERM), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), action(F.lower(t["value"])).alias("action")))
    places = docs.join(_sized(hits), ["k", "h"]).dropDuplicates(["k", "h"]).select("k", "h", F.explode(F.filter(named, lambda t: t["action"].isNotNull())).alias("t")).select("k", "h", "t.*")
    kept = _beside_base(written(places, "pii-places"), found)
    terms = kept.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "action"))).alias("terms"))
    return found.drop("outside"), written(terms, "pii-terms")


def sanitised(df: DataFrame, found: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns k, h and text of the documents in which anything is marked.

    Entities are replaced by their kind, terms generalised to a class of their form or removed.
    """
    marks = F.concat(
        _all(lambda kind, s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(f"<{kind.upper()}>").alias("put"))),
        F.transform(F.coalesce("terms", F.array().cast(_MARKS)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["action"] == "remove", "").otherwise("<TERM>").alias("put"))),
    )
    own = found.join(terms, ["k", "h"], "left").select("k", "h", marks.alias("marks")).where(F.size("marks") > 0).dropDuplicates(["k", "h"])
    docs = keyed(df, id_col, text_col).select("k", "h", "text").join(_sized(written(own, "pii-marks")), ["k", "h"])
    shape = lambda w: F.when(F.regexp_like(w, F.lit("[0-9]")), "<NUMBER>").when(F.regexp_like(w, F.lit(r"^\p{Lu}")), "<NAME>").otherwise("<WORD>")
    value = lambda m: F.substring(F.col("text"), m["start"] + 1, m["stop"] - m["start"])
    put = F.transform("marks", lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.when(m["put"] == "<TERM>", shape(value(m))).otherwise(m["put"]).alias("put")))
    return docs.select("k", "h", _replaced(F.col("text"), put).alias("text"))


def clean(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``df``, with sanitised texts where anything is marked in them."""
    done = sanitised(df, *protect(df, id_col, text_col), id_col, text_col).dropDuplicates(["k", "h"]).withColumnRenamed("text", "done")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    own = df.select(row.alias("row"), id_key(id_col).alias("k"), F.xxhash64(f"`{text_col}`").alias("h"))
    joined = own.join(done.hint("shuffle_hash"), ["k", "h"], "left")
    return joined.select(*[(F.coalesce("done", f"row.`{c}`") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns])


def _said(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, terms = protect(docs)
    texts = sanitised(docs, found, terms).select("k", "h", F.sha2("text", 256).alias("sanitised_sha256")).dropDuplicates(["k", "h"])
    rows = found.join(terms, ["k", "h"], "left").join(texts, ["k", "h"], "left").withColumn("terms", F.coalesce("terms", F.array().cast(_MARKS)))
    base = F.concat(*[_said(kind, kind) for kind in KINDS])
    return rows.select(
        F.col("id").alias("doc_id"), *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, _said("term", "terms")), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"), "sanitised_sha256",
    )


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
