"""The session event log: compaction, tail and folds over rows (session, seq, type, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_json, shorten
from .ordered import ROWS, dealt, joined, neighbours, running

CHUNK, COMPLETE = "llm_chunk", "llm_complete"
#: Event types after which a session's stream ends.
TERMINAL = ("streaming_ended", "streaming_error", "error")


def compact(events: DataFrame, session: str = "session_id", seq: str = "seq", rows: int = ROWS) -> DataFrame:
    """Consecutive chunks become one event with the first one's place; a complete event drops chunks right before it.

    A segmented scan: the log is dealt in its order over parts, where runs of chunks get numbers that go on from part to
    part; a run's pieces, one a part, are joined. So a session of any length is many tasks' work.
    """
    order = [session, seq]
    log = neighbours(dealt(events, order, "event-log", rows), order, F.struct(F.col(session).alias("s"), F.col("type").alias("t")))
    is_chunk, own = F.col("type") == CHUNK, lambda x: F.col(x)["s"].eqNullSafe(F.col(session))
    goes_on = F.coalesce(is_chunk & own("prev_") & (F.col("prev_")["t"] == CHUNK), F.lit(False))
    completed = F.coalesce(is_chunk & own("next_") & (F.col("next_")["t"] == COMPLETE), F.lit(False))
    numbered = running(log, order, F.when(goes_on, 0).otherwise(1)).withColumn("done_", completed)
    more = {
        "first_": (F.min, F.min, F.struct(F.col(seq).alias("seq"), F.col("type").alias("type"))), "n_merged": (F.count, F.sum, F.lit(1)), "done_": (F.bool_or, F.bool_or, F.col("done_")),
    }
    runs = joined(numbered, [session, "sum_"], seq, {"c_": F.coalesce("content", F.lit(""))}, more).where("not done_")
    return runs.select(session, F.col("first_.seq").alias(seq), F.col("first_.type").alias("type"), F.array_join("c_", "").alias("content"), "n_merged")


def is_terminal(kind: Column) -> Column:
    return kind.isin(*TERMINAL)


def tail_after(events: DataFrame, versions: DataFrame, session: str = "session_id", version: str = "version") -> DataFrame:
    """Events newer than the version that a reader has seen, up to the session's first terminal event."""
    new = events.join(versions, session).where(F.col(version) > F.col("seen"))
    end = new.where(is_terminal(F.col("type"))).groupBy(session).agg(F.min(version).alias("end_"))
    return new.join(end, session, "left").where(F.col("end_").isNull() | (F.col(version) <= F.col("end_"))).drop("end_", "seen")


def fold(events: DataFrame, session: str = "session_id", seq: str = "seq", rows: int = ROWS) -> DataFrame:
    """A reader's view of a session: number of events, report text and status by the last event; a long session is gathered by parts."""
    log = dealt(events, [session, seq], "event-log", rows)
    more = {"n_events": (F.count, F.sum, F.lit(1)), "last_": (F.max, F.max, F.struct(F.col(seq).alias("seq"), F.col("type").alias("type")))}
    told = joined(log, [session], seq, {"report_": F.when(F.col("type") == "report_chunk", F.coalesce("content", F.lit("")))}, more)
    status = F.when(F.col("last_.type").isin("streaming_error", "error"), "error").otherwise("done")
    return told.select(session, "n_events", F.array_join("report_", "").alias("report"), status.alias("status"))


def rollup_results(results: DataFrame, key: str, order: str, rows: int = ROWS) -> DataFrame:
    """Worker results by key: success if all succeeded, logs joined in order, errors of failed ones; a key's results are gathered by parts."""
    told = dealt(results, [key, order], "results", rows)
    failed = F.when(~F.col("success"), F.col("error"))
    found = joined(told, [key], order, {"logs": F.col("log"), "errors": failed}, {"success": (F.bool_and, F.bool_and, F.col("success"))})
    return found.select(key, "success", F.array_join("logs", "\n").alias("logs"), "errors")


def increments(before: DataFrame, after: DataFrame, session: str = "session_id", place: str = "place", value: str = "event") -> DataFrame:
    """What a reader who has seen ``before`` is sent of ``after``, one row a session that has any.

    More events: only the last; as many: the last that changed; fewer: nothing. Rows are events with their place;
    sizes and the last change are pre-aggregated, so a long session is no single group.
    """
    n_before = before.groupBy(session).agg(F.count("*").alias("n_before"))
    end = after.groupBy(session).agg(F.count("*").alias("n_after"), F.max_by(value, place).alias("last"))
    old = before.select(session, place, F.col(value).alias("old_"))
    changed = after.join(old, [session, place]).where(~F.col(value).eqNullSafe(F.col("old_"))).groupBy(session).agg(F.max_by(value, place).alias("changed"))
    out = end.join(n_before, session, "left").join(changed, session, "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    event = F.when(F.col("n_after") > F.col("n_before"), F.col("last")).when(F.col("n_after") == F.col("n_before"), F.col("changed"))
    return out.select(session, event.alias(value)).where(F.col(value).isNotNull())


def snapshot_then_tail(events: DataFrame, seen: DataFrame, session: str = "session_id", version: str = "version") -> DataFrame:
    """What a reader who comes back gets: the events up to the version of the snapshot, then newer ones.

    ``part`` is snapshot or tail. Where the snapshot's last event is terminal nothing follows; else the tail ends with
    the first terminal event.
    """
    known = events.join(seen, session).withColumn("part", F.when(F.col(version) <= F.col("seen"), "snapshot").otherwise("tail"))
    ends = known.groupBy(session).agg(
        F.max_by(F.when(F.col("part") == "snapshot", is_terminal(F.col("type"))), F.when(F.col("part") == "snapshot", F.col(version))).alias("over_"),
        F.min(F.when((F.col("part") == "tail") & is_terminal(F.col("type")), F.col(version))).alias("end_"),
    )
    out = known.join(ends, session)
    follows = ~F.coalesce("over_", F.lit(False)) & (F.col("end_").isNull() | (F.col(version) <= F.col("end_")))
    return out.where((F.col("part") == "snapshot") | follows).drop("over_", "end_", "seen")


def sent(lines: DataFrame, line: str) -> DataFrame:
    """Of complete lines those that begin with ``data:`` and hold JSON, with payload (as it was sent) in place of the line."""
    blanks = F.lit(" \t\r\f\u000b ")
    kept = lines.withColumn(line, F.btrim(line, blanks)).where(F.startswith(line, F.lit("data:")))
    sent = kept.withColumn("payload", F.btrim(F.substring(line, 6, 1 << 30), blanks)).where("payload <> ''")
    return sent.where(is_json(F.col("payload"))).drop(line)


def sse_events(frames: DataFrame, text: str = "text") -> DataFrame:
    """Events of streams of server-sent frames, one row an event: complete lines that begin with ``data:`` and hold JSON.

    Columns of ``frames`` but the text, then place (of the line) and payload (as it was sent). What follows the last
    line break is an unfinished line; blank, other and malformed lines are dropped.
    """
    lines = F.split(F.col(text), "\n", -1)
    rest = [F.col(f"`{c}`") for c in frames.columns if c != text]
    return sent(frames.select(*rest, F.posexplode(F.slice(lines, F.lit(1), F.size(lines) - 1)).alias("place", "line_")), "line_")


def sse_chunks(chunks: DataFrame, stream: str = "stream", seq: str = "seq", data: str = "data", rows: int = ROWS) -> DataFrame:
    """Events of byte streams that arrive in chunks cut anywhere, in the middle of a character too: stream, place (of the line in its stream) and payload.

    A line has the number of line breaks before it in its stream, a sum that goes on from chunk to chunk however a
    stream is dealt. Lines within a chunk are whole; of those that chunks share, each sends its piece, and the pieces of
    a line are joined. Bytes that are no UTF-8 count as replacement characters; what follows a stream's last line break
    is an unfinished line. Null chunks are empty.
    """
    one = F.decode(F.coalesce(F.col(data), F.to_binary(F.lit(""), F.lit("utf-8"))), "ISO-8859-1")  # a character a byte
    cut = chunks.select(F.col(stream).alias("stream_"), F.col(seq).alias("seq_"), F.split(one, "\n", -1).alias("parts_")).withColumn("breaks_", (F.size("parts_") - 1).cast("long"))
    order = ["stream_", "seq_"]
    numbered = running(dealt(cut, order, "chunks", rows), order, F.col("breaks_"))
    base = numbered.groupBy(F.col("stream_").alias("own_")).agg(F.min(F.col("sum_") - F.col("breaks_")).alias("base_"))
    placed = numbered.join(base, F.col("stream_").eqNullSafe(F.col("own_"))).withColumn("from_", F.col("sum_") - F.col("breaks_") - F.col("base_"))
    each = placed.select("stream_", "seq_", "from_", "breaks_", F.posexplode("parts_").alias("i_", "piece_")).withColumn("place", F.col("from_") + F.col("i_"))
    inner = (F.col("i_") > 0) & (F.col("i_") < F.col("breaks_"))
    shared = each.where(~inner).groupBy("stream_", "place").agg(F.array_sort(F.collect_list(F.struct("seq_", "piece_"))).alias("p_"), F.bool_or(F.col("i_") < F.col("breaks_")).alias("ends_"))
    ended = shared.where("ends_").select("stream_", "place", F.array_join(F.transform("p_", lambda x: x["piece_"]), "").alias("piece_"))
    lines = each.where(inner).select("stream_", "place", "piece_").unionByName(ended)
    text = F.make_valid_utf8(F.encode("piece_", "ISO-8859-1").cast("string"))
    return sent(lines.select(F.col("stream_").alias(stream), "place", text.alias("line_")), "line_")


def appended(log: DataFrame, produced: DataFrame, session: str = "session_id", version: str = "version", order: str = "at") -> DataFrame:
    """Events to append: ``produced`` ones with versions that go on from the log's last, in order of production.

    They are written first and delivered from the log, so whoever reads never sees an event that is not kept.
    """
    last = log.groupBy(session).agg(F.max(version).alias("last_"))
    n = F.row_number().over(Window.partitionBy(session).orderBy(order))
    return produced.join(last, session, "left").withColumn(version, (F.coalesce("last_", F.lit(0)) + n).cast("long")).drop("last_")


#: Fixed value: characters of a report that a memory document quotes.
EXCERPT = 3000


def report_excerpt(report: Column) -> Column:
    return shorten(report, EXCERPT)


def last_of(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n events of each key. Ranks are limited before any list is made, in each task first, so a hot key is no large group."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("back_", F.row_number().over(w)).where(F.col("back_") <= n).drop("back_")
