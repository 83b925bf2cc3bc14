"""The event log as a stream: compaction with state by session, and its snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import CHUNK, COMPLETE, TERMINAL, sent
from ..operators.uploads import TTL_SECONDS

OUT = "session_id long, seq long, type string, content string, n_merged long, live boolean, part long"
_STATE = "seq long, n long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows to put, and (live false) to take back. The state is the place and length of the chunk run that may still grow.

    Of a run a batch emits what it adds, with the number of chunks before it as ``part``, so neither state nor output
    grows with what was emitted before.
    """
    rows = pd.concat(list(frames)).sort_values("seq")
    run = list(map(int, state.get)) if state.exists else None
    added: list[str] = []
    out: list[tuple] = []

    def emit() -> None:
        if added:
            out.append((key[0], run[0], CHUNK, "".join(added), run[1], True, run[1] - len(added)))
            added.clear()

    for seq, kind, content in zip(rows["seq"], rows["type"], rows["content"], strict=True):
        if kind == CHUNK:
            run = [run[0], run[1] + 1] if run else [int(seq), 1]
            added.append(content or "")
            continue
        emit()
        if kind == COMPLETE and run:
            out.append((key[0], run[0], CHUNK, "", run[1], False, run[1]))
        run = None
        out.append((key[0], int(seq), kind, content or "", 1, True, 0))
    emit()
    if run:
        state.update(tuple(run))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])


def compact_stream(events: DataFrame) -> DataFrame:
    """Stream of changes to the compacted log; ``events`` has session_id, seq, type, content, in order by session."""
    return events.groupBy("session_id").applyInPandasWithState(_advance, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def snapshot(changes: DataFrame) -> DataFrame:
    """The log that changes add up to: the parts of each event joined in order, unless it was taken back."""
    parts = F.array_sort(F.collect_list(F.struct("part", "content")))
    per = changes.groupBy("session_id", "seq").agg(F.first("type").alias("type"), F.array_join(F.transform(parts, lambda x: x["content"]), "").alias("content"), F.max("n_merged").alias("n_merged"), F.bool_and("live").alias("live"))
    return per.where("live").drop("live")


def _lines(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Lines that a batch of chunks completes. The state is the unfinished end of the stream and how many lines came before."""
    rest, place = (bytes(state.get[0]), state.get[1]) if state.exists else (b"", 0)
    rows = pd.concat(list(frames)).sort_values("seq")
    *lines, rest = (rest + b"".join(bytes(x) for x in rows["data"] if x is not None)).split(b"\n")
    state.update((rest, place + len(lines)))
    yield pd.DataFrame({"stream": [key[0]] * len(lines), "place": range(place, place + len(lines)), "line": lines})


def sse_stream(chunks: DataFrame) -> DataFrame:
    """Events of byte streams as their chunks come in: stream, place and payload, as ``events.sse_chunks`` has them.

    ``chunks`` has stream (a long), seq and data (binary); a stream's chunks come in order from batch to batch.
    """
    lines = chunks.select("stream", "seq", "data").groupBy("stream").applyInPandasWithState(_lines, "stream long, place long, line binary", "rest binary, place long", "append", GroupStateTimeout.NoTimeout)
    return sent(lines.withColumn("line", F.make_valid_utf8(F.col("line").cast("string"))), "line")


_TAIL = "session_id long, version long, type string, part string"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a reader is sent of a batch of a session's events. The state is the last version, and whether the stream is over."""
    last, over = state.get if state.exists else (-(2**63), False)
    out = []
    for version, kind, seen in pd.concat(list(frames)).sort_values("version")[["version", "type", "seen"]].itertuples(index=False):
        if version <= last:  # sent before
            continue
        last = int(version)
        if version <= seen:
            out.append((key[0], last, kind, "snapshot"))
            over = kind in TERMINAL  # that of the snapshot's last event counts
        elif not over:
            out.append((key[0], last, kind, "tail"))
            over = kind in TERMINAL
    state.update((last, bool(over)))
    yield pd.DataFrame(out, columns=["session_id", "version", "type", "part"])


def live_tail(log: DataFrame, seen: DataFrame) -> DataFrame:
    """What readers who come back are sent while the log grows: the snapshot up to the version they have seen, then newer events up to the first terminal one.

    ``log`` is a stream of session_id, version and type, a session's versions in order from batch to batch; ``seen`` has
    session_id and seen. A version that comes again is sent once. With all batches taken together it is ``snapshot_then_tail``.
    """
    known = log.select("session_id", "version", "type").join(seen.select("session_id", "seen"), "session_id")
    return known.groupBy("session_id").applyInPandasWithState(_follow, _TAIL, "last long, over boolean", "append", GroupStateTimeout.NoTimeout)


#: Groups that uploads are dealt over; each has one timer and a state of the uploads it waits for (16 bytes each).
BUCKETS = 512


def _expire(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Verdicts on the folders of one group of uploads. The state is when each was made; the timer is when the first expires."""
    live = dict(np.frombuffer(state.get[0], np.int64).reshape(-1, 2).tolist()) if state.exists else {}
    passed, out = state.getCurrentWatermarkMs() // 1000, []
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values("at")
        if pd.isna(key[0]):  # rows without an upload only tell the time
            return
        passed = max(passed, int(rows["now_"].max()))
        for upload, manifest, created in rows[["upload_id", "manifest", "created_"]].itertuples(index=False):
            live.pop(int(upload), None)
            if pd.isna(created):
                out.append((int(upload), "remove_missing" if manifest is None or pd.isna(manifest) else "remove_corrupt"))
            else:
                live[int(upload)] = int(created)
    out += [(upload, "expired") for upload, created in live.items() if created + TTL_SECONDS < passed]
    live = {upload: created for upload, created in live.items() if created + TTL_SECONDS >= passed}
    if live:
        state.update((np.array(list(live.items()), np.int64).tobytes(),))
        state.setTimeoutTimestamp(max((min(live.values()) + TTL_SECONDS) * 1000, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["upload_id", "verdict"])


def expiring(folders: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Upload folders to remove, as their time comes: upload_id and verdict (remove_missing, remove_corrupt, expired).

    ``folders`` is a stream of upload_id (a long), manifest and at, the time of the row; rows without an upload tell the
    time only, so a clock that ticks is enough for uploads to expire: each group of them has a timer, set to its first
    one's end, and nothing else has to come in for it. Broken folders are told of at once.
    """
    made = F.from_json("manifest", "upload_id string, created_at string, size long")["created_at"]
    rows = folders.withWatermark("at", late).select(F.pmod("upload_id", F.lit(BUCKETS)).alias("group_"), "upload_id", "manifest", "at", F.unix_timestamp(F.try_to_timestamp(made)).cast("double").alias("created_"), F.unix_timestamp("at").alias("now_"))
    return rows.groupBy("group_").applyInPandasWithState(_expire, "upload_id long, verdict string", "uploads binary", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: events by type in windows of event time, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
