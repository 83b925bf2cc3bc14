"""Sessions of users and joins of two streams, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Stretches of a user's events without a pause of ``gap``: user_id, began, ended (the last event and the gap) and n.

    Of a stream a session is told of when the watermark, ``late`` behind the latest event, has passed its end; rows
    later than that are left out. Of a table (``late`` None) all are.
    """
    own = events if late is None else events.withWatermark("ts", late)
    found = own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    """Pairs of a row of ``first`` and one of ``second`` of the same user that comes at most ``within`` later: user_id, first_id and second_id.

    Of streams both sides are watermarked, so that rows are kept only as long as a partner may come.
    """
    a = first.select(F.col("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("at"))
    b = second.select(F.col("user_id").alias("user_"), F.col("event_id").alias("second_id"), F.col("ts").alias("then"))
    if late is not None:
        a, b = a.withWatermark("at", late), b.withWatermark("then", late)
    met = (F.col("user_id") == F.col("user_")) & (F.col("then") >= F.col("at")) & (F.col("then") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, met).select("user_id", "first_id", "second_id")
