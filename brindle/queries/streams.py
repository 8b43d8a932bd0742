"""Streams over the events table: each runs to the end of what is there, and equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.sources import scratch
from brindle.sources.tables import load
from brindle.streaming import tail as st

from . import windows
from .base import Entry


def _events(spark, sf_dir):
    return st.timed(st.tail(spark, sf_dir, load(spark, sf_dir, "events").schema, files="events.parquet"), "ts", "1 hour")


def _finished(spark, build, name: str):
    root = scratch.folder(spark, name)
    build(f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _tumbling(spark, sf_dir):
    rows = st.windowed(_events(spark, sf_dir), "ts", "6 hours", keys=["event_type"])
    out = _finished(spark, lambda out, at: st.refresh(rows, out, at), "tumbling")
    return out.select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "event_type", "n")


def _filtered(spark, sf_dir):
    rows = _events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    return _finished(spark, lambda out, at: st.append_to(rows, out, at), "filtered")


def _newest(spark, sf_dir):
    rows = st.tail(spark, sf_dir, load(spark, sf_dir, "events").schema, files="events.parquet").select("user_id", "event_id", "event_type")
    root = scratch.folder(spark, "newest")
    st.newest_wins(rows, f"{root}/out", "user_id", ["event_id"], f"{root}/checkpoint").awaitTermination()
    return st.newest_version(spark, f"{root}/out")


def _sliding(spark, sf_dir):
    rows = st.windowed(_events(spark, sf_dir), "ts", "1 day", "12 hours")
    out = _finished(spark, lambda out, at: st.refresh(rows, out, at), "sliding")
    return out.select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "n")


def _sessions(spark, sf_dir):
    rows = st.sessions(_events(spark, sf_dir), "ts", "8 hours", ["user_id"])
    out = _finished(spark, lambda out, at: st.refresh(rows, out, at), "sessions")
    return out.select("user_id", F.col("s_start").cast("timestamp_ntz").alias("s_start"), F.col("s_end").cast("timestamp_ntz").alias("s_end"), "n")


ENTRIES: dict[str, Entry] = {
    "stream_tumbling": Entry(_tumbling, "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w_start, event_type, COUNT(*) AS n FROM events GROUP BY ALL"),
    "stream_filter_append": Entry(_filtered, "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'"),
    "stream_newest_wins": Entry(_newest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "stream_sliding": Entry(_sliding, windows.ENTRIES["time_sliding"].oracle),
    "stream_session": Entry(_sessions, windows.ENTRIES["time_session"].oracle),
}
