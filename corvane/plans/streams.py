"""Queries that run a stream to its end and return what it has written."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.registry import query
from corvane.plans.state import _STATE, state_events
from corvane.streaming import ingest as S
from corvane.streaming.scratch import scratch


@query("stream_turn_ingest", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def stream_turn_ingest(spark, d):
    """Turns through the ledger, twice: the second run finds nothing new."""
    path, root = f"{d}/conversations.parquet", scratch(spark, "turn-ledger")
    for run in range(2):
        S.ingest_turns(S.read_stream(spark, path), f"{root}/ledger", f"{root}/checkpoint-{run}", ["conv_id", "role", "text"], ["turn"])
    return spark.read.option("basePath", f"{root}/ledger").parquet(f"{root}/ledger").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("stream_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    root = scratch(spark, "windows")
    S.windowed_counts(S.read_stream(spark, f"{d}/events.parquet"), f"{root}/out", f"{root}/checkpoint", "ts", "event_type", "1 hour", "1 day")
    return S.read_latest(spark, f"{root}/out", ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_temporal_state", _STATE + " SELECT * FROM state")
def stream_temporal_state(spark, d):
    root = scratch(spark, "state")
    events = state_events(None, None, S.read_stream(spark, f"{d}/events.parquet"))
    S.running_state(events, f"{root}/out", f"{root}/checkpoint")
    return S.read_latest(spark, f"{root}/out", ["node_id"])
