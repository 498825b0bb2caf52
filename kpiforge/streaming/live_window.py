"""Conversation windows kept live from a stream of messages (R7; the reference's chat is an online path).

``live_windows(stream)`` holds, for each conversation, its last messages in
state and gives the row of :func:`kpiforge.operators.history.history_summary`
anew whenever one of them changes.  Messages may come in any order and in any
batch: a late turn takes its place by its number, and one that is older than
all that are kept changes nothing.  State holds ``max_messages`` messages of a
conversation at most, whatever its length; with ``idle`` a conversation without
messages for that long is forgotten.

A batch hands a conversation's rows over in pieces (Arrow batches), so a
conversation that fills a batch is never one frame in memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kpiforge.operators.history import MAX_TURNS, SUMMARY_CHARS, SUMMARY_TURNS
from kpiforge.sources.tables import newest_version

_STATE = "turns array<long>, roles array<string>, texts array<string>"


def _line(role, text, most: int) -> str:
    text = text or ""
    return f"{'User' if role == 'user' else 'Bot'}: {text[:most] + '...' if len(text) > most else text}"


def live_windows(stream: DataFrame, max_messages: int = 2 * MAX_TURNS, summary_messages: int = 2 * SUMMARY_TURNS,
                 max_chars: int = SUMMARY_CHARS, idle: int | None = None) -> DataFrame:
    """``conv_id, kept_messages, first_kept_turn, summary`` of each conversation that changed; ``idle``: seconds."""
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = [tuple(m) for m in zip(*state.get)] if state.exists else []
        before = list(kept)
        for frame in frames:
            new = [(int(t), r, x) for t, r, x in zip(frame["turn"], frame["role"], frame["text"]) if pd.notna(t)]
            kept = heapq.nlargest(max_messages, kept + new, key=lambda m: (m[0], m[1] or "", m[2] or ""))[::-1]
        if kept and kept != before:
            state.update(tuple([m[k] for m in kept] for k in range(3)))
            yield pd.DataFrame({"conv_id": [key[0]], "kept_messages": [len(kept)], "first_kept_turn": [kept[0][0]],
                                "summary": ["\n".join(_line(r, x, max_chars) for _, r, x in kept[-summary_messages:])]})
        if idle:
            state.setTimeoutDuration(idle * 1000)

    return stream.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("turn IS NOT NULL").groupBy("conv_id").applyInPandasWithState(
        follow, "conv_id long, kept_messages long, first_kept_turn long, summary string", _STATE, "update",
        GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def start_windows(stream: DataFrame, sink_path: str, checkpoint_location: str, **options) -> StreamingQuery:
    """Write what changes in each batch to ``sink_path/version=N``; both folders must be shared.  A batch that runs again after a
    failure writes the same folder again."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/version={epoch}")

    return (live_windows(stream, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint_location)
            .foreachBatch(write).trigger(availableNow=True).start())


def current_windows(spark: SparkSession, sink_path: str) -> DataFrame:
    """The newest row of each conversation in a sink."""
    last = newest_version(spark, sink_path)
    if last < 0:
        raise FileNotFoundError(f"no complete batch below {sink_path}")
    rows = spark.read.option("basePath", sink_path).parquet(sink_path).where(F.col("version") <= last)
    names = ["kept_messages", "first_kept_turn", "summary"]
    return rows.groupBy("conv_id").agg(F.max_by(F.struct(*names), "version").alias("now")).select("conv_id", *[f"now.{c}" for c in names])
