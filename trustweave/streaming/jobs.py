"""Streaming jobs with the batch rules.

Nanosecond columns stay integers; a microsecond timestamp derived from them drives
the watermark only. Stateful jobs hold rows until the watermark has passed them and
then handle them in time order, so micro-batch boundaries cannot change a result.
They need the RocksDB state store provider (see :func:`use_rocksdb`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustweave.operators.messaging import admit
from trustweave.operators.ordered import int_div
from trustweave.operators.temporal import Smoothing
from trustweave.streaming.processors import (
    MatchManyProcessor, MatchProcessor, SmoothManyProcessor, SmoothProcessor,
)


#: Rows of a bucket of keys, see :func:`bucket_count`: a few MB in a task.
BUCKET_ROWS = 20_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def event_time(ns: Column) -> Column:
    """First microsecond timestamp at or after a nanosecond time, in integers."""
    micros = int_div(ns, 1000) + F.when(ns % 1000 > 0, 1).otherwise(0)
    return F.timestamp_micros(micros)


def bucket_count(rows: int) -> int:
    """Buckets for a stream of about so many rows in state.

    Each key with its own state costs calls between Spark and Python whose number grows with
    the keys. Many keys with few rows each are dealt to buckets, with one state and one timer
    for all keys of a bucket; each timer reads the bucket's rows. A checkpoint keeps its number
    of buckets for good.
    """
    return max(32, -(-rows // BUCKET_ROWS))


def _by_state(rows: DataFrame, keys: list[str], buckets: int | None):
    if buckets is None:
        return rows.groupBy(*keys)
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def smooth_stream(
    observations: DataFrame, keys: list[str], value: str = "risk_score",
    config: Smoothing = Smoothing(), *, delay: str, expire_after_ns: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Smoothing and state labels per key over a stream.

    ``observations``: string keys, ``decision_time_ns``, the value, and optionally a
    boolean ``reset`` whose row clears its key. A key that has been silent longer
    than ``expire_after_ns`` starts anew, and its state is removed by then. ``delay`` is how far rows may be behind the
    newest; rows behind it are dropped by the watermark and counted by ``run_available``.
    With ``buckets`` keys are dealt to so many, see :func:`bucket_count`.
    """
    reset = F.coalesce("reset", F.lit(False)) if "reset" in observations.columns else F.lit(False)
    rows = observations.select(
        *keys, "decision_time_ns", F.col(value).alias("value"), reset.alias("reset"),
        event_time(F.col("decision_time_ns")).alias("event_time"),
    ).withWatermark("event_time", delay)
    schema = ", ".join(f"{k} string" for k in keys) + (
        ", decision_time_ns bigint, value double, ewma double, available boolean, "
        "previous_state string, current_state string"
    )
    processor = SmoothProcessor if buckets is None else SmoothManyProcessor
    return _by_state(rows, keys, buckets).transformWithStateInPandas(
        processor(keys, config.alpha, config.threshold, config.initial_value, expire_after_ns),
        schema, "Append", "eventTime",
    )


def match_stream(
    memberships: DataFrame, messages: DataFrame, keys: list[str], *, max_age_ns: int,
    lookahead_ns: int = 0, wait_ns: int = 0, forget_after_ns: int | None = None, delay: str,
    buckets: int | None = None,
) -> DataFrame:
    """As-of matching over two streams; late messages are classified, not dropped.

    A decision is settled ``wait_ns`` after its look-ahead has ended, with every
    message that has arrived by then. A longer wait recognises later arrivals as
    ``late``; it never changes which message matches. A decision that no message has
    reached by its settling is ``missing_message``, where a batch over the whole history
    may say ``unmatched``. Rows behind ``delay`` are counted by ``run_available``.

    Messages that no decision to come can need leave the state, but for the newest. A sender
    without any row for ``forget_after_ns`` is forgotten: what it sent counts as never sent.
    With ``buckets`` keys are dealt to so many, see :func:`bucket_count`; then none is forgotten.
    """
    if forget_after_ns is not None and buckets is not None:
        raise ValueError("senders are forgotten only where each has its own state")
    if forget_after_ns is not None and forget_after_ns < max_age_ns + lookahead_ns + wait_ns:
        raise ValueError("a sender can't be forgotten while its messages may still match")
    none = F.lit(None)
    unused = F.lit(-1).cast("bigint")  # a null would turn its column, and the others' values, into doubles
    left = memberships.select(
        *keys, F.lit(True).alias("is_decision"), "sync_frame_id",
        F.col("decision_time_ns").alias("time_ns"), unused.alias("arrival_ns"),
        "member", "message_expected",
        none.cast("boolean").alias("empty_scene"), none.cast("boolean").alias("pose_valid"),
        event_time(F.col("decision_time_ns") + (lookahead_ns + wait_ns)).alias("event_time"),
    ).withWatermark("event_time", delay)
    right = messages.select(
        *keys, F.lit(False).alias("is_decision"), unused.alias("sync_frame_id"),
        F.col("source_time_ns").alias("time_ns"), F.col("arrival_time_ns").alias("arrival_ns"),
        none.cast("boolean").alias("member"), none.cast("boolean").alias("message_expected"),
        "empty_scene", "pose_valid",
        event_time(F.col("arrival_time_ns")).alias("event_time"),
    ).withWatermark("event_time", delay)
    # each side has its own watermark, so the slower stream holds back the answers
    rows = left.unionByName(right)
    schema = ", ".join(f"{k} string" for k in keys) + (
        ", sync_frame_id bigint, decision_time_ns bigint, source_time_ns bigint, "
        "match_age_ns bigint, message_present boolean, reason_code string"
    )
    if buckets is None:
        processor = MatchProcessor(keys, max_age_ns, lookahead_ns, wait_ns, forget_after_ns)
    else:
        processor = MatchManyProcessor(keys, max_age_ns, lookahead_ns, wait_ns)
    return _by_state(rows, keys, buckets).transformWithStateInPandas(processor, schema, "Append", "eventTime")


def admit_stream(packets: DataFrame, states: DataFrame, keys: list[str], **options) -> DataFrame:
    """Admission of streamed packets against a static table of sender states."""
    known = packets.join(states.select(*keys, "current_state"), keys, "left")
    return admit(known, **options)


def byte_counts(schedule: DataFrame) -> DataFrame:
    """Admitted packets and bytes per policy and reason, for use in ``foreachBatch``."""
    return schedule.groupBy("policy", "reason_code").agg(
        F.count("*").alias("packets"), F.sum("admitted_bytes").alias("admitted_bytes")
    )


def distinct_messages(messages: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """First copy of every source message within the watermark."""
    timed = messages.withColumn("event_time", event_time(F.col("arrival_time_ns")))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(
        [*keys, "source_time_ns"]
    )


def message_copies(messages: DataFrame, keys: list[str], width: str, delay: str) -> DataFrame:
    """Side count to :func:`distinct_messages`: copies per source message and window of arrival."""
    timed = messages.withColumn("event_time", event_time(F.col("arrival_time_ns")))
    return timed.withWatermark("event_time", delay).groupBy(
        F.window("event_time", width), *keys, "source_time_ns"
    ).agg((F.count("*") - 1).alias("duplicates")).select("window.start", *keys, "source_time_ns", "duplicates")


def windowed_counts(rows: DataFrame, time: str, by: list[str], width: str, delay: str,
                    slide: str | None = None) -> DataFrame:
    """Rows per (sliding) time window and group."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width, slide), *by).agg(
        F.count("*").alias("rows")
    ).select("window.start", "window.end", *by, "rows")


def session_counts(rows: DataFrame, time: str, by: list[str], gap: str, delay: str) -> DataFrame:
    """Rows per activity session and group."""
    return rows.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(
        F.count("*").alias("rows")
    ).select("session_window.start", "session_window.end", *by, "rows")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Run a stream over all data that is available now, into Parquet, and stop.

    Returns the number of rows that stateful steps dropped as later than the watermark.
    """
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sum(
        step["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for step in progress["stateOperators"]
    )
