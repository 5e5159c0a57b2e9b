"""Streaming jobs over the event table, run over all available data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.evidence_queries import _mod
from catalog.match_queries import RUNS, sql_matched
from catalog.views import (
    BASE_NS, DAY_NS, SQL_MESSAGES, SQL_STATES, memberships, messages, observations, r6, table, ts_ns, with_sql,
)
from trustweave.functions.scoring import missing_aware
from trustweave.sources.stage import stage_root
from trustweave.streaming import jobs


def _event_stream(spark, d):
    """The event file as a stream (the glob matches the one file)."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


END_KEY = -1


def _closed_stream(spark, d):
    """The event stream with its declared end: a control row of no user that moves the
    watermark past all events, so that nothing is left waiting."""
    schema = table(spark, d, "events").schema
    path = f"{stage_root(spark)}/end-{uuid.uuid4().hex}"
    values = {"event_id": F.lit(0), "user_id": F.lit(END_KEY), "event_type": F.lit("end"), "ts": F.lit("2100-01-01 00:00:00").cast("timestamp")}
    end = spark.range(1).select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])
    end.write.parquet(path)
    return _event_stream(spark, d).unionByName(spark.readStream.schema(schema).parquet(path))


def _run(spark, stream):
    path = f"{stage_root(spark)}/stream-{uuid.uuid4().hex}"
    dropped = jobs.run_available(stream, f"{path}/data", f"{path}/checkpoint")
    if dropped:
        raise ValueError(f"{dropped} rows came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stream_states(spark, d):
    """Smoothing and states over the stream: equal to the batch query, row by row."""
    jobs.use_rocksdb(spark)
    rows = observations(spark, d, _closed_stream(spark, d))
    score = missing_aware(
        F.col("kinematic_error_m"), F.col("two_sided_count_residual"),
        F.col("peer_corroboration_score"), F.col("kinematic_applicable"),
    )
    rows = rows.withColumn("risk_score", F.when(F.col("message_present"), score["risk"]))
    buckets = jobs.bucket_count(table(spark, d, "events").count())
    out = _run(spark, jobs.smooth_stream(rows, ["agent_id"], delay="0 seconds", buckets=buckets))
    return out.filter(F.col("agent_id") != str(END_KEY)).select(
        "agent_id", "decision_time_ns", r6("ewma").alias("ewma"), "available",
        "previous_state", "current_state",
    )


SQL_STREAM_STATES = with_sql(SQL_STATES, """
SELECT agent_id, decision_time_ns, round(ewma,6)+0.0 AS ewma, risk_score IS NOT NULL AS available, previous_state, current_state
FROM states""", recursive=True)


def stream_daily_counts(spark, d):
    """Events per day and type in tumbling windows, all closed by the stream's end."""
    rows = _closed_stream(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    out = _run(spark, jobs.windowed_counts(rows, "t", ["event_type"], "1 day", "0 seconds"))
    return out.select(F.unix_micros("start").alias("start_us"), "event_type", "rows")


SQL_STREAM_COUNTS = """SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS rows FROM events
GROUP BY date_trunc('day', ts), event_type"""

SESSION_GAP_S = 6 * 3600


def stream_sessions(spark, d):
    """Activity sessions of each user: rows less than six hours apart belong together."""
    rows = _closed_stream(spark, d).withColumn("t", F.col("ts").cast("timestamp"))
    out = _run(spark, jobs.session_counts(rows, "t", ["user_id"], f"{SESSION_GAP_S} seconds", "0 seconds"))
    return out.filter(F.col("user_id") != END_KEY).select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows"
    )


SQL_STREAM_SESSIONS = f"""WITH t AS (SELECT user_id, epoch_us(ts) AS us FROM events),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w < {SESSION_GAP_S}000000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY user_id ORDER BY us)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(us) AS start_us, max(us) + {SESSION_GAP_S}000000 AS end_us, count(*) AS rows FROM n GROUP BY user_id, session"""


def stream_match(spark, d):
    """As-of matching of two streams; it waits past all lateness, and so equals the batch."""
    jobs.use_rocksdb(spark)
    keys = ["sequence_id", "session_id", "agent_id"]
    _, age, ahead = RUNS["buffered"]
    path = f"{stage_root(spark)}/members-{uuid.uuid4().hex}"
    members = memberships(spark, d)
    end = {"session_id": F.lit(str(END_KEY)), "decision_time_ns": F.lit(BASE_NS + 20_000 * DAY_NS)}
    closing = members.limit(1).select(*[end.get(c, F.col(c)).alias(c) for c in members.columns])
    members.unionByName(closing).write.parquet(path)
    decisions = spark.readStream.schema(members.schema).parquet(path)
    buckets = jobs.bucket_count(spark.read.parquet(path).count() + table(spark, d, "events").count())
    out = _run(spark, jobs.match_stream(
        decisions, messages(spark, d, _closed_stream(spark, d)), keys, max_age_ns=age, lookahead_ns=ahead,
        wait_ns=60 * DAY_NS, delay="0 seconds", buckets=buckets,
    ))
    return out.filter(F.col("session_id") != str(END_KEY)).select(
        "session_id", "agent_id", "sync_frame_id", "reason_code", "source_time_ns", "match_age_ns", "message_present"
    )


SQL_STREAM_MATCH = with_sql(sql_matched("buffered"), """
SELECT session_id, agent_id, sync_frame_id, reason_code, source_time_ns, match_age_ns, message_present FROM matched""")

EXPIRY_NS = 2 * DAY_NS


def stream_reset(spark, d):
    """Smoothing with resets (every fiftieth event) and expiry after two silent days."""
    jobs.use_rocksdb(spark)
    rows = _closed_stream(spark, d).select(
        F.col("user_id").cast("string").alias("agent_id"), ts_ns().alias("decision_time_ns"),
        (_mod("event_id", 50) == 0).alias("reset"), F.when(_mod("event_id", 7) != 0, _mod("event_id", 100) / 100.0).alias("risk_score"),
    )
    buckets = jobs.bucket_count(table(spark, d, "events").count())
    out = _run(spark, jobs.smooth_stream(rows, ["agent_id"], delay="0 seconds", expire_after_ns=EXPIRY_NS, buckets=buckets))
    return out.filter(F.col("agent_id") != str(END_KEY)).select("agent_id", "decision_time_ns", r6("ewma").alias("ewma"), "available", "previous_state", "current_state")


SQL_STREAM_RESET = f"""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS agent_id, epoch_us(ts)*1000 AS t, event_id%50=0 AS reset,
  CASE WHEN event_id%7<>0 THEN (event_id%100)/100.0::DOUBLE END AS v FROM events),
g AS (SELECT *, CASE WHEN reset OR t-lag(t) OVER w > {EXPIRY_NS} THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY agent_id ORDER BY t)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY agent_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY agent_id, seg ORDER BY t) AS rn FROM s WHERE NOT reset),
walk AS (SELECT agent_id, seg, rn, t, v, v AS e FROM n WHERE rn=1
 UNION ALL SELECT n.agent_id, n.seg, n.rn, n.t, n.v, CASE WHEN n.v IS NULL THEN w.e WHEN w.e IS NULL THEN n.v ELSE 0.3::DOUBLE*n.v+0.7::DOUBLE*w.e END
 FROM walk w JOIN n ON n.agent_id=w.agent_id AND n.seg=w.seg AND n.rn=w.rn+1),
l AS (SELECT *, CASE WHEN v IS NULL THEN 'unknown' WHEN e>=0.25 THEN 'quarantined' ELSE 'normal' END AS current_state FROM walk)
SELECT agent_id, t AS decision_time_ns, round(e,6)+0.0 AS ewma, v IS NOT NULL AS available,
 coalesce(lag(current_state) OVER (PARTITION BY agent_id, seg ORDER BY t), 'unknown') AS previous_state, current_state FROM l"""


def _doubled(spark, d):
    """Messages whose every third one is sent twice."""
    sent = messages(spark, d, _closed_stream(spark, d))
    twice = messages(spark, d, _event_stream(spark, d).filter(_mod("event_id", 3) == 0))
    return sent.unionByName(twice)


MESSAGE = ["session_id", "agent_id"]


def stream_distinct(spark, d):
    """The first copy of every source message."""
    out = _run(spark, jobs.distinct_messages(_doubled(spark, d), MESSAGE, "1 hour"))
    return out.filter(F.col("session_id") != str(END_KEY)).select(*MESSAGE, "source_time_ns", "arrival_time_ns")


SQL_STREAM_DISTINCT = with_sql(SQL_MESSAGES, "SELECT session_id, agent_id, source_time_ns, min(arrival_time_ns) AS arrival_time_ns FROM messages GROUP BY ALL")


def stream_copies(spark, d):
    """The side count: copies of source messages by day of arrival."""
    out = _run(spark, jobs.message_copies(_doubled(spark, d), MESSAGE, "1 day", "1 hour"))
    kept = out.filter(F.col("session_id") != str(END_KEY))
    return kept.groupBy(F.unix_micros("start").alias("start_us"), "agent_id").agg(F.sum("duplicates").alias("duplicates"))


SQL_STREAM_COPIES = """SELECT epoch_us(date_trunc('day', ts + to_seconds((event_id*7919)%21600))) AS start_us, event_type AS agent_id,
 count(*) FILTER (WHERE event_id%3=0) AS duplicates FROM events GROUP BY 1,2"""


def stream_admitted_bytes(spark, d):
    """Streamed packets against static sender states: bytes per decision."""
    states = table(spark, d, "events").select(F.col("user_id").cast("string").alias("agent_id")).distinct()
    states = states.withColumn("current_state", F.when(_mod(F.col("agent_id").cast("bigint"), 3) == 0, "quarantined").otherwise("normal"))
    packets = observations(spark, d, _event_stream(spark, d)).filter("message_present and not is_ego").select(
        "event_id", "agent_id", "decision_time_ns", "source_time_ns",
        (F.lit(300) + _mod("event_id", 7)).cast("bigint").alias("measured_size_bytes"),
    )
    gated = jobs.admit_stream(packets, states, ["agent_id"], max_source_age_ns=100_000_000, check_integrity=False)
    out = _run(spark, gated.select("policy", "reason_code", "admitted_bytes"))
    return jobs.byte_counts(out)


SQL_STREAM_BYTES = """WITH p AS (SELECT event_id, user_id%3<>0 AS normal, event_id%140<=100 AS fresh, 300+event_id%7 AS size FROM events WHERE event_id%19<>0 AND event_id%8<>3),
s AS (SELECT *, CASE WHEN NOT fresh THEN 'late' WHEN policy='hard_gate' AND NOT normal THEN 'hard_gated' ELSE 'admitted' END AS reason_code FROM p, (SELECT unnest(['full_share','hard_gate']) AS policy))
SELECT policy, reason_code, count(*) AS packets, sum(CASE WHEN reason_code='admitted' THEN size ELSE 0 END)::BIGINT AS admitted_bytes FROM s GROUP BY 1,2"""

QUERIES = {
    "stream_states": (stream_states, SQL_STREAM_STATES),
    "stream_daily_counts": (stream_daily_counts, SQL_STREAM_COUNTS),
    "stream_sessions": (stream_sessions, SQL_STREAM_SESSIONS),
    "stream_match": (stream_match, SQL_STREAM_MATCH),
    "stream_reset": (stream_reset, SQL_STREAM_RESET),
    "stream_distinct": (stream_distinct, SQL_STREAM_DISTINCT),
    "stream_copies": (stream_copies, SQL_STREAM_COPIES),
    "stream_admitted_bytes": (stream_admitted_bytes, SQL_STREAM_BYTES),
}
