"""Sensor-like views of the generic benchmark tables, in Spark and in SQL.

Every view exists twice, once as a DataFrame and once as a SQL common table
expression with the same integer arithmetic, so that results can be compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trustweave.operators.ordered import densest_rows, slot_for

BASE_NS = 1_704_067_200_000_000_000  # 2024-01-01T00:00:00Z
DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000
# Rows of one key share a task only within a slot: ten days, or less where days are full.
WIDEST_SLOT_NS, SLOT_ROWS = 10 * DAY_NS, 1_000_000
TYPES = ("click", "view", "purchase", "signup", "error")


# Larger methods are never compiled to machine code by the JVM. Spark splits up those of
# steps that it doesn't fuse, so it is told not to fuse steps beyond this size.
COMPILED_METHOD_BYTES = 8000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_width(spark: SparkSession, d: str) -> int:
    """Slot width by a time histogram: even if the fullest day were all one key's, a slot
    would hold about ``SLOT_ROWS`` rows of a key."""
    densest = densest_rows(table(spark, d, "events").select(ts_ns().alias("t")), "t", DAY_NS)
    return min(WIDEST_SLOT_NS, slot_for(densest, DAY_NS, SLOT_ROWS))


# Rows that one task unfolds from the users it has.
UNFOLDED_ROWS = 200_000
# Rows that a user's boxes may unfold to: two boxes, five senders, up to nine cells.
BOX_ROWS = 2 * 5 * 9


def users(spark: SparkSession, d: str, rows_each: int) -> DataFrame:
    """Distinct user ids, to be unfolded to so many rows each. They are few bytes, which AQE
    would gather in a task or two, so they are dealt over parts by the rows to come."""
    ids = table(spark, d, "events").select("user_id")
    n = ids.agg(F.approx_count_distinct("user_id")).first()[0]
    return ids.distinct().repartition(max(1, math.ceil(n * rows_each / UNFOLDED_ROWS)), "user_id")


def ts_ns(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) * 1000


def _mod(c, n):
    return F.pmod(c if isinstance(c, Column) else F.col(c), F.lit(n))


def r6(c: Column | str) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


# -- messages and memberships ----------------------------------------------------

def messages(spark, d, events: DataFrame | None = None) -> DataFrame:
    ns = ts_ns()
    return (table(spark, d, "events") if events is None else events).select(
        F.lit("seq").alias("sequence_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("agent_id"),
        ns.alias("source_time_ns"),
        (ns + _mod(F.col("event_id") * 7919, 21600) * 1_000_000_000).alias("arrival_time_ns"),
        (_mod("event_id", 17) == 0).alias("empty_scene"),
        (_mod("event_id", 13) != 0).alias("pose_valid"),
        F.when(_mod("event_id", 3) != 0, ns - 1_000_000_000).alias("pose_source_time_ns"),
    )


def memberships(spark, d) -> DataFrame:
    """Every user x (five event types and one silent agent) x thirty days."""
    names = (*TYPES, "beacon")
    agents = F.explode(F.array(*[F.lit(t) for t in names])).alias("agent_id")
    rows = users(spark, d, len(names) * 30).select("user_id", agents).select(
        "user_id", "agent_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("day")
    )
    member = (_mod(F.col("user_id") * F.col("day"), 29) != 0) | (F.col("day") == 0)
    return rows.select(
        F.lit("seq").alias("sequence_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("day").alias("sync_frame_id"),
        (F.lit(BASE_NS) + F.col("day") * DAY_NS).alias("decision_time_ns"),
        "agent_id",
        member.alias("member"),
        (member & (_mod(F.col("user_id") + F.col("day"), 11) != 0)).alias("message_expected"),
    )


SQL_MESSAGES = """messages AS (
  SELECT 'seq' AS sequence_id, user_id::VARCHAR AS session_id, event_type AS agent_id,
    epoch_us(ts)*1000 AS source_time_ns,
    epoch_us(ts)*1000 + ((event_id*7919)%21600)*1000000000 AS arrival_time_ns,
    event_id%17=0 AS empty_scene, event_id%13<>0 AS pose_valid,
    CASE WHEN event_id%3<>0 THEN epoch_us(ts)*1000-1000000000 END AS pose_source_time_ns
  FROM events)"""

SQL_MEMBERSHIPS = f"""memberships AS (
  SELECT 'seq' AS sequence_id, user_id::VARCHAR AS session_id, day AS sync_frame_id,
    {BASE_NS} + day*{DAY_NS} AS decision_time_ns, agent_id,
    ((user_id*day)%29<>0 OR day=0) AS member,
    ((user_id*day)%29<>0 OR day=0) AND (user_id+day)%11<>0 AS message_expected
  FROM (SELECT DISTINCT user_id FROM events) u,
       (SELECT unnest(['click','view','purchase','signup','error','beacon']) AS agent_id) a,
       (SELECT unnest(range(30)) AS day) dd)"""


# -- odometry --------------------------------------------------------------------

def odometry(spark, d, agent: Column | None = None) -> DataFrame:
    yaw = _mod(F.col("event_id") * 37, 628) / 100.0
    half = yaw / 2.0
    zero = F.lit(0.0)
    return table(spark, d, "events").select(
        (F.col("user_id").cast("string") if agent is None else agent).alias("agent_id"),
        ts_ns().alias("time_ns"),
        F.struct(
            F.col("value").alias("x"), (_mod("event_id", 100) / 10.0).alias("y"), zero.alias("z")
        ).alias("position_m"),
        F.struct(
            zero.alias("x"), zero.alias("y"), F.sin(half).alias("z"), F.cos(half).alias("w")
        ).alias("quaternion_xyzw"),
        F.struct(
            (F.col("value") / 10000.0).alias("x"), (_mod("event_id", 7) / 1000.0).alias("y"),
            zero.alias("z"),
        ).alias("body_velocity_mps"),
    )


SQL_ODOMETRY = """odometry AS (
  SELECT user_id::VARCHAR AS agent_id, epoch_us(ts)*1000 AS time_ns, event_id,
    value AS px, (event_id%100)/10.0::DOUBLE AS py,
    ((event_id*37)%628)/100.0::DOUBLE AS yaw,
    value/10000.0::DOUBLE AS vx, (event_id%7)/1000.0::DOUBLE AS vy
  FROM events)"""


# -- points and boxes ------------------------------------------------------------

def points(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        _mod("l_orderkey", 1000).alias("frame"), _mod("l_suppkey", 5).alias("agent"),
        (F.col("l_quantity") - 25).alias("x"),
        (F.col("l_discount") * 100 - 5).alias("y"),
        (F.col("l_tax") * 100 - 4).alias("z"),
        "l_orderkey", "l_partkey", "l_linenumber",
    )


def boxes(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        _mod(key, 1000).alias("frame"), key.alias("box"),
        (F.col("p_size") - 25).cast("double").alias("center_x_m"),
        (_mod(key, 10) - 5).cast("double").alias("center_y_m"),
        (_mod(key, 8) - 4).cast("double").alias("center_z_m"),
        (_mod(key, 9) + 1).cast("double").alias("size_x_m"),
        (_mod(key, 7) + 1).cast("double").alias("size_y_m"),
        (_mod(key, 5) + 1).cast("double").alias("size_z_m"),
        (_mod(key * 13, 314) / 100.0).alias("yaw_rad"),
    )


SQL_POINTS = """points AS (
  SELECT l_orderkey%1000 AS frame, l_suppkey%5 AS agent, l_quantity-25 AS x,
    l_discount*100-5 AS y, l_tax*100-4 AS z FROM lineitem)"""

SQL_BOXES = """boxes AS (
  SELECT p_partkey%1000 AS frame, p_partkey AS box, (p_size-25)::DOUBLE AS cx,
    (p_partkey%10-5)::DOUBLE AS cy, (p_partkey%8-4)::DOUBLE AS cz,
    (1+p_partkey%9)::DOUBLE AS sx, (1+p_partkey%7)::DOUBLE AS sy,
    (1+p_partkey%5)::DOUBLE AS sz, ((p_partkey*13)%314)/100.0::DOUBLE AS yaw FROM part)"""


def sql_inside(p: str = "p", b: str = "b") -> str:
    """The exact inside test, for a join condition."""
    dx, dy = f"({p}.x-{b}.cx)", f"({p}.y-{b}.cy)"
    return (
        f"abs(cos({b}.yaw)*{dx}+sin({b}.yaw)*{dy})<={b}.sx/2+1e-6 AND "
        f"abs(cos({b}.yaw)*{dy}-sin({b}.yaw)*{dx})<={b}.sy/2+1e-6 AND "
        f"abs({p}.z-{b}.cz)<={b}.sz/2+1e-6"
    )


def agent_boxes(spark, d) -> DataFrame:
    """Each box once per agent 0..4, with the eligibility of that agent."""
    rows = boxes(spark, d).withColumn(
        "agent", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))
    )
    return rows.withColumn("eligible", _mod(F.col("box") + F.col("agent"), 6) != 0)


SQL_COUNTS = f"""{SQL_POINTS}, {SQL_BOXES},
hits AS (SELECT b.box, p.agent, count(*) AS n FROM points p JOIN boxes b
  ON p.frame=b.frame AND {sql_inside()} GROUP BY ALL),
counts AS (SELECT b.frame, b.box, a.agent, coalesce(h.n,0) AS point_count,
    (b.box+a.agent)%6<>0 AS eligible
  FROM boxes b CROSS JOIN (SELECT unnest(range(5)) AS agent) a
  LEFT JOIN hits h ON h.box=b.box AND h.agent=a.agent)"""


def event_points(spark, d) -> DataFrame:
    """Points with a unique id: one per event, frame = user."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("frame"), "event_id",
        (F.col("value") / 10.0).alias("x"),
        (_mod("event_id", 100) / 10.0 - 5).alias("y"),
        (_mod("event_id", 8) - 4).cast("double").alias("z"),
        _mod("event_id", 4000).cast("double").alias("intensity"),
        _mod("event_id", 16).cast("int").alias("ring"),
    )


SQL_EVENT_POINTS = """event_points AS (
  SELECT user_id AS frame, event_id, value/10.0::DOUBLE AS x,
    (event_id%100)/10.0::DOUBLE-5 AS y, (event_id%8-4)::DOUBLE AS z,
    (event_id%4000)::DOUBLE AS intensity, (event_id%16)::INTEGER AS ring FROM events)"""


def event_boxes(spark, d) -> DataFrame:
    """One box per user around the origin, as the target of point overlays."""
    ids = users(spark, d, BOX_ROWS).withColumnRenamed("user_id", "frame")
    return ids.select(
        F.concat(F.lit("v"), F.col("frame").cast("string")).alias("variant_id"), "frame",
        _mod("frame", 3).cast("double").alias("center_x_m"),
        (_mod("frame", 5) - 2).cast("double").alias("center_y_m"),
        F.lit(-1.0).alias("center_z_m"),
        (_mod("frame", 4) + 3).cast("double").alias("size_x_m"),
        (_mod("frame", 3) + 4).cast("double").alias("size_y_m"),
        F.lit(5.0).alias("size_z_m"),
        (_mod(F.col("frame") * 7, 31) / 10.0).alias("yaw_rad"),
        _mod("frame", 97).alias("seed"),
        (_mod("frame", 4) / 3.0).alias("removal_fraction"),
        _mod("frame", 6).alias("n_add"),
    )


SQL_EVENT_BOXES = """event_boxes AS (
  SELECT 'v'||frame::VARCHAR AS variant_id, frame, (frame%3)::DOUBLE AS cx,
    (frame%5-2)::DOUBLE AS cy, -1.0::DOUBLE AS cz, (3+frame%4)::DOUBLE AS sx,
    (4+frame%3)::DOUBLE AS sy, 5.0::DOUBLE AS sz, ((frame*7)%31)/10.0::DOUBLE AS yaw,
    frame%97 AS seed, (frame%4)/3.0::DOUBLE AS removal_fraction, frame%6 AS n_add
  FROM (SELECT DISTINCT user_id AS frame FROM events))"""


# -- observations ----------------------------------------------------------------

def observations(spark, d, events: DataFrame | None = None) -> DataFrame:
    """One observation per event: sender = user, frame = eight events, one of them ego."""
    e = F.col("event_id")
    kin = F.when(_mod(e, 5) != 0, _mod(e, 114) / 4000.0)
    residual = F.when(_mod(e, 7) != 0, _mod(e, 60) / 40.0)
    peer = F.when(_mod(e, 11) != 0, 1 - _mod(e, 5) / 8.0)
    ns = ts_ns()
    zero = F.lit(0.0)
    events = table(spark, d, "events") if events is None else events
    return events.select(
        F.lit("seq").alias("sequence_id"), F.lit("ses").alias("session_id"),
        F.col("user_id").cast("string").alias("agent_id"),
        e.alias("event_id"),
        ((ns - BASE_NS - F.pmod(ns - BASE_NS, F.lit(DAY_NS))) / DAY_NS).cast("bigint").alias(
            "sync_frame_id"),
        ns.alias("decision_time_ns"),
        F.when(_mod(e, 19) != 0, ns - _mod(e, 140) * 1_000_000).alias("source_time_ns"),
        F.floor(e / 8).alias("frame"),
        (_mod(e, 8) == 3).alias("is_ego"),
        (_mod(e, 19) != 0).alias("message_present"),
        kin.alias("kinematic_error_m"),
        residual.alias("two_sided_count_residual"),
        peer.alias("peer_corroboration_score"),
        F.col("event_type").isin("click", "view", "purchase").alias("kinematic_applicable"),
        F.when(_mod(e, 19) != 0, F.array(
            F.coalesce(kin, zero), F.coalesce(residual, zero), F.coalesce(peer, zero)
        )).alias("payload"),
        (_mod(e, 9) / 8.0).alias("local_confidence"),
        (_mod(e, 23) == 0).alias("intended_target"),
        (_mod(e, 29) == 0).alias("actually_affected"),
    )


SQL_OBSERVATIONS = f"""observations AS (
  SELECT event_id, user_id::VARCHAR AS agent_id,
    (epoch_us(ts)*1000-{BASE_NS})//{DAY_NS} AS sync_frame_id, epoch_us(ts)*1000 AS decision_time_ns,
    CASE WHEN event_id%19<>0 THEN epoch_us(ts)*1000-(event_id%140)*1000000 END AS source_time_ns,
    event_id//8 AS frame, event_id%8=3 AS is_ego, event_id%19<>0 AS message_present,
    CASE WHEN event_id%5<>0 THEN (event_id%114)/4000.0::DOUBLE END AS kin,
    CASE WHEN event_id%7<>0 THEN (event_id%60)/40.0::DOUBLE END AS residual,
    CASE WHEN event_id%11<>0 THEN 1-(event_id%5)/8.0::DOUBLE END AS peer,
    event_type IN ('click','view','purchase') AS applicable,
    (event_id%9)/8.0::DOUBLE AS local_confidence,
    event_id%23=0 AS intended_target, event_id%29=0 AS actually_affected
  FROM events)"""

# The score, restated in SQL.
SQL_SCORED = f"""{SQL_OBSERVATIONS},
parts AS (SELECT *, 1-least(greatest(kin/0.057::DOUBLE,0),1) AS ks,
    1-least(greatest(residual/3.0::DOUBLE,0),1) AS ss, least(greatest(peer,0),1) AS cs FROM observations),
weights AS (SELECT *, applicable AND kin IS NULL AS blocked,
    (CASE WHEN kin IS NULL THEN 0 ELSE 0.4::DOUBLE END)
    +(CASE WHEN residual IS NULL THEN 0 ELSE 0.3::DOUBLE END)
    +(CASE WHEN peer IS NULL THEN 0 ELSE 0.3::DOUBLE END) AS w,
    coalesce(0.4::DOUBLE*CASE WHEN kin IS NULL THEN NULL ELSE ks END,0)
    +coalesce(0.3::DOUBLE*CASE WHEN residual IS NULL THEN NULL ELSE ss END,0)
    +coalesce(0.3::DOUBLE*CASE WHEN peer IS NULL THEN NULL ELSE cs END,0) AS ws FROM parts),
scored AS (SELECT *, CASE WHEN blocked THEN 0::DOUBLE ELSE w END AS available_weight,
    blocked OR w+1e-12<0.6 AS abstained,
    CASE WHEN NOT (blocked OR w+1e-12<0.6) THEN 1-ws/w END AS risk FROM weights),
predicted AS (SELECT *, CASE WHEN message_present THEN risk END AS risk_score FROM scored)"""

# Smoothing and labels, restated as a recursive walk along each sender.
SQL_STATES = f"""{SQL_SCORED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY decision_time_ns) AS rn FROM predicted),
walk AS (
  SELECT agent_id, rn, risk_score AS e, NULL::DOUBLE AS e_prev,
    CASE WHEN risk_score IS NULL THEN 'unknown' WHEN risk_score>=0.25 THEN 'quarantined' ELSE 'normal' END AS state,
    'unknown' AS prev_state FROM numbered WHERE rn=1
  UNION ALL
  SELECT n.agent_id, n.rn,
    CASE WHEN n.risk_score IS NULL THEN w.e WHEN w.e IS NULL THEN n.risk_score
      ELSE 0.3::DOUBLE*n.risk_score+0.7::DOUBLE*w.e END,
    w.e,
    CASE WHEN n.risk_score IS NULL THEN 'unknown'
      WHEN (CASE WHEN w.e IS NULL THEN n.risk_score ELSE 0.3::DOUBLE*n.risk_score+0.7::DOUBLE*w.e END)>=0.25
      THEN 'quarantined' ELSE 'normal' END,
    w.state
  FROM walk w JOIN numbered n ON n.agent_id=w.agent_id AND n.rn=w.rn+1),
states AS (SELECT n.*, w.e AS ewma, w.e_prev, w.state AS current_state, w.prev_state AS previous_state
  FROM numbered n JOIN walk w USING (agent_id, rn))"""


def with_sql(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"
