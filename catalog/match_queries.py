"""As-of matching, poses and kinematics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import (
    BASE_NS, DAY_NS, HOUR_NS, slot_width, SQL_MEMBERSHIPS, SQL_MESSAGES, SQL_ODOMETRY, _mod, memberships,
    messages, odometry, r6, table, ts_ns, users, with_sql,
)
from trustweave.operators.contracts import contiguity, order_violations
from trustweave.operators.kinematics import attach_kinematics, interval_kinematics
from trustweave.operators.match import match_messages, reason_counts
from trustweave.operators.ordered import rank_in_key
from trustweave.operators.pose import pose_at
from trustweave.schemas import BUFFERED, CAUSAL

OUT = [
    "session_id", "agent_id", "sync_frame_id", "message_present", "source_matched",
    "evidence_available", "reason_code", "source_time_ns", "match_age_ns",
    "pose_source_time_ns", "pose_age_ns",
]
RUNS = {  # policy, max age, look-ahead
    "causal": (CAUSAL, 2 * DAY_NS, 0),
    "buffered": (BUFFERED, 2 * DAY_NS, 6 * HOUR_NS),
    "buffered_wide": (BUFFERED, 6 * HOUR_NS, 2 * DAY_NS),
}


def _matched(spark, d, run):
    policy, age, ahead = RUNS[run]
    return match_messages(
        memberships(spark, d), messages(spark, d), policy=policy, max_age_ns=age,
        lookahead_ns=ahead, slot_ns=slot_width(spark, d),
    )


def sql_matched(run: str) -> str:
    policy, age, ahead = RUNS[run]
    if policy == CAUSAL:
        pick = "max(m.source_time_ns) FILTER (WHERE ok)"
    else:
        pick = ("arg_min(m.source_time_ns, abs(decision_time_ns-m.source_time_ns)*2"
                "+(m.source_time_ns>decision_time_ns)::INT) FILTER (WHERE ok)")
    return f"""{SQL_MESSAGES}, {SQL_MEMBERSHIPS},
pairs AS (SELECT f.*, m.source_time_ns AS src, m.arrival_time_ns AS arr FROM memberships f
  LEFT JOIN messages m USING (sequence_id, session_id, agent_id)),
found AS (SELECT session_id, agent_id, sync_frame_id, decision_time_ns, member, message_expected,
  count(src) AS n,
  {pick.replace('m.source_time_ns', 'src').replace('ok', f'src<=decision_time_ns+{ahead} AND arr<=decision_time_ns+{ahead}')} AS c,
  coalesce(bool_or(src<=decision_time_ns+{ahead} AND abs(decision_time_ns-src)<={age} AND arr>decision_time_ns+{ahead}), false) AS late,
  min(src)>decision_time_ns+{ahead} AS all_after,
  coalesce(bool_or(src<decision_time_ns), false) AS past FROM pairs GROUP BY 1,2,3,4,5,6),
named AS (SELECT f.*, m.empty_scene, m.pose_valid, m.pose_source_time_ns AS pose,
  CASE WHEN NOT member THEN 'not_member' WHEN NOT message_expected OR n=0 THEN 'missing_message'
   WHEN c IS NOT NULL THEN CASE WHEN abs(decision_time_ns-c)>{age}
      THEN CASE WHEN decision_time_ns>c THEN 'stale' ELSE 'out_of_range' END
      WHEN m.empty_scene THEN 'empty_scene' WHEN NOT m.pose_valid THEN 'invalid_pose' ELSE 'matched' END
   WHEN late THEN 'late' WHEN all_after THEN 'unmatched' WHEN past THEN 'stale' ELSE 'out_of_range' END AS reason_code
  FROM found f LEFT JOIN messages m ON m.session_id=f.session_id AND m.agent_id=f.agent_id AND m.source_time_ns=f.c),
matched AS (SELECT session_id, agent_id, sync_frame_id,
  member AND message_expected AND n>0 AS message_present,
  reason_code IN ('matched','empty_scene','invalid_pose') AS source_matched,
  reason_code='matched' AS evidence_available, reason_code,
  CASE WHEN reason_code IN ('matched','empty_scene','invalid_pose') THEN c END AS source_time_ns,
  CASE WHEN reason_code IN ('matched','empty_scene','invalid_pose') THEN decision_time_ns-c END AS match_age_ns,
  CASE WHEN reason_code IN ('matched','empty_scene','invalid_pose') AND pose_valid THEN pose END AS pose_source_time_ns,
  CASE WHEN reason_code IN ('matched','empty_scene','invalid_pose') AND pose_valid THEN decision_time_ns-pose END AS pose_age_ns
  FROM named)"""


def asof_causal(spark, d):
    return _matched(spark, d, "causal").select(*OUT)


def asof_buffered(spark, d):
    return _matched(spark, d, "buffered").select(*OUT)


def asof_buffered_wide(spark, d):
    return _matched(spark, d, "buffered_wide").select(*OUT)


def match_reasons(spark, d):
    """Both policies united, then counted by reason."""
    runs = _matched(spark, d, "causal").unionByName(_matched(spark, d, "buffered"))
    return reason_counts(runs, ["match_policy"])


def pose_targets(spark, d):
    ids = users(spark, d, 32)
    rows = ids.select("user_id", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(30).cast("bigint"))).alias("day"))
    target = F.lit(BASE_NS) + F.col("day") * DAY_NS + 6 * HOUR_NS
    return rows.select(
        F.col("user_id").cast("string").alias("agent_id"), "day",
        target.alias("target_time_ns"),
        (target + (_mod(F.col("user_id") + F.col("day"), 3) - 1) * HOUR_NS).alias("decision_time_ns"),
    )


def pose_lookup(spark, d):
    samples = odometry(spark, d).select(
        "agent_id", "time_ns", F.col("position_m").alias("translation_m"), "quaternion_xyzw"
    )
    out = pose_at(
        pose_targets(spark, d), samples, policy=BUFFERED, max_gap_ns=DAY_NS,
        lookahead_ns=12 * HOUR_NS, keys=["agent_id"], slot_ns=slot_width(spark, d),
    )
    return out.select(
        "agent_id", "day", "reason_code", "previous_time_ns", "next_time_ns",
        "pose_source_time_ns", "pose_age_ns",
        *[r6(F.col(f"translation_m.{c}")).alias(f"t{c}") for c in "xy"],
        *[r6(F.col(f"quaternion_xyzw.{c}")).alias(f"q{c}") for c in "zw"],
    )


SQL_POSE = with_sql(f"""{SQL_ODOMETRY},
targets AS (SELECT user_id::VARCHAR AS agent_id, day, {BASE_NS}+day*{DAY_NS}+6*{HOUR_NS} AS t,
  {BASE_NS}+day*{DAY_NS}+6*{HOUR_NS}+(((user_id+day)%3+3)%3-1)*{HOUR_NS} AS decision
  FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(-1,31)) AS day)),
p AS (SELECT t.*, o.time_ns AS t0, o.px AS x0, o.py AS y0, sin(o.yaw/2) AS z0, cos(o.yaw/2) AS w0
  FROM targets t ASOF LEFT JOIN odometry o ON t.agent_id=o.agent_id AND t.t>=o.time_ns),
n AS (SELECT p.*, o.time_ns AS t1, o.px AS x1, o.py AS y1, sin(o.yaw/2) AS z1, cos(o.yaw/2) AS w1
  FROM p ASOF LEFT JOIN odometry o ON p.agent_id=o.agent_id AND p.t<=o.time_ns),
r AS (SELECT *, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 'out_of_range' WHEN t1-t0>{DAY_NS} THEN 'invalid_pose'
  WHEN t1>decision+12*{HOUR_NS} THEN 'future_pose_unavailable' ELSE 'matched' END AS reason_code,
  CASE WHEN t1>t0 THEN (t-t0)::DOUBLE/(t1-t0) ELSE 0 END AS f,
  CASE WHEN z0*z1+w0*w1<0 THEN -1 ELSE 1 END AS sg FROM n),
s AS (SELECT *, acos(least(1.0, abs(z0*z1+w0*w1))) AS th FROM r)""", """
SELECT agent_id, day, reason_code, t0 AS previous_time_ns, t1 AS next_time_ns,
 CASE WHEN reason_code='matched' THEN t1 END AS pose_source_time_ns,
 CASE WHEN reason_code='matched' THEN decision-t1 END AS pose_age_ns,
 CASE WHEN reason_code='matched' THEN round(x0+f*(x1-x0),6)+0.0 END AS tx,
 CASE WHEN reason_code='matched' THEN round(y0+f*(y1-y0),6)+0.0 END AS ty,
 CASE WHEN reason_code='matched' THEN round(CASE WHEN th<1e-9 THEN z0 ELSE (sin((1-f)*th)*z0+sg*sin(f*th)*z1)/sin(th) END,6)+0.0 END AS qz,
 CASE WHEN reason_code='matched' THEN round(CASE WHEN th<1e-9 THEN w0 ELSE (sin((1-f)*th)*w0+sg*sin(f*th)*w1)/sin(th) END,6)+0.0 END AS qw
FROM s""")


def interval_kinematics_query(spark, d):
    out = interval_kinematics(
        odometry(spark, d), ["agent_id"], max_gap_s=86400.0, slot_ns=slot_width(spark, d)
    )
    return out.select(
        "agent_id", "time_ns", "reason_code", r6("dt_s").alias("dt_s"),
        (F.round("speed_mps", 9) + F.lit(0.0)).alias("speed_mps"),
        r6(F.col("acceleration_mps2") * 1e6).alias("acceleration_scaled"),
        r6("yaw_change_rad").alias("yaw_change_rad"), r6("residual_m").alias("residual_m"),
    )


SQL_KINEMATICS_CTE = f"""{SQL_ODOMETRY},
pr AS (SELECT *, lag(time_ns) OVER w AS t0, lag(px) OVER w AS px0, lag(py) OVER w AS py0,
  lag(yaw) OVER w AS yaw0, lag(vx) OVER w AS vx0, lag(vy) OVER w AS vy0
  FROM odometry WINDOW w AS (PARTITION BY agent_id ORDER BY time_ns)),
st AS (SELECT *, (time_ns-t0)/1e9::DOUBLE AS dt,
  CASE WHEN t0 IS NULL THEN 'out_of_range' WHEN time_ns-t0<=0 THEN 'nonpositive_dt'
   WHEN (time_ns-t0)/1e9::DOUBLE>86400 THEN 'excessive_gap' ELSE 'matched' END AS reason_code,
  atan2(sin(yaw-yaw0), cos(yaw-yaw0)) AS dyaw FROM pr),
mv AS (SELECT *, (vx+vx0)/2 AS mvx, (vy+vy0)/2 AS mvy,
  list_sum(list_transform(range(10), lambda k: cos(yaw0+dyaw*(k+0.5::DOUBLE)/10)))/10 AS mc,
  list_sum(list_transform(range(10), lambda k: sin(yaw0+dyaw*(k+0.5::DOUBLE)/10)))/10 AS ms FROM st),
kin AS (SELECT *, sqrt((px-px0-dt*(mvx*mc-mvy*ms))**2+(py-py0-dt*(mvx*ms+mvy*mc))**2) AS res FROM mv)"""

SQL_KINEMATICS = with_sql(SQL_KINEMATICS_CTE, """
SELECT agent_id, time_ns, reason_code,
 CASE WHEN reason_code='matched' THEN round(dt,6)+0.0 END AS dt_s,
 CASE WHEN reason_code='matched' THEN round(0.5::DOUBLE*(sqrt(vx*vx+vy*vy)+sqrt(vx0*vx0+vy0*vy0)),9)+0.0 END AS speed_mps,
 CASE WHEN reason_code='matched' THEN round(sqrt((vx-vx0)**2+(vy-vy0)**2)/dt*1e6,6)+0.0 END AS acceleration_scaled,
 CASE WHEN reason_code='matched' THEN round(dyaw,6)+0.0 END AS yaw_change_rad,
 CASE WHEN reason_code='matched' THEN round(res,6)+0.0 END AS residual_m
FROM kin""")


def attach_kinematics_query(spark, d):
    """Frames take the interval that ends exactly at their source time, if any."""
    frames = table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("agent_id"),
        (ts_ns() + F.when(_mod("event_id", 9) == 0, 1).otherwise(0)).alias("source_time_ns"),
    )
    kin = interval_kinematics(
        odometry(spark, d), ["agent_id"], max_gap_s=86400.0, slot_ns=slot_width(spark, d)
    )
    return attach_kinematics(frames, kin).select(
        "event_id", F.col("kinematics.reason_code").alias("reason_code"),
        r6(F.col("kinematics.residual_m")).alias("residual_m"),
    )


SQL_ATTACH = with_sql(SQL_KINEMATICS_CTE, """
SELECT e.event_id, coalesce(k.reason_code,'out_of_range') AS reason_code,
 CASE WHEN k.reason_code='matched' THEN round(k.res,6)+0.0 END AS residual_m
FROM (SELECT event_id, user_id::VARCHAR AS agent_id, epoch_us(ts)*1000+(event_id%9=0)::INT AS s FROM events) e
LEFT JOIN kin k ON k.agent_id=e.agent_id AND k.time_ns=e.s""")


def order_audit(spark, d):
    """Events in file order, checked for strictly increasing values per user."""
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), F.col("event_id").alias("position"),
        (ts_ns() - _mod("event_id", 5) * HOUR_NS).alias("time_ns"),
    )
    return order_violations(rows, ["agent_id"], "time_ns", slot_ns=1000)


SQL_ORDER_AUDIT = f"""WITH o AS (SELECT user_id::VARCHAR AS agent_id, event_id AS position,
 epoch_us(ts)*1000-(event_id%5)*{HOUR_NS} AS time_ns FROM events),
 l AS (SELECT *, lag(time_ns) OVER (PARTITION BY agent_id ORDER BY position) AS previous_time FROM o)
SELECT agent_id, position, time_ns, previous_time FROM l WHERE time_ns<=previous_time"""


def contiguity_query(spark, d):
    rows = table(spark, d, "events").select(
        "user_id", F.floor((ts_ns() - BASE_NS) / DAY_NS).alias("day")
    )
    return contiguity(rows, ["user_id"], "day")


SQL_CONTIGUITY = f"""SELECT user_id, min(day) AS first_number, max(day) AS last_number,
 count(DISTINCT day) AS distinct_numbers, max(day)-min(day)+1=count(DISTINCT day) AS contiguous
FROM (SELECT user_id, (epoch_us(ts)*1000-{BASE_NS})//{DAY_NS} AS day FROM events) GROUP BY user_id"""


def local_index(spark, d):
    """Zero-based index of a line within its order, by part and price."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    ranked = rank_in_key(rows, ["o_custkey"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 4096))
    return ranked.select("o_custkey", "o_orderkey", (F.col("rank") - 1).alias("local_index"))


SQL_LOCAL_INDEX = """SELECT o_custkey, o_orderkey,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS local_index FROM orders"""

_sel = f"SELECT {', '.join(OUT)} FROM matched"
QUERIES = {
    "asof_causal": (asof_causal, with_sql(sql_matched("causal"), _sel)),
    "asof_buffered": (asof_buffered, with_sql(sql_matched("buffered"), _sel)),
    "asof_buffered_wide": (asof_buffered_wide, with_sql(sql_matched("buffered_wide"), _sel)),
    "match_reasons": (match_reasons, f"""
SELECT 'causal_backward' AS match_policy, reason_code, count(*) AS rows FROM ({with_sql(sql_matched('causal'), 'SELECT * FROM matched')}) GROUP BY reason_code
UNION ALL
SELECT 'buffered_nearest', reason_code, count(*) FROM ({with_sql(sql_matched('buffered'), 'SELECT * FROM matched')}) GROUP BY reason_code"""),
    "pose_at": (pose_lookup, SQL_POSE),
    "interval_kinematics": (interval_kinematics_query, SQL_KINEMATICS),
    "attach_kinematics": (attach_kinematics_query, SQL_ATTACH),
    "order_audit": (order_audit, SQL_ORDER_AUDIT),
    "contiguity": (contiguity_query, SQL_CONTIGUITY),
    "local_index": (local_index, SQL_LOCAL_INDEX),
}
