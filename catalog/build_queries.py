"""The whole evidence build over the tables: files' worth of steps in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.match_queries import SQL_KINEMATICS_CTE
from catalog.views import (
    slot_width, SQL_EVENT_BOXES, SQL_EVENT_POINTS, _mod, event_boxes, event_points, odometry, r6,
    sql_inside, table, ts_ns, with_sql,
)
from trustweave import schemas as S
from trustweave.operators.evidence import to_wide
from trustweave.plans.clean_evidence import build_evidence

UNIT = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
REFERENCE = (1.0, 0.5)
NAMES = [
    "kinematic_residual_m", "object_count", "maximum_object_suspicion", "median_object_suspicion",
    "raw_point_share_diagnostic", "historical_fixed_risk_diagnostic",
    "unknown_aware_fixed_risk_uncalibrated", "unknown_aware_fixed_abstained",
]


def _agents(spark):
    """Registry of five agents: three that move and two that do not."""
    return spark.createDataFrame([
        (str(a), "vehicle" if a < 3 else "infrastructure", "lidar",
         "required" if a < 3 else "not_applicable", (str(a), "top", UNIT, "verified", "n"),
         (360.0, 180.0, 100.0, "verified"), ["x"], ["v"] if a < 3 else []) for a in range(5)
    ], S.REGISTRY)


def _build(spark, d):
    """Scene = user, sender = event_id % 5, two labelled boxes per user."""
    sender = _mod("event_id", 5).cast("string")
    scene = {"sequence_id": F.lit("seq"), "session_id": F.lit("ses")}
    frames = table(spark, d, "events").groupBy(
        F.col("user_id").alias("sync_frame_id"), sender.alias("agent_id")
    ).agg(F.max(ts_ns()).alias("source_time_ns")).withColumns({
        **scene, "decision_time_ns": F.col("source_time_ns") + 5_000_000,
        "match_age_ns": F.lit(5_000_000).cast("bigint"), "match_policy": F.lit(S.BUFFERED),
        "lookahead_buffer_ns": F.lit(1).cast("bigint"), "message_present": F.lit(True),
        "source_matched": F.lit(True), "reason_code": F.lit("matched"),
        "pose_source_time_ns": F.col("source_time_ns"), "pose_age_ns": F.lit(5_000_000).cast("bigint"),
    })
    # frames of an agent that the registry doesn't know: its counts are unknown, and so are
    # all shares of its scenes
    frames = frames.unionByName(frames.filter("agent_id = '4' and sync_frame_id % 50 = 0").withColumn("agent_id", F.lit("9")))
    series = odometry(spark, d, sender)
    points = event_points(spark, d).select(
        *[c.alias(n) for n, c in scene.items()], F.col("frame").alias("sync_frame_id"),
        sender.alias("agent_id"), "x", "y", "z",
    )
    labels = event_boxes(spark, d).withColumn("local_index", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *[c.alias(n) for n, c in scene.items()], F.col("frame").alias("sync_frame_id"), "local_index",
        F.lit(1).alias("class_id"), (F.col("center_x_m") + F.col("local_index")).alias("center_x_m"),
        "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad",
    )
    return build_evidence(
        frames, _agents(spark), series, points, labels, max_gap_s=86400.0, reference=REFERENCE,
        slot_ns=slot_width(spark, d) // 10,
    )


def evidence_build(spark, d):
    """Frame-level evidence of the whole build, one row per scene and sender."""
    evidence = _build(spark, d).evidence.filter("evidence_level = 'frame'")
    wide = to_wide(evidence, ["sync_frame_id", "agent_id"], NAMES)
    return wide.select("sync_frame_id", "agent_id", *[r6(n).alias(n) for n in NAMES])


SQL_BUILD = with_sql(f"""{SQL_EVENT_POINTS}, {SQL_EVENT_BOXES},
{SQL_KINEMATICS_CTE.replace('user_id::VARCHAR AS agent_id', '(event_id%5)::VARCHAR AS agent_id')},
fr AS (SELECT user_id AS frame, event_id%5 AS agent, max(epoch_us(ts)*1000) AS src FROM events GROUP BY 1,2),
objs AS (SELECT b.frame, o AS object, f.agent, cx+o AS cx, cy, cz, sx, sy, sz, yaw
  FROM event_boxes b JOIN fr f ON f.frame=b.frame, (SELECT unnest([0,1]) AS o)),
cnt AS (SELECT b.frame, b.object, b.agent, count(p.event_id) AS n FROM objs b LEFT JOIN event_points p
  ON p.frame=b.frame AND p.event_id%5=b.agent AND {sql_inside()} GROUP BY 1,2,3),
score AS (SELECT a.frame, a.object, a.agent, count(*) AS peers, count(*) FILTER (WHERE p.n>0)::DOUBLE/count(*) AS sc
  FROM cnt a JOIN cnt p ON p.frame=a.frame AND p.object=a.object AND p.agent<>a.agent GROUP BY 1,2,3),
weak AS (SELECT frame, agent, min(CASE WHEN peers>=2 THEN sc END) AS peer FROM score GROUP BY 1,2),
tot AS (SELECT frame, object, sum(n) AS t FROM cnt GROUP BY 1,2),
obj AS (SELECT c.frame, c.agent, count(*) AS objects, max(abs((ln(1+n::DOUBLE)-1.0)/0.5)) AS mx, median(abs((ln(1+n::DOUBLE)-1.0)/0.5)) AS md,
  avg(n) AS mean_n, CASE WHEN frame NOT IN (SELECT frame FROM fr WHERE agent=4 AND frame%50=0) THEN avg(CASE WHEN t>0 THEN n::DOUBLE/t::DOUBLE END) END AS share FROM cnt c JOIN tot USING (frame, object) GROUP BY 1,2),
w AS (SELECT f.frame, f.agent, o.*, weak.peer, f.agent<3 AS moves, CASE WHEN f.agent<3 AND k.reason_code='matched' THEN k.res END AS res
  FROM fr f JOIN (SELECT frame AS f1, agent AS a1, objects, mx, md, mean_n, share FROM obj) o ON o.f1=f.frame AND o.a1=f.agent
  LEFT JOIN weak ON weak.frame=f.frame AND weak.agent=f.agent
  LEFT JOIN kin k ON k.agent_id=f.agent::VARCHAR AND k.time_ns=f.src),
x AS (SELECT *, moves AND res IS NULL AS blocked,
  CASE WHEN res IS NULL THEN 0 ELSE 0.4::DOUBLE END+0.3::DOUBLE+CASE WHEN peer IS NULL THEN 0 ELSE 0.3::DOUBLE END AS wt,
  coalesce(0.4::DOUBLE*(1-CASE WHEN res IS NOT NULL THEN least(res/0.057::DOUBLE,1) END),0)
  +0.3::DOUBLE*(1-least(mx/3.0::DOUBLE,1))+coalesce(0.3::DOUBLE*peer,0) AS ws FROM w)""", """
SELECT frame AS sync_frame_id, agent::VARCHAR AS agent_id, round(res,6)+0.0 AS kinematic_residual_m, objects::DOUBLE AS object_count,
 round(mx,6)+0.0 AS maximum_object_suspicion, round(md,6)+0.0 AS median_object_suspicion, round(share,6)+0.0 AS raw_point_share_diagnostic,
 round(1-(0.4::DOUBLE*coalesce(1-CASE WHEN res IS NOT NULL THEN least(res/0.057::DOUBLE,1) END,1)+0.3::DOUBLE*least(mean_n/350.0::DOUBLE,1)+0.3::DOUBLE*coalesce(share,0)),6)+0.0 AS historical_fixed_risk_diagnostic,
 CASE WHEN NOT blocked AND wt+1e-12>=0.6 THEN round(1-ws/wt,6)+0.0 END AS unknown_aware_fixed_risk_uncalibrated,
 CASE WHEN NOT blocked AND wt+1e-12>=0.6 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unknown_aware_fixed_abstained FROM x
UNION ALL SELECT frame, '9', NULL, 2.0, NULL, NULL, NULL, 0.6, NULL, 1.0 FROM fr WHERE agent=4 AND frame%50=0""")

QUERIES = {"evidence_build": (evidence_build, SQL_BUILD)}
