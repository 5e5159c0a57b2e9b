"""Spatial support, peers, scores, states and evidence tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import (
    slot_width, SQL_BOXES, SQL_COUNTS, SQL_EVENT_POINTS, SQL_OBSERVATIONS, SQL_POINTS, SQL_SCORED,
    SQL_STATES, _mod, agent_boxes, boxes, event_points, observations, points, r6, sql_inside,
    table, with_sql,
)
from trustweave.functions import geometry as G
from trustweave.functions.scoring import fixed_diagnostic, missing_aware
from trustweave.operators.evidence import Item, playback, stable_order, to_long, to_wide
from trustweave.operators.ordered import time_slot
from trustweave.operators.peers import (
    frame_shares, leave_one_out, mean_if_complete, object_suspicion, point_shares,
    summarize_suspicion, weakest_peer_score,
)
from trustweave.operators.quantiles import exact_median
from trustweave.operators.spatial import cloud_summary, count_in_boxes, spatial_support
from trustweave.operators.temporal import Smoothing, ewma, label_state
from trustweave.operators.ordered import rank_in_key
from trustweave.sources.stage import once, stage

REFERENCE = (1.0, 0.5)  # expected log1p count and its scale


def points_in_boxes(spark, d):
    return count_in_boxes(
        points(spark, d), boxes(spark, d), ["frame"], ["box"]
    )


SQL_POINTS_IN_BOXES = with_sql(f"{SQL_POINTS}, {SQL_BOXES}", f"""
SELECT b.frame, b.box, count(p.x) AS point_count FROM boxes b
LEFT JOIN points p ON p.frame=b.frame AND {sql_inside()} GROUP BY b.frame, b.box""")


def mixed_boxes(spark, d):
    """Boxes from one metre to a kilometre in one join."""
    times = F.pow(F.lit(10.0), F.pmod("box", F.lit(4)).cast("double"))
    sized = boxes(spark, d).withColumns({c: F.col(c) * times for c in ("size_x_m", "size_y_m")})
    return count_in_boxes(points(spark, d), sized, ["frame"], ["box"])


SQL_MIXED_BOXES = with_sql(f"{SQL_POINTS}, {SQL_BOXES}, sized AS (SELECT * REPLACE (sx*10.0::DOUBLE**(box%4) AS sx, sy*10.0::DOUBLE**(box%4) AS sy) FROM boxes)", f"""
SELECT b.frame, b.box, count(p.x) AS point_count FROM sized b
LEFT JOIN points p ON p.frame=b.frame AND {sql_inside()} GROUP BY b.frame, b.box""")


def _agent_counts(spark, d):
    return count_in_boxes(
        points(spark, d), agent_boxes(spark, d), ["frame", "agent"], ["box"]
    )


def count_residuals_query(spark, d):
    out = spatial_support(
        points(spark, d), agent_boxes(spark, d), ["frame", "agent"], ["box"],
        reference=REFERENCE,
    )
    return out.select(
        "frame", "agent", "box", "point_count", "spatial_reason",
        r6("deficit_residual").alias("deficit"), r6("surplus_residual").alias("surplus"),
        r6("box_range_m").alias("box_range_m"), r6("box_volume_m3").alias("box_volume_m3"),
    )


SQL_RESIDUALS = with_sql(SQL_COUNTS, """
SELECT c.frame, c.agent, c.box, c.point_count, 'matched' AS spatial_reason,
 round(greatest(-(ln(1+c.point_count::DOUBLE)-1.0)/0.5,0),6)+0.0 AS deficit,
 round(greatest((ln(1+c.point_count::DOUBLE)-1.0)/0.5,0),6)+0.0 AS surplus,
 round(sqrt(cx*cx+cy*cy+cz*cz),6)+0.0 AS box_range_m, round(sx*sy*sz,6)+0.0 AS box_volume_m3
FROM counts c JOIN boxes b USING (box)""")


def _peers(spark, d):
    eligible = agent_boxes(spark, d).select("frame", "agent", "box", "eligible")
    counts = _agent_counts(spark, d).join(eligible.hint("merge"), ["frame", "agent", "box"])
    return leave_one_out(stage(counts), ["frame", "box"])


def peer_corroboration(spark, d):
    return _peers(spark, d).select(
        "box", "agent", "peer_available", "peer_reason", "eligible_peer_count",
        "positive_peer_count", r6("peer_location_log1p").alias("location"),
        r6("peer_scale_log1p").alias("scale"),
        r6("peer_deficit_residual").alias("deficit"),
        r6("peer_surplus_residual").alias("surplus"),
        r6("peer_disagreement").alias("disagreement"),
        r6("peer_corroboration_score").alias("score"),
    )


SQL_PEERS_CTE = f"""{SQL_COUNTS},
pp AS (SELECT a.box, a.agent, a.point_count, a.eligible, p.point_count AS pc
  FROM counts a LEFT JOIN counts p ON p.box=a.box AND p.agent<>a.agent AND p.eligible),
loc AS (SELECT box, agent, point_count, eligible, count(pc) AS peers,
  count(pc) FILTER (WHERE pc>0) AS positive, median(ln(1+pc::DOUBLE)) AS m FROM pp GROUP BY 1,2,3,4),
mad AS (SELECT pp.box, pp.agent, median(abs(ln(1+pp.pc::DOUBLE)-l.m)) AS mad
  FROM pp JOIN loc l USING (box, agent) GROUP BY 1,2),
peer AS (SELECT l.*, greatest(1.4826*mad,0.25) AS sc, eligible AND peers>=2 AS ok FROM loc l JOIN mad USING (box, agent))"""

SQL_PEERS = with_sql(SQL_PEERS_CTE, """
SELECT box, agent, ok AS peer_available,
 CASE WHEN ok THEN 'matched' WHEN peers>=2 THEN 'visibility_unknown' ELSE 'insufficient_peers' END AS peer_reason,
 peers AS eligible_peer_count, positive AS positive_peer_count,
 CASE WHEN ok THEN round(m,6)+0.0 END AS location, CASE WHEN ok THEN round(sc,6)+0.0 END AS scale,
 CASE WHEN ok THEN round(greatest(-(ln(1+point_count::DOUBLE)-m)/sc,0),6)+0.0 END AS deficit,
 CASE WHEN ok THEN round(greatest((ln(1+point_count::DOUBLE)-m)/sc,0),6)+0.0 END AS surplus,
 CASE WHEN ok THEN round(abs((ln(1+point_count::DOUBLE)-m)/sc),6)+0.0 END AS disagreement,
 CASE WHEN ok THEN round(positive::DOUBLE/peers,6)+0.0 END AS score FROM peer""")


def weakest_peer(spark, d):
    out = weakest_peer_score(_peers(spark, d), ["frame", "agent"])
    return out.select("frame", "agent", r6("peer_corroboration_score").alias("score"))


SQL_WEAKEST = with_sql(SQL_PEERS_CTE, """
SELECT box%1000 AS frame, agent, round(min(CASE WHEN ok THEN positive::DOUBLE/peers END),6)+0.0 AS score
FROM peer GROUP BY 1,2""")


def suspicion_summary(spark, d):
    """Per frame and agent over its boxes; every seventh box is left unknown."""
    out = spatial_support(
        points(spark, d), agent_boxes(spark, d), ["frame", "agent"], ["box"],
        reference=REFERENCE,
    )
    unknown = _mod(F.col("box") + F.col("agent"), 7) == 0
    rows = out.withColumn(
        "suspicion",
        F.when(~unknown, object_suspicion(F.col("deficit_residual"), F.col("surplus_residual"))),
    )
    return summarize_suspicion(stage(rows), ["frame", "agent"]).select(
        "frame", "agent", "object_count", "available_object_count", "unavailable_object_count",
        r6("maximum_object_suspicion").alias("maximum"),
        r6("median_object_suspicion").alias("median"), "any_object_evidence_unavailable",
    )


SQL_SUSPICION = with_sql(f"""{SQL_COUNTS}, s AS (SELECT frame, agent,
 CASE WHEN (box+agent)%7<>0 THEN abs((ln(1+point_count::DOUBLE)-1.0)/0.5) END AS v FROM counts)""", """
SELECT frame, agent, count(*) AS object_count, count(v) AS available_object_count,
 count(*)-count(v) AS unavailable_object_count, round(max(v),6)+0.0 AS maximum,
 round(median(v),6)+0.0 AS median, count(*)>count(v) AS any_object_evidence_unavailable
FROM s GROUP BY frame, agent""")


def suspicion_by_agent(spark, d):
    """Exact median over large groups: all boxes of an agent."""
    out = spatial_support(
        points(spark, d), agent_boxes(spark, d), ["frame", "agent"], ["box"],
        reference=REFERENCE,
    ).withColumn("suspicion", object_suspicion(F.col("deficit_residual"), F.col("surplus_residual")))
    return exact_median(stage(out), ["agent"], "suspicion").select("agent", r6("median").alias("median"))


SQL_SUSPICION_AGENT = with_sql(SQL_COUNTS, """
SELECT agent, round(median(abs((ln(1+point_count::DOUBLE)-1.0)/0.5)),6)+0.0 AS median
FROM counts GROUP BY agent""")


def value_medians(spark, d):
    """Exact medians of real-valued columns: value per event type."""
    out = exact_median(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", r6("median").alias("median"))


SQL_VALUE_MEDIANS = "SELECT event_type, round(median(value),6)+0.0 AS median FROM events GROUP BY 1"


def point_share(spark, d):
    counts = stage(_agent_counts(spark, d)).withColumn(
        "point_count", F.when(_mod("box", 9) != 0, F.col("point_count"))
    )
    shares = frame_shares(point_shares(counts, ["frame", "box"], "agent"), ["frame", "agent"])
    means = mean_if_complete(counts, ["frame", "agent"], "point_count", "mean_count")
    return shares.join(means, ["frame", "agent"]).select(
        "frame", "agent", r6("raw_point_share").alias("share"), r6("mean_count").alias("mean_count")
    )


SQL_SHARE = with_sql(f"""{SQL_COUNTS},
c AS (SELECT frame, agent, box, CASE WHEN box%9<>0 THEN point_count END AS n FROM counts),
t AS (SELECT box, sum(n) AS t, count(*)=count(n) AS full_box FROM c GROUP BY box)""", """
SELECT c.frame, c.agent, round(avg(CASE WHEN full_box AND t>0 THEN n::DOUBLE/t::DOUBLE END),6)+0.0 AS share,
 CASE WHEN count(*)=count(n) THEN round(avg(n),6)+0.0 END AS mean_count
FROM c JOIN t USING (box) GROUP BY c.frame, c.agent""")


def cloud_summary_query(spark, d):
    pts = event_points(spark, d).withColumn(
        "x", F.when(_mod("event_id", 301) == 0, F.lit(float("nan"))).otherwise(F.col("x"))
    ).withColumn("intensity", G.normalized_intensity(F.col("intensity"), 3500.0).cast("double"))
    out = cloud_summary(pts, ["frame"], "intensity")
    return out.select(
        "frame", "points", "any_nonfinite",
        r6("normalized_intensity_min").alias("low"), r6("normalized_intensity_max").alias("high"),
    )


SQL_CLOUDS = with_sql(SQL_EVENT_POINTS, """
SELECT frame, count(*) AS points, bool_or(event_id%301=0) AS any_nonfinite,
 round(min(least(greatest((intensity::FLOAT/3500::FLOAT)::FLOAT,0::FLOAT),1::FLOAT))::DOUBLE,6)+0.0 AS low,
 round(max(least(greatest((intensity::FLOAT/3500::FLOAT)::FLOAT,0::FLOAT),1::FLOAT))::DOUBLE,6)+0.0 AS high
FROM event_points GROUP BY frame""")


# A fixed rigid transform: quarter turn about z and a shift.
MATRIX = [[0.0, -1.0, 0.0, 1.5], [1.0, 0.0, 0.0, -2.0], [0.0, 0.0, 1.0, 0.25], [0.0, 0.0, 0.0, 1.0]]


def rigid_transform(spark, d):
    """There, there and back, twice (composition), and matrix -> quaternion -> matrix."""
    m = F.array(*[F.array(*[F.lit(v) for v in row]) for row in MATRIX])
    pts = event_points(spark, d).withColumn("m", m)
    there = G.transform_point(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    pts = pts.withColumn("t", there.col()).withColumn("i", G.invert_transform(F.col("m"))).withColumn(
        "c", G.compose_transforms(F.col("m"), F.col("m"))
    ).withColumn("q", G.matrix_to_quat(F.col("m")))
    back = G.transform_point(F.col("i"), F.col("t.x"), F.col("t.y"), F.col("t.z"))
    twice = G.transform_point(F.col("c"), F.col("x"), F.col("y"), F.col("z"))
    spun = G.quat_rotate(F.col("q"), G.vec(F.col("x"), F.col("y"), F.col("z")))
    return pts.select(
        "event_id", G.matrix_is_rigid(F.col("m")).alias("rigid"),
        *[r6(F.col(f"t.{c}")).alias(f"t{c}") for c in "xyz"],
        *[r6(back[c]).alias(f"b{c}") for c in "xyz"],
        *[r6(twice[c]).alias(f"w{c}") for c in "xyz"],
        *[r6(spun[c]).alias(f"s{c}") for c in "xyz"],
    )


SQL_RIGID = with_sql(SQL_EVENT_POINTS, """
SELECT event_id, true AS rigid, round(-y+1.5::DOUBLE,6)+0.0 AS tx, round(x-2,6)+0.0 AS ty, round(z+0.25::DOUBLE,6)+0.0 AS tz,
 round(x,6)+0.0 AS bx, round(y,6)+0.0 AS by, round(z,6)+0.0 AS bz,
 round(-(x-2)+1.5::DOUBLE,6)+0.0 AS wx, round((-y+1.5::DOUBLE)-2,6)+0.0 AS wy, round(z+0.5::DOUBLE,6)+0.0 AS wz,
 round(-y,6)+0.0 AS sx, round(x,6)+0.0 AS sy, round(z,6)+0.0 AS sz
FROM event_points""")


def visibility(spark, d):
    """Box centers against agents with known, unresolved and unverified coverage."""
    verified = F.struct(
        F.lit(120.0).alias("horizontal_fov_deg"), F.lit(40.0).alias("vertical_fov_deg"),
        F.lit(12.0).alias("range_m"), F.lit("verified").alias("status"),
    )
    blank = F.lit(None).cast("double")
    open_ = F.struct(
        blank.alias("horizontal_fov_deg"), blank.alias("vertical_fov_deg"),
        blank.alias("range_m"), F.lit("unresolved").alias("status"),
    )
    rows = boxes(spark, d).withColumn("coverage", F.when(_mod("box", 5) == 0, open_).otherwise(verified))
    center = F.when(_mod("box", 7) != 0, F.struct(
        F.col("center_x_m").alias("x"), F.col("center_y_m").alias("y"), F.col("center_z_m").alias("z")
    ))
    rows = rows.withColumn("center", center).withColumn(
        "v", G.visibility(F.col("center"), F.col("coverage"))
    )
    return rows.select(
        "box", F.col("v.eligible").alias("eligible"), F.col("v.reason_code").alias("reason_code"),
        r6("v.range_m").alias("range_m"), r6("v.azimuth_deg").alias("azimuth_deg"),
        r6("v.elevation_deg").alias("elevation_deg"),
    )


SQL_VISIBILITY = with_sql(f"""{SQL_BOXES}, v AS (SELECT *, box%7<>0 AND box%5<>0 AS k,
 sqrt(cx*cx+cy*cy+cz*cz) AS r, degrees(atan2(cy,cx)) AS az, degrees(atan2(cz,sqrt(cx*cx+cy*cy))) AS el FROM boxes)""", """
SELECT box, CASE WHEN k THEN r<=12 AND abs(az)<=60 AND abs(el)<=20 END AS eligible,
 CASE WHEN box%7=0 THEN 'unresolved_transform' WHEN box%5=0 THEN 'visibility_unknown' ELSE 'matched' END AS reason_code,
 CASE WHEN k THEN round(r,6)+0.0 END AS range_m, CASE WHEN k THEN round(az,6)+0.0 END AS azimuth_deg,
 CASE WHEN k THEN round(el,6)+0.0 END AS elevation_deg FROM v""")


def risk_missing_aware(spark, d):
    rows = observations(spark, d).withColumn("s", missing_aware(
        F.col("kinematic_error_m"), F.col("two_sided_count_residual"),
        F.col("peer_corroboration_score"), F.col("kinematic_applicable"),
    ))
    return rows.select(
        "event_id", r6("s.trust").alias("trust"), r6("s.risk").alias("risk"),
        r6("s.available_weight").alias("available_weight"), F.col("s.abstained").alias("abstained"),
        F.col("s.reason_code").alias("reason_code"),
    )


SQL_RISK = with_sql(SQL_SCORED, """
SELECT event_id, CASE WHEN NOT abstained THEN round(1-risk,6)+0.0 END AS trust, round(risk,6)+0.0 AS risk,
 round(available_weight,6)+0.0 AS available_weight, abstained,
 CASE WHEN abstained THEN 'incomplete_evidence' ELSE 'matched' END AS reason_code FROM scored""")


def risk_fixed(spark, d):
    o = observations(spark, d)
    count = F.when(_mod("event_id", 13) != 0, _mod("event_id", 500).cast("double"))
    rows = o.withColumn("s", fixed_diagnostic(
        F.col("kinematic_error_m"), count, F.col("peer_corroboration_score")
    ))
    return rows.select("event_id", r6("s.trust").alias("trust"), r6("s.risk").alias("risk"))


SQL_FIXED = with_sql(f"""{SQL_OBSERVATIONS}, f AS (SELECT event_id,
 0.4::DOUBLE*coalesce(1-least(greatest(CASE WHEN kin IS NOT NULL THEN kin/0.057::DOUBLE END,0),1)+CASE WHEN kin IS NULL THEN NULL ELSE 0 END,1)
 +0.3::DOUBLE*CASE WHEN event_id%13<>0 THEN least(greatest((event_id%500)/350.0::DOUBLE,0),1) ELSE 0 END
 +0.3::DOUBLE*CASE WHEN peer IS NULL THEN 0 ELSE least(greatest(peer,0),1) END AS trust FROM observations)""",
 "SELECT event_id, round(trust,6)+0.0 AS trust, round(1-trust,6)+0.0 AS risk FROM f")


def senders(spark, d, config=Smoothing()):
    """Scored observations with smoothing and states, per sender."""
    rows = once(observations(spark, d), s=missing_aware(
        F.col("kinematic_error_m"), F.col("two_sided_count_residual"),
        F.col("peer_corroboration_score"), F.col("kinematic_applicable"),
    ))
    rows = rows.withColumn("risk_score", F.when(F.col("message_present"), F.col("s.risk"))).drop("s")
    smoothed = ewma(
        rows, ["agent_id"], ["decision_time_ns"],
        time_slot(F.col("decision_time_ns"), slot_width(spark, d)), "risk_score", config,
    )
    return label_state(smoothed, config)


def ewma_state(spark, d):
    return senders(spark, d).select(
        "event_id", "agent_id", r6("ewma").alias("ewma"), "available", "previous_state",
        "current_state", "transition_reason",
    )


SQL_EWMA = with_sql(SQL_STATES, """
SELECT event_id, agent_id, round(ewma,6)+0.0 AS ewma, risk_score IS NOT NULL AS available,
 previous_state, current_state,
 (CASE WHEN current_state=previous_state THEN 'remained' ELSE 'transitioned' END)||':'||previous_state||'->'||current_state||':'||
 (CASE WHEN risk_score IS NULL AND ewma IS NULL THEN 'missing_evidence_no_prior'
   WHEN risk_score IS NULL THEN 'missing_evidence_prior_held_marked_unknown'
   WHEN e_prev IS NULL THEN 'initialized_from_first_available' ELSE 'updated' END) AS transition_reason
FROM states""", recursive=True)


def state_counts(spark, d):
    return senders(spark, d).groupBy("previous_state", "current_state").agg(
        F.count("*").alias("rows")
    )


SQL_STATE_COUNTS = with_sql(SQL_STATES, """
SELECT previous_state, current_state, count(*) AS rows FROM states GROUP BY 1,2""", recursive=True)


def ewma_slow(spark, d):
    """A small alpha with a configured start: long memory, same exact prefix sums."""
    out = senders(spark, d, Smoothing(alpha=0.01, initial_value=0.5))
    return out.select("event_id", r6("ewma").alias("ewma"))


SQL_EWMA_SLOW = with_sql(f"""{SQL_SCORED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY decision_time_ns) AS rn FROM predicted),
walk AS (SELECT agent_id, rn, CASE WHEN risk_score IS NOT NULL THEN 0.01::DOUBLE*risk_score+0.99::DOUBLE*0.5::DOUBLE END AS e FROM numbered WHERE rn=1
 UNION ALL SELECT n.agent_id, n.rn, CASE WHEN n.risk_score IS NULL THEN w.e
   ELSE 0.01::DOUBLE*n.risk_score+0.99::DOUBLE*coalesce(w.e,0.5::DOUBLE) END
 FROM walk w JOIN numbered n ON n.agent_id=w.agent_id AND n.rn=w.rn+1)""", """
SELECT event_id, round(e,6)+0.0 AS ewma FROM numbered JOIN walk USING (agent_id, rn)""", recursive=True)


def _items():
    return [
        Item("kinematic_residual_m", F.col("kinematic_error_m"),
             reason=F.when(F.col("kinematic_applicable"), "out_of_range").otherwise("not_applicable"),
             applicable=F.col("kinematic_applicable")),
        Item("maximum_object_suspicion", F.col("two_sided_count_residual"), "unresolved_transform"),
        Item("peer_corroboration_score", F.col("peer_corroboration_score"), "insufficient_peers"),
        Item("message_present", F.col("message_present"), "missing_message"),
        Item("source_age_ns", F.col("decision_time_ns") - F.col("source_time_ns"), "missing_message"),
    ]


def long_evidence(spark, d):
    """Long evidence of the observations, keyed by event."""
    return to_long(observations(spark, d), ["event_id", "agent_id", "sync_frame_id"], _items())


def evidence_long(spark, d):
    return long_evidence(spark, d).select(
        "event_id", "evidence_name", r6("value").alias("value"), "applicable", "available",
        "reason_code",
    )


SQL_LONG_CTE = f"""{SQL_OBSERVATIONS}, evidence AS (
SELECT event_id, agent_id, sync_frame_id, 'kinematic_residual_m' AS evidence_name, kin AS value, applicable,
 CASE WHEN applicable THEN 'out_of_range' ELSE 'not_applicable' END AS why FROM observations
UNION ALL SELECT event_id, agent_id, sync_frame_id, 'maximum_object_suspicion', residual, true, 'unresolved_transform' FROM observations
UNION ALL SELECT event_id, agent_id, sync_frame_id, 'peer_corroboration_score', peer, true, 'insufficient_peers' FROM observations
UNION ALL SELECT event_id, agent_id, sync_frame_id, 'message_present', message_present::INT::DOUBLE, true, 'missing_message' FROM observations
UNION ALL SELECT event_id, agent_id, sync_frame_id, 'source_age_ns', (decision_time_ns-source_time_ns)::DOUBLE, true, 'missing_message' FROM observations)"""

SQL_LONG = with_sql(SQL_LONG_CTE, """
SELECT event_id, evidence_name, round(value,6)+0.0 AS value, applicable, value IS NOT NULL AS available,
 CASE WHEN value IS NOT NULL THEN 'matched' ELSE why END AS reason_code FROM evidence""")


def evidence_wide(spark, d):
    """Per sender and day: largest suspicion, smallest of the others."""
    names = ["kinematic_residual_m", "maximum_object_suspicion", "peer_corroboration_score"]
    out = to_wide(
        long_evidence(spark, d), ["agent_id", "sync_frame_id"], names,
        largest=("maximum_object_suspicion",),
    )
    return out.select("agent_id", "sync_frame_id", *[r6(n).alias(n) for n in names])


SQL_WIDE = with_sql(SQL_OBSERVATIONS, """
SELECT agent_id, sync_frame_id, round(min(kin),6)+0.0 AS kinematic_residual_m,
 round(max(residual),6)+0.0 AS maximum_object_suspicion, round(min(peer),6)+0.0 AS peer_corroboration_score
FROM observations GROUP BY 1,2""")


def stable_order_query(spark, d):
    """Evidence in its stable order, with the place of each row made visible."""
    ordered = stable_order(
        long_evidence(spark, d), ["sync_frame_id", "agent_id", "event_id", "evidence_name"]
    )
    # sorted partitions follow each other, so this number grows along the order
    placed = stage(ordered.select(
        "sync_frame_id", "agent_id", "event_id", "evidence_name", r6("value").alias("value"), F.monotonically_increasing_id().alias("__at")
    ))
    return rank_in_key(placed, [], ["__at"], F.shiftright("__at", 33), "position").drop("__at")


SQL_STABLE = with_sql(SQL_LONG_CTE, """
SELECT sync_frame_id, agent_id, event_id, evidence_name, round(value,6)+0.0 AS value,
 row_number() OVER (ORDER BY sync_frame_id NULLS FIRST, agent_id NULLS FIRST, event_id NULLS FIRST, evidence_name NULLS FIRST) AS position FROM evidence""")


def playback_query(spark, d):
    """Roll-up of evidence per day and sender."""
    names = {"kinematic_residual_m": "kinematic_residual_m",
             "maximum_object_suspicion": "count_deficit_residual_development",
             "peer_corroboration_score": "count_surplus_residual_development"}
    renamed = F.col("evidence_name")
    for old, new in names.items():
        renamed = F.when(F.col("evidence_name") == old, new).otherwise(renamed)
    out = playback(long_evidence(spark, d).withColumn("evidence_name", renamed))
    return out.select(
        "sync_frame_id", "agent_id", r6("maximum_deficit").alias("maximum_deficit"),
        r6("maximum_surplus").alias("maximum_surplus"),
        r6("kinematic_residual_m").alias("kinematic_residual_m"), "kinematic_reason",
    )


SQL_PLAYBACK = with_sql(SQL_OBSERVATIONS, """
SELECT sync_frame_id, agent_id, round(max(residual),6)+0.0 AS maximum_deficit, round(max(peer),6)+0.0 AS maximum_surplus,
 round(min(kin),6)+0.0 AS kinematic_residual_m,
 min(CASE WHEN kin IS NOT NULL THEN 'matched' WHEN applicable THEN 'out_of_range' ELSE 'not_applicable' END) AS kinematic_reason
FROM observations GROUP BY 1,2""")

QUERIES = {
    "points_in_boxes": (points_in_boxes, SQL_POINTS_IN_BOXES),
    "mixed_boxes": (mixed_boxes, SQL_MIXED_BOXES),
    "count_residuals": (count_residuals_query, SQL_RESIDUALS),
    "peer_corroboration": (peer_corroboration, SQL_PEERS),
    "weakest_peer": (weakest_peer, SQL_WEAKEST),
    "suspicion_summary": (suspicion_summary, SQL_SUSPICION),
    "suspicion_by_agent": (suspicion_by_agent, SQL_SUSPICION_AGENT),
    "value_medians": (value_medians, SQL_VALUE_MEDIANS),
    "point_share": (point_share, SQL_SHARE),
    "cloud_summary": (cloud_summary_query, SQL_CLOUDS),
    "rigid_transform": (rigid_transform, SQL_RIGID),
    "visibility": (visibility, SQL_VISIBILITY),
    "risk_missing_aware": (risk_missing_aware, SQL_RISK),
    "risk_fixed": (risk_fixed, SQL_FIXED),
    "ewma_state": (ewma_state, SQL_EWMA),
    "state_counts": (state_counts, SQL_STATE_COUNTS),
    "ewma_slow": (ewma_slow, SQL_EWMA_SLOW),
    "evidence_long": (evidence_long, SQL_LONG),
    "evidence_wide": (evidence_wide, SQL_WIDE),
    "stable_order": (stable_order_query, SQL_STABLE),
    "playback": (playback_query, SQL_PLAYBACK),
}
