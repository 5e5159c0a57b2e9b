"""What-if overlays, dependencies, deltas and attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evidence_queries import SQL_LONG_CTE, long_evidence
from catalog.match_queries import SQL_KINEMATICS_CTE
from catalog.views import (
    slot_width, SQL_EVENT_BOXES, SQL_EVENT_POINTS, SQL_ODOMETRY, _mod, event_boxes, event_points, odometry,
    r6, sql_inside, table, ts_ns, with_sql,
)
from trustweave import schemas as S
from trustweave.operators import overlays as O
from trustweave.operators.joins import delta_problems, merge_delta
from trustweave.operators.metrics import coverage
from trustweave.operators.ordered import Running, running, time_slot
from trustweave.operators.spatial import count_in_boxes
from trustweave.sources.stage import stage

KEY = ["agent_id"]


def _targets(spark, d):
    """Every event that has a next one starts a target: its time and the user's next sample time."""
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), "event_id", ts_ns().alias("time_ns")
    )
    rows = running(
        rows, KEY, ["time_ns"], time_slot(F.col("time_ns"), slot_width(spark, d)),
        [Running("next", F.struct("time_ns"), reverse=True, include_current=False)],
    )
    return rows.filter(F.col("next").isNotNull()).select(
        F.col("event_id").cast("string").alias("target_id"), "agent_id",
        F.array("time_ns", "next.time_ns").alias("sample_times_ns"),
    )


# The user's parameter grid.
GRID = [
    {"kind": "velocity_spike", "duration_samples": 1, "severity": "mild", "delta_v_mps": (1.0, 0.0, 0.0)},
    {"kind": "velocity_drift", "duration_samples": 2, "severity": "severe", "delta_v_mps": (0.004, -0.002, 0.0)},
]


def _specs(spark, d):
    return O.build_series_specs(_targets(spark, d), GRID)


SQL_SPECS_CTE = f"""{SQL_ODOMETRY},
nx AS (SELECT *, lead(time_ns) OVER (PARTITION BY agent_id ORDER BY time_ns) AS t_next,
  lag(time_ns) OVER (PARTITION BY agent_id ORDER BY time_ns) AS t_prev FROM odometry),
specs AS (SELECT event_id||'-'||kind||'-'||k||'-'||severity AS variant_id, event_id::VARCHAR AS target_id, agent_id, kind, k, severity, ax, ay, time_ns AS s0, t_next AS s1
  FROM nx, (SELECT 'velocity_spike' AS kind, 1 AS k, 'mild' AS severity, 1.0::DOUBLE AS ax, 0.0::DOUBLE AS ay
            UNION ALL SELECT 'velocity_drift', 2, 'severe', 0.004::DOUBLE, -0.002::DOUBLE)
  WHERE t_next IS NOT NULL),
changes AS (SELECT variant_id, agent_id, s0 AS time_ns, 0 AS ord, CASE WHEN kind='velocity_drift' THEN 1.0::DOUBLE/k ELSE 1 END AS f, ax, ay FROM specs
  UNION ALL SELECT variant_id, agent_id, s1, 1, 1.0, ax, ay FROM specs WHERE k=2)"""


def spec_build(spark, d):
    return _specs(spark, d).select(
        "variant_id", "target_id", "agent_id", "kind", "severity",
        F.array_join("interval_sample_times_ns", ",").alias("times"),
    )


SQL_SPEC_BUILD = with_sql(SQL_SPECS_CTE, """
SELECT variant_id, target_id, agent_id, kind, severity, CASE WHEN k=1 THEN s0::VARCHAR ELSE s0||','||s1 END AS times FROM specs""")


def _changes(spark, d, specs=None):
    specs = _specs(spark, d) if specs is None else specs
    return O.velocity_changes(odometry(spark, d), specs, KEY, slot_ns=slot_width(spark, d))


def velocity_overlay(spark, d):
    return _changes(spark, d).select(
        "variant_id", "agent_id", "time_ns", F.col("order").cast("bigint").alias("order"),
        r6("perturbed_velocity_mps.x").alias("vx"), r6("perturbed_velocity_mps.y").alias("vy"),
        r6("applied_delta_mps.x").alias("ax"), "in_sequence",
    )


SQL_OVERLAY = with_sql(SQL_SPECS_CTE, """
SELECT c.variant_id, c.agent_id, c.time_ns, c.ord::BIGINT AS "order", round(o.vx+c.f*c.ax,6)+0.0 AS vx,
 round(o.vy+c.f*c.ay,6)+0.0 AS vy, round(c.f*c.ax,6)+0.0 AS ax, true AS in_sequence
FROM changes c JOIN odometry o USING (agent_id, time_ns)""")


def spillover_keys(spark, d):
    series = odometry(spark, d).join(
        table(spark, d, "events").select(
            F.col("user_id").cast("string").alias("agent_id"), ts_ns().alias("time_ns"),
            (_mod("event_id", 13) == 0).alias("changed"),
        ), ["agent_id", "time_ns"],
    )
    return O.spillover(series, KEY, "changed", slot_ns=slot_width(spark, d)).select("agent_id", "time_ns", "affected")


SQL_SPILLOVER = """WITH s AS (SELECT user_id::VARCHAR AS agent_id, epoch_us(ts)*1000 AS time_ns, event_id%13=0 AS changed FROM events),
l AS (SELECT *, lag(changed) OVER (PARTITION BY agent_id ORDER BY time_ns) AS before FROM s)
SELECT agent_id, time_ns, before IS NOT NULL AND (changed OR before) AS affected FROM l"""


def _recomputed(spark, d, specs=None):
    return O.recompute_series(
        odometry(spark, d), _changes(spark, d, specs), KEY, max_gap_s=86400.0, slot_ns=slot_width(spark, d)
    )


def incremental_series(spark, d):
    """Clean and perturbed residual of the affected intervals only."""
    return _recomputed(spark, d).select(
        "variant_id", "agent_id", "time_ns", F.col("clean.reason_code").alias("reason_code"),
        r6("clean.residual_m").alias("clean_residual"),
        r6("perturbed.residual_m").alias("perturbed_residual"),
        (F.round("perturbed.speed_mps", 9) + F.lit(0.0)).alias("perturbed_speed"),
    )


SQL_INCREMENTAL_CTE = SQL_SPECS_CTE + ",\n" + SQL_KINEMATICS_CTE.replace(SQL_ODOMETRY + ",\n", "") + """,
ends AS (SELECT variant_id, agent_id, time_ns FROM changes UNION
  SELECT c.variant_id, c.agent_id, n.time_ns FROM changes c JOIN nx n ON n.agent_id=c.agent_id AND n.t_prev=c.time_ns),
hit AS (SELECT e.variant_id, k.*, vx+coalesce(c1.f*c1.ax,0) AS wx, vy+coalesce(c1.f*c1.ay,0) AS wy,
  vx0+coalesce(c0.f*c0.ax,0) AS wx0, vy0+coalesce(c0.f*c0.ay,0) AS wy0
  FROM ends e JOIN kin k USING (agent_id, time_ns)
  LEFT JOIN changes c1 ON c1.variant_id=e.variant_id AND c1.agent_id=k.agent_id AND c1.time_ns=k.time_ns
  LEFT JOIN changes c0 ON c0.variant_id=e.variant_id AND c0.agent_id=k.agent_id AND c0.time_ns=k.t0 WHERE k.t0 IS NOT NULL),
re AS (SELECT *, sqrt((px-px0-dt*((wx+wx0)/2*mc-(wy+wy0)/2*ms))**2+(py-py0-dt*((wx+wx0)/2*ms+(wy+wy0)/2*mc))**2) AS res1,
  0.5::DOUBLE*(sqrt(wx*wx+wy*wy)+sqrt(wx0*wx0+wy0*wy0)) AS speed1 FROM hit)"""

SQL_INCREMENTAL = with_sql(SQL_INCREMENTAL_CTE, """
SELECT variant_id, agent_id, time_ns, reason_code, CASE WHEN reason_code='matched' THEN round(res,6)+0.0 END AS clean_residual,
 CASE WHEN reason_code='matched' THEN round(res1,6)+0.0 END AS perturbed_residual,
 CASE WHEN reason_code='matched' THEN round(speed1,9)+0.0 END AS perturbed_speed FROM re""")


def _frames(spark, d):
    """Event frames whose source time is the event's own time."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), F.col("event_id").alias("sync_frame_id"),
        ts_ns().alias("source_time_ns"),
    )


def series_dependencies(spark, d):
    return O.series_dependency_counts(_recomputed(spark, d), _frames(spark, d), KEY)


SQL_DEPENDENCIES = with_sql(SQL_INCREMENTAL_CTE, """
SELECT variant_id, evidence_name, count(*) AS keys FROM re, (SELECT unnest(['kinematic_dt_s','kinematic_speed_mps','kinematic_acceleration_mps2',
 'kinematic_yaw_change_rad','kinematic_residual_m','unknown_aware_fixed_risk_uncalibrated']) AS evidence_name) GROUP BY 1,2""")


SERIES_NAMES = (*S.KINEMATIC_EVIDENCE, "unknown_aware_fixed_risk_uncalibrated")


def _evidence(spark, d):
    e = long_evidence(spark, d)
    return e.select(
        "agent_id", F.col("event_id").alias("sync_frame_id"), F.lit(None).cast("string").alias("object_key"),
        "evidence_name", "value", "available", "reason_code",
    )


def _series_base(spark, d):
    """Base evidence of each event: the six names a series overlay replaces (some rows are
    lacking) and the two that the risk reads besides."""
    e = F.col("event_id")
    value = lambda i: F.when(_mod(e, 6) != 0, _mod(e * (i + 3), 50) / 10.0)
    rows = [F.struct(F.lit(n).alias("evidence_name"), value(i).alias("value"), (_mod(e + i, 9) != 0).alias("there")) for i, n in enumerate(SERIES_NAMES)]
    rows += [
        F.struct(F.lit(n).alias("evidence_name"), v.alias("value"), F.lit(True).alias("there"))
        for n, v in (("maximum_object_suspicion", _mod(e, 30) / 10.0), ("peer_corroboration_score", _mod(e, 4) / 4.0))
    ]
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("agent_id"), e.alias("sync_frame_id"),
        F.lit(None).cast("string").alias("object_key"), F.inline(F.array(*rows)),
    ).filter("there").drop("there").withColumns({
        "available": F.col("value").isNotNull(),
        "reason_code": F.when(F.col("value").isNotNull(), "matched").otherwise("out_of_range"),
    })


def _delta(spark, d):
    return O.series_delta(_series_base(spark, d), _recomputed(spark, d), _frames(spark, d), KEY)


def _digits(c):
    """Nine decimals of small values, six of large ones: the same number of true digits."""
    v = F.col(c)
    return F.when(F.abs(v) < 10, F.round(v, 9) + F.lit(0.0)).otherwise(r6(v))


def series_delta(spark, d):
    """Evidence delta: the rows of six names that a velocity overlay replaces."""
    delta, _ = _delta(spark, d)
    return delta.select(
        "overlay_id", "sync_frame_id", "evidence_name", _digits("value").alias("value"),
        "available", "reason_code", "changed",
    )


def series_delta_problems(spark, d):
    """Keys that an overlay reaches but the base has no row for."""
    _, missing = _delta(spark, d)
    return missing.select("overlay_id", "agent_id", "sync_frame_id", "evidence_name", "problem")


SQL_DELTA_CTE = SQL_INCREMENTAL_CTE + """,
long AS (SELECT variant_id, agent_id, event_id, reason_code='matched' AS ok, u.i AS i, u.n AS n, u.v AS v FROM (SELECT *, unnest([
  {'i': 0, 'n': 'kinematic_dt_s', 'v': dt}, {'i': 1, 'n': 'kinematic_speed_mps', 'v': speed1},
  {'i': 2, 'n': 'kinematic_acceleration_mps2', 'v': sqrt((wx-wx0)**2+(wy-wy0)**2)/dt}, {'i': 3, 'n': 'kinematic_yaw_change_rad', 'v': dyaw},
  {'i': 4, 'n': 'kinematic_residual_m', 'v': res1},
  {'i': 5, 'n': 'unknown_aware_fixed_risk_uncalibrated', 'v': 1-(0.4::DOUBLE*(1-least(res1/0.057::DOUBLE,1))
    +0.3::DOUBLE*(1-least((event_id%30)/10.0::DOUBLE/3.0::DOUBLE,1))+0.3::DOUBLE*((event_id%4)/4.0::DOUBLE))}]) AS u FROM re))"""

SQL_DELTA = with_sql(SQL_DELTA_CTE, """
SELECT variant_id AS overlay_id, event_id AS sync_frame_id, n AS evidence_name, CASE WHEN ok THEN CASE WHEN abs(v)<10 THEN round(v,9) ELSE round(v,6) END+0.0 END AS value, ok AS available,
 CASE WHEN ok THEN 'matched' ELSE 'incomplete_evidence' END AS reason_code,
 new IS DISTINCT FROM old AND coalesce(abs(new-old)>1e-9::DOUBLE*greatest(1.0::DOUBLE,abs(old)), true) AS changed
FROM (SELECT *, CASE WHEN ok THEN v END AS new, CASE WHEN event_id%6<>0 THEN ((event_id*(i+3))%50)/10.0::DOUBLE END AS old FROM long) t WHERE (event_id+i)%9<>0""")

SQL_DELTA_PROBLEMS = with_sql(SQL_DELTA_CTE, """
SELECT variant_id AS overlay_id, agent_id, event_id AS sync_frame_id, n AS evidence_name, 'no_base_row' AS problem FROM long WHERE (event_id+i)%9=0""")


def _attempts(spark, d):
    """Attempts of all specs; every fifth target's overlay is reported as failed."""
    made = stage(_specs(spark, d))
    specs = made.withColumn(
        "problem", F.when(_mod(F.col("target_id").cast("bigint"), 5) == 0, "sample_unavailable")
    ).withColumn(
        "agent_type", F.when(_mod(F.col("agent_id").cast("bigint"), 2) == 0, "vehicle").otherwise("infrastructure")
    )
    return O.attempts(specs, O.series_effects(_recomputed(spark, d, made)))


def attempts_query(spark, d):
    return _attempts(spark, d).select(
        "variant_id", "status", "reason_code", "injection_succeeded",
        r6("maximum_effect").alias("maximum_effect"), "realized_effect_band",
    )


SQL_ATTEMPTS_CTE = SQL_INCREMENTAL_CTE + """,
eff AS (SELECT variant_id, coalesce(max(abs(CASE WHEN reason_code='matched' THEN res1-res END)),0) AS m FROM re GROUP BY 1),
att AS (SELECT s.*, coalesce(m,0) AS m, target_id::BIGINT%5=0 AS failed FROM specs s LEFT JOIN eff USING (variant_id)),
att2 AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN m=0 THEN 'zero_effect' WHEN m<0.01 THEN 'low_effect' ELSE 'succeeded' END AS status,
 CASE WHEN m=0 THEN 'zero' WHEN m<0.1 THEN 'low' ELSE 'material' END AS band FROM att)"""

SQL_ATTEMPTS = with_sql(SQL_ATTEMPTS_CTE, """
SELECT variant_id, status, CASE WHEN failed THEN 'sample_unavailable' WHEN m=0 THEN 'no_evidence_change' ELSE 'applied' END AS reason_code,
 NOT failed AS injection_succeeded, round(m,6)+0.0 AS maximum_effect, band AS realized_effect_band FROM att2""")


def attempt_coverage(spark, d):
    """Coverage over the recorded attempts: failures stay in the denominator."""
    return coverage(stage(_attempts(spark, d)))


SQL_ATTEMPT_COVERAGE = with_sql(SQL_ATTEMPTS_CTE, """
SELECT 'total' AS dimension, NULL::VARCHAR AS value, count(*) AS attempts FROM att2
UNION ALL SELECT 'family', 'kinematic', count(*) FROM att2
UNION ALL SELECT 'severity', severity, count(*) FROM att2 GROUP BY severity
UNION ALL SELECT 'agent_type', CASE WHEN agent_id::BIGINT%2=0 THEN 'vehicle' ELSE 'infrastructure' END, count(*) FROM att2 GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM att2 GROUP BY status
UNION ALL SELECT 'realized_effect_band', band, count(*) FROM att2 GROUP BY band""")


def unresolved_targets(spark, d):
    """Specs whose (agent, time) target is not exactly one clean frame row."""
    specs = _targets(spark, d).select(
        F.col("target_id").alias("variant_id"), "agent_id",
        (F.col("sample_times_ns")[0] + F.when(_mod(F.col("target_id").cast("bigint"), 3) == 0, 1).otherwise(0)).alias("source_time_ns"),
    )
    return O.resolve_targets(specs, _frames(spark, d), ["agent_id", "source_time_ns"])


SQL_UNRESOLVED = with_sql(SQL_SPECS_CTE, """
SELECT DISTINCT target_id AS variant_id, agent_id, s0+1 AS source_time_ns, 0::BIGINT AS matches FROM specs WHERE target_id::BIGINT%3=0""")


# -- delta merge -----------------------------------------------------------------

DELTA_KEYS = ["sync_frame_id", "object_key", "evidence_name"]


def delta_merge(spark, d):
    """Replace rows by null-safe key: the object key is null on every row."""
    base = _evidence(spark, d)
    e = F.col("sync_frame_id")
    delta = base.filter(_mod(e, 10) == 3).withColumns({
        "value": F.when(_mod(e, 20) != 3, F.coalesce("value", F.lit(0.0)) + 1),
        "available": _mod(e, 20) != 3,
        "reason_code": F.when(_mod(e, 20) != 3, "matched").otherwise("incomplete_evidence"),
    })
    out = merge_delta(base, delta, DELTA_KEYS, verify=False)
    return out.select("sync_frame_id", "evidence_name", r6("value").alias("value"), "available", "reason_code")


SQL_MERGE = with_sql(SQL_LONG_CTE, """
SELECT event_id AS sync_frame_id, evidence_name,
 CASE WHEN event_id%20=3 THEN NULL WHEN event_id%10=3 THEN round(coalesce(value,0)+1,6)+0.0 ELSE round(value,6)+0.0 END AS value,
 CASE WHEN event_id%20=3 THEN false WHEN event_id%10=3 THEN true ELSE value IS NOT NULL END AS available,
 CASE WHEN event_id%20=3 THEN 'incomplete_evidence' WHEN event_id%10=3 THEN 'matched' WHEN value IS NOT NULL THEN 'matched' ELSE why END AS reason_code
FROM evidence""")


def delta_audit(spark, d):
    """A delta with unknown and repeated keys, against a base with repeated keys."""
    base = _evidence(spark, d).filter(_mod("sync_frame_id", 4) != 1)
    base = base.unionByName(base.filter(_mod("sync_frame_id", 50) == 0))
    delta = _evidence(spark, d).filter(_mod("sync_frame_id", 10) == 3)
    delta = delta.unionByName(delta.filter(_mod("sync_frame_id", 60) == 3))
    return delta_problems(base, delta, DELTA_KEYS).select("sync_frame_id", "evidence_name", "problem")


SQL_DELTA_AUDIT = with_sql(SQL_LONG_CTE, """
SELECT event_id AS sync_frame_id, evidence_name, 'duplicate_base' AS problem FROM evidence WHERE event_id%4<>1 AND event_id%50=0
UNION ALL SELECT event_id, evidence_name, 'duplicate_delta' FROM evidence WHERE event_id%60=3
UNION ALL SELECT event_id, evidence_name, 'unknown_key' FROM evidence WHERE event_id%10=3 AND event_id%4=1""")


# -- point overlays --------------------------------------------------------------

def _removed(spark, d):
    return O.removal_choice(event_points(spark, d), event_boxes(spark, d), ["frame"], ["event_id"])


def remove_points(spark, d):
    return _removed(spark, d).select("variant_id", "frame", "event_id")


SQL_REMOVED_CTE = f"""{SQL_EVENT_POINTS}, {SQL_EVENT_BOXES},
ins AS (SELECT b.variant_id, p.frame, p.event_id, b.seed, b.removal_fraction AS f FROM event_points p JOIN event_boxes b ON p.frame=b.frame AND {sql_inside()}),
rk AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY md5(seed||'|'||event_id), event_id) AS rn, count(*) OVER (PARTITION BY variant_id) AS n FROM ins),
removed AS (SELECT variant_id, frame, event_id FROM rk WHERE rn<=floor(f*n))"""

SQL_REMOVE = with_sql(SQL_REMOVED_CTE, "SELECT variant_id, frame, event_id FROM removed")


def remaining_points(spark, d):
    left = O.remove_points(event_points(spark, d), _removed(spark, d), ["event_id"])
    return left.groupBy("frame").agg(F.count("*").alias("points"))


SQL_REMAINING = with_sql(SQL_REMOVED_CTE, """
SELECT frame, count(*) AS points FROM event_points WHERE event_id NOT IN (SELECT event_id FROM removed) GROUP BY frame""")


def add_points(spark, d):
    """Seeded points in each user's box, further fields filled with the cloud's median."""
    added = O.added_points(event_boxes(spark, d), ["frame"], chunk=2)
    full = O.fill_fields(added, event_points(spark, d), ["frame"], ["intensity", "ring"])
    return full.select(
        "variant_id", "frame", "draw", *[r6(c).alias(c) for c in "xyz"],
        r6("intensity").alias("intensity"), "ring",
    )


def _sql_uniform(axis: str) -> str:
    return f"(('0x'||substr(md5(seed||'|'||variant_id||'|'||draw||'|{axis}'),1,12))::BIGINT/281474976710656.0::DOUBLE-0.5)*s{axis}"


SQL_ADD = with_sql(f"""{SQL_EVENT_POINTS}, {SQL_EVENT_BOXES},
dr AS (SELECT b.*, unnest(range(n_add)) AS draw FROM event_boxes b),
lo AS (SELECT *, {_sql_uniform('x')} AS lx, {_sql_uniform('y')} AS ly, {_sql_uniform('z')} AS lz FROM dr),
md AS (SELECT frame, median(intensity) AS intensity, median(ring::DOUBLE) AS ring FROM event_points GROUP BY frame)""", """
SELECT variant_id, frame, draw, round(cos(yaw)*lx-sin(yaw)*ly+cx,6)+0.0 AS x, round(sin(yaw)*lx+cos(yaw)*ly+cy,6)+0.0 AS y,
 round(lz+cz,6)+0.0 AS z, round(intensity,6)+0.0 AS intensity, trunc(ring)::INTEGER AS ring FROM lo JOIN md USING (frame)""")


def _agent_points(spark, d):
    return event_points(spark, d).withColumn("agent", _mod("event_id", 5))


def _objects(spark, d):
    """Two overlapping boxes per user, each for all five agents."""
    base = event_boxes(spark, d).withColumn("agent", F.explode(F.array(*[F.lit(a).cast("bigint") for a in range(5)])))
    rows = base.withColumn("object", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.withColumn("center_x_m", F.col("center_x_m") + F.col("object")).withColumn(
        "eligible", _mod(F.col("frame") + F.col("agent") + F.col("object"), 7) != 0
    ).select(
        "frame", "agent", "object", "eligible", "center_x_m", "center_y_m", "center_z_m",
        "size_x_m", "size_y_m", "size_z_m", "yaw_rad",
    )


def _spatial_changes(spark, d):
    """Removal by one sender per user; its effect on both boxes."""
    points = _agent_points(spark, d)
    specs = event_boxes(spark, d).withColumn("agent", _mod("frame", 5))
    rows = O.removal_choice(points, specs, ["frame", "agent"], ["event_id"], carry=["x", "y", "z"])
    return O.changed_counts(
        _objects(spark, d), ["frame", "agent"], ["object"], removed_points=rows
    )


def _clean_counts(spark, d):
    objects = _objects(spark, d)
    counts = count_in_boxes(_agent_points(spark, d), objects, ["frame", "agent"], ["object"])
    return counts.join(objects.select("frame", "agent", "object", "eligible"), ["frame", "agent", "object"])


def incremental_spatial(spark, d):
    """Peer statistics of all agents, for affected objects only."""
    out = O.recompute_peers(
        stage(_clean_counts(spark, d)), stage(_spatial_changes(spark, d)), ["frame", "object"], "agent"
    )
    return out.select(
        "variant_id", "frame", F.col("object").cast("bigint").alias("object"), "agent", "point_count",
        "peer_reason", "eligible_peer_count", "positive_peer_count",
        r6("peer_disagreement").alias("disagreement"), r6("peer_corroboration_score").alias("score"),
    )


SQL_SPATIAL_CTE = f"""{SQL_EVENT_POINTS}, {SQL_EVENT_BOXES},
ins AS (SELECT b.variant_id, p.frame, p.event_id, b.seed, b.removal_fraction AS f FROM event_points p JOIN event_boxes b
  ON p.frame=b.frame AND p.event_id%5=b.frame%5 AND {sql_inside()}),
rk AS (SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY md5(seed||'|'||event_id), event_id) AS rn, count(*) OVER (PARTITION BY variant_id) AS n FROM ins),
removed AS (SELECT event_id FROM rk WHERE rn<=floor(f*n)),
objs AS (SELECT variant_id, frame, o AS object, a AS agent, cx+o AS cx, cy, cz, sx, sy, sz, yaw, (frame+a+o)%7<>0 AS eligible
  FROM event_boxes, (SELECT unnest([0,1]) AS o), (SELECT unnest([0,1,2,3,4]) AS a)),
cnt AS (SELECT b.variant_id, b.frame, b.object, b.agent, b.eligible, count(p.event_id) AS clean,
  count(p.event_id) FILTER (WHERE p.event_id NOT IN (SELECT event_id FROM removed)) AS now
  FROM objs b LEFT JOIN event_points p ON p.frame=b.frame AND p.event_id%5=b.agent AND {sql_inside()} GROUP BY 1,2,3,4,5),
hit AS (SELECT * FROM cnt WHERE (frame, object) IN (SELECT (frame, object) FROM cnt WHERE clean<>now)),
pp AS (SELECT a.variant_id, a.frame, a.object, a.agent, a.now AS n, a.eligible, p.now AS pc FROM hit a LEFT JOIN hit p ON p.frame=a.frame AND p.object=a.object AND p.agent<>a.agent AND p.eligible),
loc AS (SELECT variant_id, frame, object, agent, n, eligible, count(pc) AS peers, count(pc) FILTER (WHERE pc>0) AS positive, median(ln(1+pc::DOUBLE)) AS m FROM pp GROUP BY 1,2,3,4,5,6),
mad AS (SELECT pp.frame, pp.object, pp.agent, median(abs(ln(1+pp.pc::DOUBLE)-l.m)) AS mad FROM pp JOIN loc l USING (frame, object, agent) GROUP BY 1,2,3)"""

SQL_SPATIAL = with_sql(SQL_SPATIAL_CTE, """
SELECT variant_id, frame, object::BIGINT AS object, agent::BIGINT AS agent, n AS point_count,
 CASE WHEN eligible AND peers>=2 THEN 'matched' WHEN peers>=2 THEN 'visibility_unknown' ELSE 'insufficient_peers' END AS peer_reason,
 peers AS eligible_peer_count, positive AS positive_peer_count,
 CASE WHEN eligible AND peers>=2 THEN round(abs((ln(1+n::DOUBLE)-m)/greatest(1.4826*mad,0.25)),6)+0.0 END AS disagreement,
 CASE WHEN eligible AND peers>=2 THEN round(positive::DOUBLE/peers,6)+0.0 END AS score FROM loc JOIN mad USING (frame, object, agent)""")


def spatial_dependencies(spark, d):
    agents = _objects(spark, d).select("frame", "agent")
    out = O.spatial_dependencies(_spatial_changes(spark, d), agents, ["frame", "object"], ["frame"], "agent")
    return out.select("variant_id", "frame", F.col("object").cast("bigint").alias("object"), "agent", "evidence_name")


SQL_SPATIAL_DEPS = with_sql(SQL_SPATIAL_CTE, """
SELECT variant_id, frame, object::BIGINT AS object, agent::BIGINT AS agent, unnest(['point_count','count_deficit_residual_development','count_surplus_residual_development']) AS evidence_name FROM cnt WHERE clean<>now
UNION ALL SELECT DISTINCT variant_id, frame, object::BIGINT, a, unnest(['eligible_peer_count','positive_peer_count','peer_count_deficit_residual','peer_count_surplus_residual','peer_count_disagreement','peer_corroboration_score'])
 FROM cnt, (SELECT unnest([0::BIGINT,1,2,3,4]) AS a) WHERE clean<>now
UNION ALL SELECT DISTINCT variant_id, frame, NULL::BIGINT, a, unnest(['maximum_object_suspicion','median_object_suspicion','unknown_aware_fixed_risk_uncalibrated'])
 FROM cnt, (SELECT unnest([0::BIGINT,1,2,3,4]) AS a) WHERE clean<>now""")

QUERIES = {
    "spec_build": (spec_build, SQL_SPEC_BUILD),
    "velocity_overlay": (velocity_overlay, SQL_OVERLAY),
    "spillover_keys": (spillover_keys, SQL_SPILLOVER),
    "incremental_series": (incremental_series, SQL_INCREMENTAL),
    "series_dependencies": (series_dependencies, SQL_DEPENDENCIES),
    "series_delta": (series_delta, SQL_DELTA),
    "series_delta_problems": (series_delta_problems, SQL_DELTA_PROBLEMS),
    "attempts": (attempts_query, SQL_ATTEMPTS),
    "attempt_coverage": (attempt_coverage, SQL_ATTEMPT_COVERAGE),
    "unresolved_targets": (unresolved_targets, SQL_UNRESOLVED),
    "delta_merge": (delta_merge, SQL_MERGE),
    "delta_audit": (delta_audit, SQL_DELTA_AUDIT),
    "remove_points": (remove_points, SQL_REMOVE),
    "remaining_points": (remaining_points, SQL_REMAINING),
    "add_points": (add_points, SQL_ADD),
    "incremental_spatial": (incremental_spatial, SQL_SPATIAL),
    "spatial_dependencies": (spatial_dependencies, SQL_SPATIAL_DEPS),
}
