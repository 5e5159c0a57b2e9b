"""Packets, admission, fusion, metrics, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.evidence_queries import senders
from catalog.views import (
    slot_width, SQL_OBSERVATIONS, SQL_SCORED, SQL_STATES, _mod, observations, r6, table, with_sql,
)
from trustweave.operators.fusion import (
    admitted_packets, ego_only, mean_fusion, reconstruction_error,
)
from trustweave.operators.messaging import admit, build_packets, verify_packets
from trustweave.operators.metrics import completeness_problems, coverage, policy_totals
from trustweave.sources.stage import stage
from trustweave.plans.episode import EpisodeKeys, run_episode, score_senders
from trustweave.plans.whatif import compare_senders

IDENTITY = ["event_id", "agent_id", "sync_frame_id", "decision_time_ns", "source_time_ns"]
MAX_AGE = 100_000_000
KEYS = EpisodeKeys(sender=["case", "agent_id"], frame=["case", "frame"])


def packets_query(spark, d):
    return build_packets(observations(spark, d), IDENTITY).select(
        "event_id", "payload_sha256", "measured_size_bytes", "packet_sha256"
    )


SQL_PACKETS_CTE = """pl AS (SELECT *, '['||coalesce(kin,0.0)::VARCHAR||','||coalesce(residual,0.0)::VARCHAR||','||coalesce(peer,0.0)::VARCHAR||']' AS ptext
  FROM observations WHERE NOT is_ego AND message_present),
ph AS (SELECT *, sha256(ptext||chr(10)) AS payload_sha256 FROM pl),
wire AS (SELECT *, '{"agent_id":"'||agent_id||'","decision_time_ns":'||decision_time_ns||',"event_id":'||event_id||
  ',"local_confidence":'||local_confidence::VARCHAR||',"measured_size_bytes":' AS head,
  ',"payload":'||ptext||',"payload_sha256":"'||payload_sha256||'","source_time_ns":'||source_time_ns||',"sync_frame_id":'||sync_frame_id||'}' AS tail FROM ph),
sized AS (SELECT *, length(head)+length(tail)+1 AS base FROM wire),
packets AS (SELECT *, CASE WHEN length((base+2)::VARCHAR)<=2 THEN base+2 WHEN length((base+3)::VARCHAR)<=3 THEN base+3 ELSE base+4 END AS size FROM sized)"""

SQL_PACKETS = with_sql(f"{SQL_OBSERVATIONS}, {SQL_PACKETS_CTE}", """
SELECT event_id, payload_sha256, size AS measured_size_bytes, sha256(head||size||tail||chr(10)) AS packet_sha256 FROM packets""")


def verify_query(spark, d):
    """Every fifth payload, sixth size and seventh digest is tampered with."""
    packets = build_packets(observations(spark, d), IDENTITY)
    tampered = packets.withColumns({
        "payload": F.when(_mod("event_id", 5) == 0, F.transform("payload", lambda v: v + 1.0)).otherwise(F.col("payload")),
        "measured_size_bytes": F.col("measured_size_bytes") + F.when(_mod("event_id", 6) == 0, 1).otherwise(0),
        "packet_sha256": F.when(_mod("event_id", 7) == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("packet_sha256")),
    })
    return verify_packets(tampered, IDENTITY).select("event_id", "integrity_valid")


SQL_VERIFY = with_sql(SQL_OBSERVATIONS, """
SELECT event_id, event_id%5<>0 AND event_id%6<>0 AND event_id%7<>0 AS integrity_valid
FROM observations WHERE NOT is_ego AND message_present""")


def _schedule(spark, d):
    packets = build_packets(senders(spark, d), IDENTITY)
    packets = verify_packets(packets, IDENTITY).withColumn(
        "integrity_valid", F.col("integrity_valid") & (_mod("event_id", 31) != 0)
    )
    return admit(packets, max_source_age_ns=MAX_AGE)


def admission(spark, d):
    return _schedule(spark, d).select(
        "event_id", "policy", "source_age_ns", "admitted", "admitted_bytes", "reason_code"
    )


SQL_SCHEDULE_CTE = f"""{SQL_STATES}, {SQL_PACKETS_CTE.replace('FROM observations WHERE', 'FROM states WHERE')},
schedule AS (SELECT p.*, policy, decision_time_ns-source_time_ns AS source_age_ns,
  CASE WHEN event_id%31=0 AND $check THEN 'invalid_integrity' WHEN decision_time_ns-source_time_ns NOT BETWEEN 0 AND {MAX_AGE} THEN 'late'
   WHEN policy='hard_gate' AND current_state<>'normal' THEN 'hard_gated' ELSE 'admitted' END AS reason_code
  FROM packets p, (SELECT unnest(['full_share','hard_gate']) AS policy))"""

SQL_ADMISSION = with_sql(SQL_SCHEDULE_CTE.replace("$check", "true"), """
SELECT event_id, policy, source_age_ns, reason_code='admitted' AS admitted,
 CASE WHEN reason_code='admitted' THEN size ELSE 0 END AS admitted_bytes, reason_code FROM schedule""", recursive=True)


def admitted_bytes_by_day(spark, d):
    """Semi-join of packets with the admitting schedule, bytes per day and policy."""
    schedule = stage(_schedule(spark, d))
    packets = build_packets(observations(spark, d), IDENTITY)
    both = [
        admitted_packets(packets, schedule.filter(F.col("policy") == p), []).withColumn("policy", F.lit(p))
        for p in ("full_share", "hard_gate")
    ]
    return both[0].unionByName(both[1]).groupBy("sync_frame_id", "policy").agg(
        F.count("*").alias("packets"), F.sum("measured_size_bytes").alias("bytes")
    )


SQL_BYTES = with_sql(SQL_SCHEDULE_CTE.replace("$check", "true"), """
SELECT sync_frame_id, policy, count(*) AS packets, sum(size)::BIGINT AS bytes FROM schedule
WHERE reason_code='admitted' GROUP BY 1,2""", recursive=True)


# -- fusion over the embeddings --------------------------------------------------

def _contributions(spark, d):
    vectors = table(spark, d, "embeddings").select(
        F.col("label").alias("frame"), F.col("vec_id").cast("string").alias("agent_id"), "vec_id",
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    first = vectors.groupBy("frame").agg(F.min("vec_id").alias("ego"))
    rows = vectors.join(first, "frame")
    return rows.select(
        "frame", "agent_id", "vector", (F.col("vec_id") == F.col("ego")).alias("is_ego"),
        # ego of frame 3 is unusable; in frame 4 only the ego is aligned
        ((F.col("frame") != 3) | (F.col("vec_id") != F.col("ego"))).alias("valid"),
        ((F.col("frame") != 4) | (F.col("vec_id") == F.col("ego"))).alias("aligned"),
        (_mod("vec_id", 11) / 10.0).alias("quality_score"),
        F.when((F.col("frame") != 5) | (_mod("vec_id", 2) == 0), _mod("vec_id", 7) / 10.0)
        .alias("predictive_uncertainty"),
    )


def _flat(fused):
    """Unfold the fused vector so that only plain columns are compared."""
    return fused.select(
        *[c for c in fused.columns if c != "fused_vector"],
        F.posexplode_outer("fused_vector").alias("pos", "__v"),
    ).withColumn("value", r6("__v")).drop("__v").select(
        "frame", "reason", "abstained", "degraded", "contributor_count",
        "remote_contributor_count", r6("total_remote_weight").alias("weight"),
        r6("quality_score").alias("quality"), r6("predictive_uncertainty").alias("uncertainty"),
        "pos", "value",
    )


def mean_fusion_query(spark, d):
    return _flat(mean_fusion(_contributions(spark, d), ["frame"]))


def mean_fusion_wide(spark, d):
    """The same with a declared width: no unfolding, one shuffle."""
    return _flat(mean_fusion(_contributions(spark, d), ["frame"], width=64))


def ego_only_query(spark, d):
    return _flat(ego_only(_contributions(spark, d), ["frame"], width=64))


def fusion_without_ego(spark, d):
    return _flat(mean_fusion(_contributions(spark, d), ["frame"], width=64, require_ego=False))


SQL_CONTRIBUTIONS = """c AS (SELECT label AS frame, vec_id, embedding::DOUBLE[] AS v,
  vec_id=min(vec_id) OVER (PARTITION BY label) AS ego FROM embeddings),
u AS (SELECT *, (frame<>3 OR NOT ego) AND (frame<>4 OR ego) AS ok, (vec_id%11)/10.0::DOUBLE AS q,
  CASE WHEN frame<>5 OR vec_id%2=0 THEN (vec_id%7)/10.0::DOUBLE END AS un FROM c $only),
g AS (SELECT frame, count(*) FILTER (WHERE ego AND ok) AS e, count(*) FILTER (WHERE NOT ego AND ok) AS r,
  avg(q) FILTER (WHERE ok) AS q, count(*) FILTER (WHERE ok AND un IS NULL) AS unsure, avg(un) FILTER (WHERE ok) AS un FROM u GROUP BY frame),
x AS (SELECT frame, i-1 AS pos, avg(v[i]) AS value FROM (SELECT frame, v, unnest(range(1,65)) AS i FROM u WHERE ok) GROUP BY 1,2)"""


def _sql_fusion(need_ego: bool, only: str = "") -> str:
    use = "e>0" if need_ego else "e+r>0"
    none = "ego_absent" if need_ego else "no_contributor"
    deg = f"NOT ({use}) OR r=0" if need_ego else f"({use}) AND r=0"
    return with_sql(SQL_CONTRIBUTIONS.replace("$only", only), f"""
SELECT g.frame, CASE WHEN NOT ({use}) THEN '{none}' WHEN r=0 THEN 'ego_only_fallback' ELSE 'cooperative' END AS reason,
 NOT ({use}) AS abstained, {deg} AS degraded, CASE WHEN {use} THEN e+r ELSE 0 END AS contributor_count,
 CASE WHEN {use} THEN r ELSE 0 END AS remote_contributor_count,
 CASE WHEN {use} THEN round(r::DOUBLE/(e+r),6)+0.0 ELSE 0.0::DOUBLE END AS weight,
 CASE WHEN {use} THEN round(q,6)+0.0 END AS quality, CASE WHEN ({use}) AND unsure=0 THEN round(un,6)+0.0 END AS uncertainty,
 x.pos::INTEGER AS pos, round(x.value,6)+0.0 AS value
FROM g LEFT JOIN x ON x.frame=g.frame AND ({use})""")


def reconstruction(spark, d):
    """Fused vector of each label against the plain mean of all its vectors."""
    c = _contributions(spark, d)
    fused = mean_fusion(c, ["frame"], width=64)
    means = c.groupBy("frame").agg(
        F.array(*[F.avg(F.col("vector")[i]) for i in range(64)]).alias("clean_reference")
    )
    out = reconstruction_error(fused.join(means, "frame"))
    return out.select(
        "frame", r6("proxy_reconstruction_error").alias("error"), r6("proxy_utility").alias("utility")
    )


SQL_RECONSTRUCTION = with_sql(SQL_CONTRIBUTIONS.replace("$only", "") + """,
a AS (SELECT frame, i-1 AS pos, avg(v[i]) AS m FROM (SELECT frame, v, unnest(range(1,65)) AS i FROM u) GROUP BY 1,2),
er AS (SELECT x.frame, sqrt(sum((x.value-a.m)**2)) AS error FROM x JOIN a USING (frame, pos) JOIN g ON g.frame=x.frame AND g.e>0 GROUP BY x.frame)""",
 "SELECT g.frame, round(error,6)+0.0 AS error, round(1/(1+error),6)+0.0 AS utility FROM g LEFT JOIN er USING (frame)")


# -- episodes --------------------------------------------------------------------

def _cases(spark, d):
    """Clean observations and a copy in which intended targets report a large error."""
    clean = observations(spark, d).withColumn("case", F.lit("clean"))
    hit = F.col("intended_target") & F.col("message_present")
    bad = observations(spark, d).withColumn("case", F.lit("perturbed"))
    bad = bad.withColumns({
        "kinematic_error_m": F.when(hit, 0.057).otherwise(F.col("kinematic_error_m")),
        "payload": F.when(hit, F.array(F.lit(8.0), F.lit(8.0), F.lit(8.0))).otherwise(F.col("payload")),
    })
    both = clean.unionByName(bad)
    return both.withColumn("corrupted", (F.col("case") == "perturbed") & F.col("intended_target")).withColumn(
        "clean_reference", F.array(*[_mod(F.col("frame") + i, 4) / 4.0 for i in range(3)])
    )


def _episode(spark, d, replay):
    return run_episode(
        _cases(spark, d), KEYS, max_source_age_ns=MAX_AGE, width=3, replay=replay,
        slot_ns=slot_width(spark, d), packet_identity=IDENTITY, reference=None if replay else "clean_reference",
        digest=False,  # the queries below read reports only
    )


SQL_CASES = (
    SQL_STATES
    .replace("observations AS (", "base AS (", 1)
    .replace("parts AS (", """observations AS (SELECT *, 'clean' AS kase, kin AS k0, false AS corrupted,
  coalesce(kin,0.0) AS v0, coalesce(residual,0.0) AS v1, coalesce(peer,0.0) AS v2 FROM base
  UNION ALL SELECT * REPLACE (CASE WHEN intended_target AND message_present THEN 0.057::DOUBLE ELSE kin END AS kin), 'perturbed', kin, intended_target,
  CASE WHEN intended_target AND message_present THEN 8.0::DOUBLE ELSE coalesce(kin,0.0) END,
  CASE WHEN intended_target AND message_present THEN 8.0::DOUBLE ELSE coalesce(residual,0.0) END,
  CASE WHEN intended_target AND message_present THEN 8.0::DOUBLE ELSE coalesce(peer,0.0) END FROM base),
parts AS (""", 1)
    .replace("PARTITION BY agent_id", "PARTITION BY kase, agent_id")
    .replace("SELECT agent_id, rn, risk_score AS e", "SELECT kase, agent_id, rn, risk_score AS e")
    .replace("SELECT n.agent_id, n.rn", "SELECT n.kase, n.agent_id, n.rn")
    .replace("n.agent_id=w.agent_id", "n.kase=w.kase AND n.agent_id=w.agent_id")
    .replace("USING (agent_id, rn)", "USING (kase, agent_id, rn)")
)

SQL_EPISODE = f"""{SQL_CASES},
{SQL_PACKETS_CTE.replace('FROM observations WHERE', 'FROM states WHERE')
 .replace("coalesce(kin,0.0)::VARCHAR", "v0::VARCHAR").replace("coalesce(residual,0.0)::VARCHAR", "v1::VARCHAR")
 .replace("coalesce(peer,0.0)::VARCHAR", "v2::VARCHAR")},
schedule AS (SELECT p.*, policy, decision_time_ns-source_time_ns BETWEEN 0 AND {MAX_AGE} AND (policy='full_share' OR current_state='normal') AS admitted
  FROM packets p, (SELECT unnest(['full_share','hard_gate']) AS policy)),
sent AS (SELECT kase, frame, policy, sum(CASE WHEN admitted THEN size ELSE 0 END)::BIGINT AS admitted_bytes,
  sum(CASE WHEN admitted AND corrupted THEN size ELSE 0 END)::BIGINT AS corrupted_bytes,
  sum(CASE WHEN admitted AND actually_affected THEN size ELSE 0 END)::BIGINT AS affected_bytes FROM schedule GROUP BY 1,2,3),
frames AS (SELECT kase, frame, policy, count(*) AS observation_count, count(*) FILTER (WHERE NOT message_present) AS missing,
  count(risk_score) AS available, count(*)-count(risk_score) AS abstentions, max(risk_score) AS max_risk,
  count(*) FILTER (WHERE current_state='normal') AS n_normal, count(*) FILTER (WHERE current_state='quarantined') AS n_quarantined,
  count(*) FILTER (WHERE current_state='unknown') AS n_unknown,
  count(*) FILTER (WHERE NOT intended_target) AS honest, count(*) FILTER (WHERE NOT intended_target AND actually_affected) AS honest_hit
  FROM states, (SELECT unnest(['full_share','hard_gate']) AS policy) GROUP BY 1,2,3),
contrib AS (SELECT kase, frame, policy, true AS ego, v0, v1, v2 FROM states, (SELECT unnest(['full_share','hard_gate']) AS policy) WHERE is_ego AND message_present
  UNION ALL SELECT kase, frame, policy, false, v0, v1, v2 FROM schedule WHERE admitted),
fused AS (SELECT kase, frame, policy, count(*) FILTER (WHERE ego) AS e, count(*) FILTER (WHERE NOT ego) AS r, avg(v0) AS f0, avg(v1) AS f1, avg(v2) AS f2 FROM contrib GROUP BY 1,2,3),
full_frames AS (SELECT f.*, coalesce(e,0) AS e, coalesce(r,0) AS r, f0, f1, f2, coalesce(admitted_bytes,0) AS admitted_bytes,
  coalesce(corrupted_bytes,0) AS corrupted_bytes, coalesce(affected_bytes,0) AS affected_bytes,
  CASE WHEN e>0 THEN sqrt((f0-(frame%4)/4.0)**2+(f1-((frame+1)%4)/4.0)**2+(f2-((frame+2)%4)/4.0)**2) END AS error
  FROM frames f LEFT JOIN fused USING (kase, frame, policy) LEFT JOIN sent USING (kase, frame, policy))"""


def frame_metrics_query(spark, d):
    m = _episode(spark, d, replay=False).metrics
    count = lambda s: F.coalesce(F.col("state_counts")[s], F.lit(0))
    return m.select(
        "case", "frame", "policy", "observation_count", "missing_observation_count",
        "prediction_available_count", "abstention_count",
        r6("maximum_uncalibrated_risk").alias("max_risk"),
        count("normal").alias("n_normal"), count("quarantined").alias("n_quarantined"),
        count("unknown").alias("n_unknown"), "admitted_bytes", "corrupted_source_bytes",
        r6("proxy_reconstruction_error").alias("error"), r6("proxy_utility").alias("utility"),
        "fallback", "fusion_abstained",
    )


SQL_FRAME_METRICS = with_sql(SQL_EPISODE, """
SELECT kase AS "case", frame, policy, observation_count, missing AS missing_observation_count,
 available AS prediction_available_count, abstentions AS abstention_count, round(max_risk,6)+0.0 AS max_risk,
 n_normal, n_quarantined, n_unknown, admitted_bytes, corrupted_bytes AS corrupted_source_bytes,
 round(error,6)+0.0 AS error, round(1/(1+error),6)+0.0 AS utility, e=0 OR r=0 AS fallback, e=0 AS fusion_abstained FROM full_frames""", recursive=True)


def policy_totals_query(spark, d):
    out = policy_totals(_episode(spark, d, replay=False).metrics, ["case", "policy"])
    return out.withColumn("proxy_reconstruction_error", F.round("proxy_reconstruction_error", 4) + F.lit(0.0))


SQL_TOTALS = with_sql(SQL_EPISODE, """
SELECT kase AS "case", policy, sum(admitted_bytes)::BIGINT AS admitted_bytes, sum(corrupted_bytes)::BIGINT AS corrupted_source_bytes,
 round(coalesce(sum(error),0),4)+0.0 AS proxy_reconstruction_error, count(*) FILTER (WHERE e=0 OR r=0) AS fallback_count,
 count(*) FILTER (WHERE e=0) AS fusion_abstention_count FROM full_frames GROUP BY 1,2""", recursive=True)


def replay_compare(spark, d):
    """Clean and perturbed replay side by side; companions are kept."""
    return _episode(spark, d, replay=True).metrics.select(
        "case", "frame", "policy", "observation_count", "honest_companion_count",
        "actually_affected_honest_companion_count", "admitted_bytes", "affected_source_bytes",
        "fallback", "fusion_abstained",
    )


SQL_REPLAY = with_sql(SQL_EPISODE, """
SELECT kase AS "case", frame, policy, observation_count, honest AS honest_companion_count,
 honest_hit AS actually_affected_honest_companion_count, admitted_bytes, affected_bytes AS affected_source_bytes,
 e+r>0 AND r=0 AS fallback, e+r=0 AS fusion_abstained FROM full_frames""", recursive=True)


SENDER = ["sequence_id", "session_id", "sync_frame_id", "agent_id"]


def replay_delta(spark, d):
    """Clean against perturbed replay from a real delta: evidence is merged, widened and scored
    for both cases; every 23rd event's motion is replaced, every 29th is an intended target."""
    obs = observations(spark, d).withColumn("sync_frame_id", F.col("event_id"))
    frames = obs.select(*SENDER, "decision_time_ns", "source_time_ns", "message_present")
    values = {
        "kinematic_residual_m": "kinematic_error_m", "maximum_object_suspicion": "two_sided_count_residual",
        "peer_corroboration_score": "peer_corroboration_score",
    }
    rows = [F.struct(F.lit(n).alias("evidence_name"), F.col(c).alias("value")) for n, c in values.items()]
    rows.append(F.struct(F.lit("kinematic_modality_applicable").alias("evidence_name"), F.col("kinematic_applicable").cast("double").alias("value")))
    evidence = obs.select(*SENDER, F.lit(None).cast("string").alias("object_key"), F.inline(F.array(*rows)))
    hit = (_mod("sync_frame_id", 23) == 0) & (F.col("evidence_name") == "kinematic_residual_m")
    delta = evidence.filter(hit).withColumn("value", F.lit(0.05))
    senders = compare_senders(
        frames, stage(evidence), stage(delta), sender=SENDER, evidence_keys=[*SENDER, "object_key", "evidence_name"], ego="7",
        targets=frames.filter(_mod("sync_frame_id", 29) == 0), slot_ns=slot_width(spark, d),
    )
    return senders.select(
        "case", "sync_frame_id", "agent_id", "is_ego", "message_present", "kinematic_applicable", "intended_target", "actually_affected",
        r6("risk_score").alias("risk_score"), r6(F.col("payload")[0]).alias("motion"), r6(F.col("payload")[2]).alias("distrust"),
    )


SQL_REPLAY_DELTA = with_sql(
    SQL_SCORED.replace("observations AS (", "base AS (", 1).replace("parts AS (", """observations AS (SELECT *, 'clean' AS kase FROM base
  UNION ALL SELECT * REPLACE (CASE WHEN event_id%23=0 THEN 0.05::DOUBLE ELSE kin END AS kin), 'perturbed' FROM base),
parts AS (""", 1), """
SELECT kase AS "case", event_id AS sync_frame_id, agent_id, agent_id='7' AS is_ego, message_present, applicable AS kinematic_applicable, event_id%29=0 AS intended_target,
 kase='perturbed' AND event_id%23=0 AS actually_affected, round(risk_score,6)+0.0 AS risk_score, round(coalesce(kin,0),6)+0.0 AS motion, round(coalesce(1-peer,0),6)+0.0 AS distrust FROM predicted""")


def predictions_query(spark, d):
    """Prediction rows: risk only where a message exists and the score does not abstain."""
    obs = observations(spark, d).withColumn("reason_code", F.lit("missing_message"))
    out = score_senders(obs, EpisodeKeys(sender=["agent_id"], frame=["frame"]), slot_ns=slot_width(spark, d))
    return out.select(
        "event_id", r6("risk_score").alias("risk_score"),
        r6("operational_reliability").alias("reliability"), "abstained", "reason_code",
        "evidence_available",
    )


SQL_PREDICTIONS = with_sql(SQL_SCORED.replace("predicted AS", "predicted_ AS"), """
SELECT event_id, CASE WHEN message_present THEN round(risk,6)+0.0 END AS risk_score,
 CASE WHEN message_present THEN round(1-risk,6)+0.0 END AS reliability, NOT message_present OR abstained AS abstained,
 CASE WHEN NOT message_present THEN 'missing_message' WHEN abstained THEN 'incomplete_evidence' ELSE 'matched' END AS reason_code,
 message_present AS evidence_available FROM scored""")


def completeness(spark, d):
    """Senders with a prediction but no state row, and the reverse."""
    obs = observations(spark, d)
    predicted = obs.filter(_mod("event_id", 41) != 0)
    stated = obs.filter(_mod("event_id", 43) != 0)
    return completeness_problems(predicted, stated, ["frame", "agent_id"])


SQL_COMPLETENESS = with_sql(SQL_OBSERVATIONS, """
SELECT frame, agent_id, 'missing' AS difference FROM (SELECT frame, agent_id FROM observations WHERE event_id%41<>0 EXCEPT SELECT frame, agent_id FROM observations WHERE event_id%43<>0)
UNION ALL SELECT frame, agent_id, 'extra' FROM (SELECT frame, agent_id FROM observations WHERE event_id%43<>0 EXCEPT SELECT frame, agent_id FROM observations WHERE event_id%41<>0)""")


def coverage_query(spark, d):
    """Coverage of attempts: events stand in for attempts, by five dimensions."""
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("family"), _mod("event_id", 3).cast("string").alias("severity"),
        F.when(_mod("user_id", 2) == 0, "vehicle").otherwise("infrastructure").alias("agent_type"),
        F.when(_mod("event_id", 9) == 0, "failed").when(_mod("event_id", 7) == 0, "zero_effect")
        .otherwise("succeeded").alias("status"),
        F.when(_mod("event_id", 7) == 0, "zero").otherwise("material").alias("realized_effect_band"),
    )
    return coverage(rows)


SQL_COVERAGE = """WITH a AS (SELECT event_type AS family, (event_id%3)::VARCHAR AS severity,
 CASE WHEN user_id%2=0 THEN 'vehicle' ELSE 'infrastructure' END AS agent_type,
 CASE WHEN event_id%9=0 THEN 'failed' WHEN event_id%7=0 THEN 'zero_effect' ELSE 'succeeded' END AS status,
 CASE WHEN event_id%7=0 THEN 'zero' ELSE 'material' END AS realized_effect_band FROM events)
SELECT 'total' AS dimension, NULL::VARCHAR AS value, count(*) AS attempts FROM a
UNION ALL SELECT 'family', family, count(*) FROM a GROUP BY family
UNION ALL SELECT 'severity', severity, count(*) FROM a GROUP BY severity
UNION ALL SELECT 'agent_type', agent_type, count(*) FROM a GROUP BY agent_type
UNION ALL SELECT 'status', status, count(*) FROM a GROUP BY status
UNION ALL SELECT 'realized_effect_band', realized_effect_band, count(*) FROM a GROUP BY realized_effect_band"""

QUERIES = {
    "packets": (packets_query, SQL_PACKETS),
    "verify_packets": (verify_query, SQL_VERIFY),
    "admission": (admission, SQL_ADMISSION),
    "admitted_bytes": (admitted_bytes_by_day, SQL_BYTES),
    "mean_fusion": (mean_fusion_query, _sql_fusion(True)),
    "mean_fusion_wide": (mean_fusion_wide, _sql_fusion(True)),
    "ego_only": (ego_only_query, _sql_fusion(True, "WHERE ego")),
    "fusion_without_ego": (fusion_without_ego, _sql_fusion(False)),
    "reconstruction_error": (reconstruction, SQL_RECONSTRUCTION),
    "frame_metrics": (frame_metrics_query, SQL_FRAME_METRICS),
    "policy_totals": (policy_totals_query, SQL_TOTALS),
    "replay_compare": (replay_compare, SQL_REPLAY),
    "replay_delta": (replay_delta, SQL_REPLAY_DELTA),
    "predictions": (predictions_query, SQL_PREDICTIONS),
    "completeness": (completeness, SQL_COMPLETENESS),
    "coverage": (coverage_query, SQL_COVERAGE),
}
