"""Row contracts: valid records of every event with each rule broken in turn.

An event breaks the rule set of its number modulo the number of planted faults; all others
hold. The SQL twin lists the same events by that number alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.views import _mod, table
from trustweave import schemas as S
from trustweave.operators import contracts as C



def L(value) -> str:
    """SQL text of a value."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"double('{value}')"
    return f"'{value}'" if isinstance(value, str) else str(value)


def A(*parts: str) -> str:
    return f"array({', '.join(parts)})"


def _struct(**parts: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in parts.items()) + ")"


T = "(unix_micros(CAST(ts AS TIMESTAMP)) * 1000)"
NO_BIGINT, NO_TEXT, NO_DOUBLE = "CAST(NULL AS BIGINT)", "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
DIGEST = "sha2(CAST(event_id AS STRING), 256)"
NAN, ONE, ZERO = L(float("nan")), L(1.0), L(0.0)

IDENTITY = {
    "decision_time_ns": T, "source_time_ns": f"{T} - 5", "match_age_ns": "5L",
    "lookahead_buffer_ns": L(0), "match_policy": L(S.CAUSAL), "pose_source_time_ns": f"{T} - 7", "pose_age_ns": "7L",
}
#: (rules broken, changed columns)
MATCH_FAULTS = [
    (["source_and_age_together"], {"match_age_ns": NO_BIGINT}),
    (["age_is_decision_minus_source"], {"match_age_ns": L(6)}),
    (["causal_has_no_lookahead"], {"lookahead_buffer_ns": L(1)}),
    (["causal_is_not_in_the_future"], {"source_time_ns": f"{T} + 5", "match_age_ns": L(-5)}),
    (["buffered_has_lookahead"], {"match_policy": L(S.BUFFERED)}),
    (["buffered_within_lookahead"], {"match_policy": L(S.BUFFERED), "lookahead_buffer_ns": L(3), "source_time_ns": f"{T} + 5", "match_age_ns": L(-5)}),
    (["match_needs_a_policy"], {"match_policy": L(S.NO_POLICY)}),
    (["pose_and_age_together"], {"pose_age_ns": NO_BIGINT}),
    (["pose_age_is_decision_minus_pose"], {"pose_age_ns": L(8)}),
]



def _vec(x, y, z):
    return _struct(x=x, y=y, z=z)


BOX = ("center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad")


def _box(**other):
    return _struct(**{n: other.get(n, ONE) for n in BOX})


def _extrinsics(status, matrix):
    return _struct(status=L(status), matrix_4x4=matrix)


def _coverage(status, *sides):
    return _struct(status=L(status), **dict(zip(("horizontal_fov_deg", "vertical_fov_deg", "range_m"), sides)))


UNIT = A(*[A(*[L(float(i == j)) for j in range(4)]) for i in range(4)])
SHORT = A(A(ONE, ZERO))
NO_MATRIX = "CAST(NULL AS ARRAY<ARRAY<DOUBLE>>)"
TIMES = A("10L", "20L")
NO_TIMES, NO_DELTA = "CAST(NULL AS ARRAY<BIGINT>)", "CAST(NULL AS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>)"
QUATERNION = _struct(x=ZERO, y=ZERO, z=ZERO, w=ONE)
POINTS = {  # a point overlay in place of the motion
    "family": L("spatial_support"), "expected_modality": L("spatial"), "delta_v_mps": NO_DELTA, "interval_sample_times_ns": NO_TIMES, "object_key": L("0"),
}
ADDING = {**POINTS, "kind": L("point_addition"), "n_add": L(3)}
REMOVING = {**POINTS, "kind": L("point_removal"), "removal_fraction": L(0.5)}

FAMILIES = {
    "contract_poses": (C.pose_sample_rules, {
        "time_ns": T, "translation_m": _vec(ONE, ONE, ZERO), "quaternion_xyzw": QUATERNION,
    }, [
        (["time_ns_nonnegative"], {"time_ns": L(-1)}),
        (["pose_finite"], {"translation_m": _vec(NAN, ONE, ZERO)}),
        (["pose_unit_length"], {"quaternion_xyzw": _struct(**{p: L(0.6) for p in "xyzw"})}),
    ]),
    "contract_odometry": (C.odometry_rules, {
        "time_ns": T, "header_time_ns": T, "position_m": _vec(ONE, ZERO, ZERO),
        "quaternion_xyzw": QUATERNION, "body_velocity_mps": _vec(ONE, ZERO, ZERO),
    }, [
        (["time_ns_nonnegative", "header_time_agrees"], {"time_ns": L(-1)}),
        (["header_time_agrees"], {"header_time_ns": f"{T} + 1"}),
        (["values_finite"], {"body_velocity_mps": _vec(L(float("inf")), ZERO, ZERO)}),
    ]),
    "contract_objects": (C.object_rules, {
        **IDENTITY, "object_key": L("0"), "object_key_kind": L("stable_id"), "source_kind": L("oracle_gt"), "oracle_gt": L(True),
    }, [
        *MATCH_FAULTS,
        (["object_key_not_empty"], {"object_key": L("")}),
        (["object_key_kind_known"], {"object_key_kind": L("number")}),
        (["source_kind_known"], {"source_kind": L("rumour"), "oracle_gt": L(False)}),
        (["oracle_flag_agrees"], {"oracle_gt": L(False)}),
    ]),
    "contract_evidence": (C.evidence_rules, {
        **IDENTITY, "evidence_level": L("frame"), "evidence_name": L("n"), "object_key": NO_TEXT, "value": ONE, "available": L(True), "applicable": L(True), "reason_code": L("matched"),
    }, [
        *MATCH_FAULTS,
        (["evidence_level_known"], {"evidence_level": L("scene")}),
        (["evidence_name_not_empty"], {"evidence_name": L("")}),
        (["frame_evidence_has_no_object"], {"object_key": L("0")}),
        (["object_evidence_has_object"], {"evidence_level": L("object")}),
        (["available_has_value"], {"value": NO_DOUBLE}),
        (["available_has_source"], {"source_time_ns": NO_BIGINT, "match_age_ns": NO_BIGINT}),
        (["available_is_matched"], {"reason_code": L("stale")}),
        (["inapplicable_says_so"], {"applicable": L(False), "available": L(False), "value": NO_DOUBLE}),
        (["value_finite"], {"value": NAN}),
    ]),
    "contract_predictions": (C.prediction_rules, {
        "risk_score": L(0.25), "operational_reliability": L(0.75), "predictive_uncertainty": NO_DOUBLE, "uncertainty_available": L(False), "abstained": L(False),
        "calibration_status": L("uncalibrated"), "calibrated_p_attack": NO_DOUBLE, "risk_semantics": L("uncalibrated_attack_risk_score"),
    }, [
        (["risk_score_in_unit_interval"], {"risk_score": L(1.5), "operational_reliability": L(-0.5)}),
        (["risk_and_reliability_together"], {"risk_score": NO_DOUBLE, "abstained": L(True)}),
        (["reliability_is_one_minus_risk"], {"operational_reliability": L(0.5)}),
        (["uncertainty_flag_agrees"], {"uncertainty_available": L(True)}),
        (["abstained_without_risk"], {"abstained": L(True)}),
        (["uncalibrated_has_no_probability"], {"calibrated_p_attack": L(0.25)}),
        (["calibrated_has_probability", "probability_equals_risk"], {"calibration_status": L("calibrated"), "risk_semantics": L("calibrated_attack_probability")}),
        (["probability_equals_risk"], {"calibration_status": L("calibrated"), "risk_semantics": L("calibrated_attack_probability"), "calibrated_p_attack": L(0.5)}),
    ]),
    "contract_states": (C.state_rules, {
        "input_available": L(True), "input_risk_score": L(0.5), "ewma_risk_score": L(0.5), "previous_state": L("normal"), "current_state": L("quarantined"), "transition_reason": L("t"),
    }, [
        (["input_flag_agrees"], {"input_available": L(False)}),
        (["input_risk_score_in_unit_interval"], {"input_risk_score": L(2.0)}),
        (["ewma_risk_score_in_unit_interval"], {"ewma_risk_score": L(-1.0)}),
        (["previous_state_known"], {"previous_state": L("lost")}),
        (["current_state_known"], {"current_state": L("lost")}),
        (["transition_reason_not_empty"], {"transition_reason": L("")}),
    ]),
    "contract_packets": (C.packet_rules, {
        "sender_id": L("a"), "agent_id": L("a"), "source_time_ns": T, "payload": A(ONE), "measured_size_bytes": L(9), "payload_sha256": DIGEST, "packet_sha256": DIGEST, "local_confidence": ONE,
    }, [
        (["sender_is_agent"], {"sender_id": L("b")}),
        (["packet_has_source"], {"source_time_ns": NO_BIGINT}),
        (["payload_finite"], {"payload": A(NAN)}),
        (["size_positive"], {"measured_size_bytes": L(0)}),
        (["digests_well_formed"], {"packet_sha256": f"upper({DIGEST})"}),
        (["local_confidence_in_unit_interval"], {"local_confidence": L(1.5)}),
    ]),
    "contract_schedules": (C.schedule_rules, {
        "policy": L("full_share"), "admitted": L(True), "measured_size_bytes": L(9), "admitted_bytes": L(9), "source_time_ns": T,
    }, [
        (["policy_known"], {"policy": L("some_share")}),
        (["admitted_bytes_agree"], {"admitted": L(False)}),
        (["schedule_has_source"], {"source_time_ns": NO_BIGINT}),
        (["size_positive"], {"measured_size_bytes": L(0), "admitted_bytes": L(0)}),
    ]),
    "contract_fusion": (C.fusion_rules, {
        "abstained": L(False), "fused_vector": A(ONE), "remote_contributor_count": L(1), "contributor_count": L(2), "uncertainty_available": L(False), "predictive_uncertainty": NO_DOUBLE,
        "reason": L("fused"), "degraded": L(False),
    }, [
        (["abstained_without_vector"], {"abstained": L(True)}),
        (["remote_within_total"], {"remote_contributor_count": L(3)}),
        (["uncertainty_flag_agrees"], {"predictive_uncertainty": ONE}),
        (["ego_absent_abstains"], {"reason": L("ego_absent")}),
        (["fallback_is_degraded"], {"reason": L("ego_only_fallback")}),
    ]),
    "contract_metrics": (C.metric_rules, {
        "prediction_available_count": L(3), "abstention_count": L(1), "observation_count": L(4), "corrupted_source_bytes": L(1), "admitted_bytes": L(2),
        "proxy_reconstruction_error": ONE, "proxy_utility": ONE,
    }, [
        (["predictions_cover_observations"], {"abstention_count": L(2)}),
        (["corrupted_within_admitted"], {"corrupted_source_bytes": L(3)}),
        (["error_and_utility_together"], {"proxy_utility": NO_DOUBLE}),
    ]),
    "contract_capabilities": (C.capability_rules, {
        "agent_id": L("a"), "sensor_type": L("lidar"), "agent_type": L("vehicle"), "odometry": L("required"), "extrinsics": _extrinsics("verified", UNIT),
        "nominal_coverage": _coverage("verified", ONE, ONE, ONE), "expected_odometry_fields": A(L("x")),
    }, [
        (["agent_id_not_empty"], {"agent_id": L("")}),
        (["sensor_type_not_empty"], {"sensor_type": NO_TEXT}),
        (["agent_type_known"], {"agent_type": L("kite")}),
        (["odometry_known"], {"odometry": L("maybe")}),
        (["matrix_iff_verified"], {"extrinsics": _extrinsics("verified", NO_MATRIX)}),
        (["matrix_is_4x4_finite"], {"extrinsics": _extrinsics("verified", SHORT)}),
        (["coverage_complete_iff_verified"], {"nominal_coverage": _coverage("verified", ONE, NO_DOUBLE, ONE)}),
        (["coverage_positive"], {"nominal_coverage": _coverage("verified", ONE, ZERO, ONE)}),
        (["odometry_fields_iff_applicable"], {"odometry": L("not_applicable")}),
    ]),
    "contract_observations": (C.observation_rules, {
        "message_present": L(True), "source_time_ns": T, "vector": A(ONE), "two_sided_count_residual": ZERO, "peer_corroboration_score": ONE,
    }, [
        (["present_iff_source"], {"source_time_ns": NO_BIGINT}),
        (["present_iff_source", "vector_needs_message"], {"message_present": L(False)}),
        (["vector_finite"], {"vector": A(NAN)}),
        (["residual_nonnegative"], {"two_sided_count_residual": L(-1.0)}),
        (["peer_corroboration_score_in_unit_interval"], {"peer_corroboration_score": L(1.25)}),
    ]),
    "contract_contributions": (C.contribution_rules, {
        "agent_id": L("a"), "vector": A(ONE), "quality_score": ONE, "predictive_uncertainty": ZERO,
    }, [
        (["agent_id_not_empty"], {"agent_id": L("")}),
        (["vector_present"], {"vector": "CAST(array() AS ARRAY<DOUBLE>)"}),
        (["vector_finite"], {"vector": A(ONE, NAN)}),
        (["quality_in_unit_interval"], {"quality_score": L(-0.5)}),
        (["uncertainty_nonnegative"], {"predictive_uncertainty": L(-0.5)}),
    ]),
    "contract_overlay_specs": (C.overlay_spec_rules, {
        "kind": L("velocity_spike"), "family": L("kinematic"), "expected_modality": L("kinematic"), "delta_v_mps": _vec(ONE, ZERO, ZERO), "duration_samples": L(2),
        "interval_sample_times_ns": TIMES, "object_key": NO_TEXT, "box": _box(), "n_add": "CAST(NULL AS INT)", "removal_fraction": NO_DOUBLE, "boundary_tolerance_m": ZERO, "seed": L(1),
        "raw_relative_path": L("a/b.csv"),
    }, [
        (["kind_known", "family_agrees", "modality_agrees", "points_have_an_object"], {"kind": L("fog")}),
        (["family_agrees"], {"family": L("spatial_support")}),
        (["modality_agrees"], {"expected_modality": L("spatial")}),
        (["motion_has_delta_and_duration"], {"delta_v_mps": _vec(NAN, ZERO, ZERO)}),
        (["motion_lists_every_sample"], {"duration_samples": L(3)}),
        (["sample_times_sorted_unique"], {"interval_sample_times_ns": f"reverse({TIMES})"}),
        (["motion_has_no_object"], {"object_key": L("0")}),
        (["points_have_an_object"], {**ADDING, "object_key": NO_TEXT}),
        (["box_finite_and_positive"], {**ADDING, "box": _box(size_x_m=ZERO)}),
        (["addition_has_only_a_count"], {**ADDING, "removal_fraction": L(0.5)}),
        (["removal_has_only_a_fraction"], {**REMOVING, "removal_fraction": L(1.5)}),
        (["tolerance_nonnegative"], {**REMOVING, "boundary_tolerance_m": L(-0.5)}),
        (["seed_nonnegative"], {"seed": L(-1)}),
        (["path_safe"], {"raw_relative_path": L("../b.csv")}),
        ([], ADDING),
        ([], REMOVING),
    ]),
}


def _query(rules, valid, faults):
    def run(spark, d):
        kind = _mod("event_id", len(faults) + 1)
        columns = {}
        for name, text in valid.items():
            value = F.expr(text)
            for k, (_, changed) in enumerate(faults):
                if name in changed:
                    value = F.when(kind == k + 1, F.expr(changed[name])).otherwise(value)
            columns[name] = value
        rows = table(spark, d, "events").select("event_id", *[v.alias(n) for n, v in columns.items()])
        return C.violations(rows, ["event_id"], rules())

    return run


def _sql(faults):
    return "\nUNION ALL ".join(
        f"SELECT event_id, '{rule}' AS rule FROM events WHERE event_id % {len(faults) + 1} = {k + 1}"
        for k, (broken, _) in enumerate(faults) for rule in broken
    )


def _level_audit(level):
    """Canonical-table rules of object and evidence tables, and keys that occur twice."""
    def run(spark, d):
        kind = _mod("event_id", 7)
        other = F.when(kind == 5, "").otherwise("v")
        base = table(spark, d, "events").select(
            "event_id", F.lit("e").alias("experiment_id"), other.alias("variant_id"), F.lit("q").alias("sequence_id"), F.lit("s").alias("session_id"), F.col("event_id").alias("sync_frame_id"),
            F.when(kind != 4, F.expr(T)).alias("decision_time_ns"), F.when(kind != 3, F.expr(T)).alias("source_time_ns"), F.lit("a").alias("agent_id"), F.lit("vehicle").alias("agent_type"),
            F.when(kind != 2, "0").alias("object_key"), F.lit("object").alias("evidence_level"), F.lit("n").alias("evidence_name"),
        )
        doubled = base.unionByName(base.filter(_mod("event_id", 7) == 6)).drop("event_id")
        return C.validate_table(doubled, level).select("sync_frame_id", "rule")

    rules = {2: "object_has_key" if level == "object" else "object_key_iff_object", 4: "decision_time_ns_not_null", 5: "variant_id_not_empty", 6: "unique_key"}
    if level == "object":
        rules[3] = "object_has_source"
    return run, "\nUNION ALL ".join(f"SELECT event_id AS sync_frame_id, '{r}' AS rule FROM events WHERE event_id % 7 = {k}" for k, r in rules.items())


QUERIES = {
    **{name: (_query(*family), _sql(family[2])) for name, family in FAMILIES.items()},
    "object_table_audit": _level_audit("object"),
    "evidence_table_audit": _level_audit("evidence"),
}
