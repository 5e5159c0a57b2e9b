"""Explicit schemas, key lists and code lists shared by every operator."""

# The reason vocabulary of the data model.
REASONS = (
    "matched", "unmatched", "late", "missing_message", "empty_scene", "invalid_pose",
    "future_pose_unavailable", "out_of_range", "stale", "not_member", "not_applicable",
    "insufficient_peers", "label_unavailable", "unresolved_transform",
    "visibility_unknown", "nonfinite", "invalid_quaternion", "nonpositive_dt",
    "excessive_gap", "incomplete_evidence", "invalid_integrity", "hard_gated", "admitted",
)
MATCHED_REASONS = ("matched", "empty_scene", "invalid_pose")
UNAVAILABLE_REASONS = (
    "unmatched", "late", "missing_message", "out_of_range", "stale", "not_member",
)
CAUSAL = "causal_backward"
BUFFERED = "buffered_nearest"
NO_POLICY = "none"
AGENT_TYPES = ("vehicle", "infrastructure")
APPLICABILITY = ("required", "optional", "not_applicable")
STATES = ("normal", "quarantined", "unknown")
POLICIES = ("full_share", "hard_gate")
SPLIT_ROLES = ("regression_development", "training", "calibration", "final_test")
SPLIT_ACTIONS = {
    "attack_generation": SPLIT_ROLES,
    "normalizer_fit": ("training",),
    "supervised_fit": ("training",),
    "calibration": ("calibration",),
    "final_evaluation": ("final_test",),
}

SOURCE_KEY = ["sequence_id", "session_id", "agent_id"]
FRAME_KEY = [
    "experiment_id", "variant_id", "sequence_id", "session_id",
    "sync_frame_id", "decision_time_ns", "agent_id",
]
IDENTITY = [
    "experiment_id", "variant_id", "sequence_id", "session_id", "sync_frame_id",
    "decision_time_ns", "source_time_ns", "agent_id", "agent_type", "object_key",
]
OBJECT_KEY = FRAME_KEY + ["object_key"]
EVIDENCE_KEY = OBJECT_KEY + ["evidence_name"]

# Evidence names, in the order in which they are written.
FRAME_EVIDENCE = (
    "message_present", "source_age_ns", "pose_age_ns", "transform_verified",
    "raw_cloud_point_count", "kinematic_modality_applicable",
)
KINEMATIC_EVIDENCE = (
    "kinematic_dt_s", "kinematic_speed_mps", "kinematic_acceleration_mps2",
    "kinematic_yaw_change_rad", "kinematic_residual_m",
)
SUMMARY_EVIDENCE = (
    "object_count", "available_object_count", "maximum_object_suspicion",
    "median_object_suspicion", "any_object_evidence_unavailable",
)
RISK_EVIDENCE = (
    "raw_point_share_diagnostic", "historical_fixed_risk_diagnostic",
    "unknown_aware_fixed_risk_uncalibrated", "unknown_aware_fixed_abstained",
)
SPATIAL_EVIDENCE = (
    "point_count", "box_range_m", "box_volume_m3", "class_id", "visibility_eligible",
    "count_deficit_residual_development", "count_surplus_residual_development",
)
PEER_EVIDENCE = (
    "eligible_peer_count", "positive_peer_count", "peer_count_deficit_residual",
    "peer_count_surplus_residual", "peer_count_disagreement", "peer_corroboration_score",
)

# Table schemas, as DDL text (accepted by readers and by createDataFrame).
MEMBERSHIPS = (
    "sequence_id string, session_id string, sync_frame_id bigint, "
    "decision_time_ns bigint, agent_id string, member boolean, message_expected boolean"
)
MESSAGES = (
    "sequence_id string, session_id string, agent_id string, source_time_ns bigint, "
    "arrival_time_ns bigint, empty_scene boolean, pose_valid boolean, "
    "pose_source_time_ns bigint"
)
POSE_SAMPLES = (
    "sequence_id string, session_id string, agent_id string, time_ns bigint, "
    "translation_m struct<x:double,y:double,z:double>, "
    "quaternion_xyzw struct<x:double,y:double,z:double,w:double>"
)
ODOMETRY = (
    "agent_id string, time_ns bigint, header_time_ns bigint, "
    "position_m struct<x:double,y:double,z:double>, "
    "quaternion_xyzw struct<x:double,y:double,z:double,w:double>, "
    "body_velocity_mps struct<x:double,y:double,z:double>"
)
FRAMES = (
    "experiment_id string, variant_id string, sequence_id string, session_id string, "
    "sync_frame_id bigint, decision_time_ns bigint, source_time_ns bigint, "
    "agent_id string, agent_type string, object_key string, member boolean, "
    "message_present boolean, source_matched boolean, evidence_available boolean, "
    "reason_code string, match_policy string, match_age_ns bigint, "
    "lookahead_buffer_ns bigint, pose_source_time_ns bigint, pose_age_ns bigint, "
    "oracle_gt boolean"
)
OBJECTS = (
    "experiment_id string, variant_id string, sequence_id string, session_id string, "
    "sync_frame_id bigint, decision_time_ns bigint, source_time_ns bigint, "
    "agent_id string, agent_type string, object_key string, object_index bigint, "
    "match_policy string, match_age_ns bigint, lookahead_buffer_ns bigint, "
    "pose_source_time_ns bigint, pose_age_ns bigint, object_key_kind string, "
    "source_kind string, oracle_gt boolean, class_id int, center_x_m double, "
    "center_y_m double, center_z_m double, size_x_m double, size_y_m double, "
    "size_z_m double, yaw_rad double, box_frame string"
)
EVIDENCE = (
    "experiment_id string, variant_id string, sequence_id string, session_id string, "
    "sync_frame_id bigint, decision_time_ns bigint, source_time_ns bigint, "
    "agent_id string, agent_type string, object_key string, object_index bigint, "
    "match_policy string, match_age_ns bigint, lookahead_buffer_ns bigint, "
    "pose_source_time_ns bigint, pose_age_ns bigint, evidence_level string, "
    "evidence_name string, value double, applicable boolean, available boolean, "
    "reason_code string, oracle_gt boolean"
)
REGISTRY = (
    "agent_id string, agent_type string, sensor_type string, odometry string, "
    "extrinsics struct<from_frame:string,to_frame:string,"
    "matrix_4x4:array<array<double>>,status:string,note:string>, "
    "nominal_coverage struct<horizontal_fov_deg:double,vertical_fov_deg:double,"
    "range_m:double,status:string>, "
    "expected_point_fields array<string>, expected_odometry_fields array<string>"
)
SPLITS = (
    "source_id string, sequence_id string, role string, resolved boolean, frozen boolean"
)
LINEAGE = (
    "sequence_id string, session_id string, source_episode_id string, "
    "neighboring_frame_block_id string, clean_counterpart_id string, "
    "variant_id string, role string, agent_id string, object_key string"
)
FIXTURE = (
    "fixture_run_id string, source_id string, sequence_id string, session_id string, "
    "ego_agent_id string, seed bigint, max_source_age_ns bigint, "
    "ewma struct<alpha:double,threshold:double,initial_value:double,"
    "missing_evidence_policy:string>, "
    "frames array<struct<sync_frame_id:bigint,decision_time_ns:bigint,"
    "clean_reference:array<double>,observations:array<struct<agent_id:string,"
    "source_time_ns:bigint,is_ego:boolean,message_present:boolean,"
    "kinematic_error_m:double,two_sided_count_residual:double,"
    "peer_corroboration_score:double,kinematic_applicable:boolean,"
    "vector:array<double>,pose:struct<frame_id:string,xyz_m:array<double>,"
    "yaw_rad:double>,region_or_object_key:string,local_confidence:double,"
    "quality_score:double,reason_code:string>>>>, "
    "integration_corruption struct<target_sync_frame_id:bigint,target_agent_id:string,"
    "replacement:struct<kinematic_error_m:double,two_sided_count_residual:double,"
    "peer_corroboration_score:double,vector:array<double>>>"
)
