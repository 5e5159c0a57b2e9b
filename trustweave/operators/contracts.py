"""Row contracts as rule tables.

A rule is a name and a Column that is true for a good row. ``violations`` checks
all rules of a table in one pass and returns one row per broken rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from trustweave import schemas as S
from trustweave.functions.geometry import finite
from trustweave.operators.joins import ContractError, duplicate_keys
from trustweave.operators.ordered import DAY_NS, previous_row, time_slot


@dataclass(frozen=True)
class Rule:
    name: str
    good: Column


def violations(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """One row per (row, broken rule); a rule that evaluates to null is broken."""
    broken = F.array(*[
        F.when(~F.coalesce(r.good, F.lit(False)), F.lit(r.name)) for r in rules
    ])
    return df.select(*keys, F.explode(F.array_compact(broken)).alias("rule"))


def require(df: DataFrame, keys: list[str], rules: list[Rule]) -> DataFrame:
    """The table itself, or an error that names some broken rules."""
    bad = violations(df, keys, rules).take(3)
    if bad:
        raise ContractError(f"contract violations: {bad}")
    return df


c = F.col


def both_or_none(a: str, b: str) -> Column:
    return c(a).isNull() == c(b).isNull()


def implies(a: Column, b: Column) -> Column:
    return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def text(name: str) -> Rule:
    return Rule(f"{name}_not_empty", c(name).isNotNull() & (F.length(c(name)) > 0))


def at_least_zero(name: str, optional: bool = False) -> Rule:
    return Rule(f"{name}_nonnegative", (c(name) >= 0) | (c(name).isNull() & F.lit(optional)))


def one_of(name: str, allowed) -> Rule:
    return Rule(f"{name}_known", c(name).isin(*allowed))


def unit_interval(name: str) -> Rule:
    return Rule(f"{name}_in_unit_interval", c(name).isNull() | c(name).between(0.0, 1.0))


def match_rules() -> list[Rule]:
    age, ahead, policy = c("match_age_ns"), c("lookahead_buffer_ns"), c("match_policy")
    return [
        Rule("source_and_age_together", both_or_none("source_time_ns", "match_age_ns")),
        Rule("age_is_decision_minus_source",
             age.isNull() | (age == c("decision_time_ns") - c("source_time_ns"))),
        Rule("causal_has_no_lookahead", implies(policy == S.CAUSAL, ahead == 0)),
        Rule("causal_is_not_in_the_future",
             implies((policy == S.CAUSAL) & age.isNotNull(), age >= 0)),
        Rule("buffered_has_lookahead", implies(policy == S.BUFFERED, ahead > 0)),
        Rule("buffered_within_lookahead",
             implies((policy == S.BUFFERED) & age.isNotNull(), -age <= ahead)),
        Rule("match_needs_a_policy",
             implies(c("source_time_ns").isNotNull(), policy.isin(S.CAUSAL, S.BUFFERED))),
    ]


def pose_rules() -> list[Rule]:
    return [
        Rule("pose_and_age_together", both_or_none("pose_source_time_ns", "pose_age_ns")),
        Rule("pose_age_is_decision_minus_pose",
             c("pose_age_ns").isNull()
             | (c("pose_age_ns") == c("decision_time_ns") - c("pose_source_time_ns"))),
    ]


def frame_rules() -> list[Rule]:
    matched, reason = c("source_matched"), c("reason_code")
    return match_rules() + pose_rules() + [
        Rule("matched_has_source", matched == c("source_time_ns").isNotNull()),
        Rule("matched_reason", implies(matched, reason.isin(*S.MATCHED_REASONS))),
        Rule("unmatched_reason", implies(~matched, reason.isin(*S.UNAVAILABLE_REASONS))),
        Rule("evidence_needs_full_match",
             implies(c("evidence_available"), matched & (reason == "matched"))),
        Rule("not_member_is_no_member", implies(reason == "not_member", ~c("member"))),
        Rule("missing_message_is_absent",
             implies(reason == "missing_message", ~c("message_present"))),
        at_least_zero("sync_frame_id"), at_least_zero("decision_time_ns"),
    ]


def message_rules() -> list[Rule]:
    return [text(k) for k in S.SOURCE_KEY] + [
        at_least_zero("source_time_ns"), at_least_zero("arrival_time_ns"),
        Rule("arrival_not_before_source", c("arrival_time_ns") >= c("source_time_ns")),
        at_least_zero("pose_source_time_ns", optional=True),
    ]


def odometry_rules() -> list[Rule]:
    real = finite(
        *[c(f"position_m.{p}") for p in "xyz"],
        *[c(f"quaternion_xyzw.{p}") for p in "xyzw"],
        *[c(f"body_velocity_mps.{p}") for p in "xyz"],
    )
    return [
        at_least_zero("time_ns"),
        Rule("header_time_agrees", c("time_ns") == c("header_time_ns")),
        Rule("values_finite", real),
    ]


def pose_sample_rules() -> list[Rule]:
    q = [c(f"quaternion_xyzw.{p}") for p in "xyzw"]
    size = F.sqrt(sum((p * p for p in q), F.lit(0.0)))
    return [
        at_least_zero("time_ns"),
        Rule("pose_finite", finite(*[c(f"translation_m.{p}") for p in "xyz"], *q)),
        Rule("pose_unit_length", F.abs(size - 1) <= 1e-9),
    ]


def object_rules() -> list[Rule]:
    return match_rules() + pose_rules() + [
        text("object_key"), at_least_zero("source_time_ns"),
        one_of("object_key_kind", ("stable_id", "frame_local_index")),
        one_of("source_kind", ("oracle_gt", "received_claim")),
        Rule("oracle_flag_agrees", (c("source_kind") == "oracle_gt") == c("oracle_gt")),
    ]


def evidence_rules() -> list[Rule]:
    level, value, reason = c("evidence_level"), c("value"), c("reason_code")
    available = c("available")
    return match_rules() + pose_rules() + [
        one_of("evidence_level", ("frame", "object")), text("evidence_name"),
        Rule("frame_evidence_has_no_object", implies(level == "frame", c("object_key").isNull())),
        Rule("object_evidence_has_object",
             implies(level == "object", c("object_key").isNotNull())),
        Rule("available_has_value", available == value.isNotNull()),
        Rule("available_has_source", implies(available, c("source_time_ns").isNotNull())),
        Rule("available_is_matched", implies(available, reason == "matched")),
        Rule("inapplicable_says_so", implies(~c("applicable"), reason == "not_applicable")),
        Rule("value_finite", value.isNull() | finite(value)),
    ]


def prediction_rules() -> list[Rule]:
    risk, rel = c("risk_score"), c("operational_reliability")
    raw = c("calibration_status") == "uncalibrated"
    p = c("calibrated_p_attack")
    return [
        unit_interval("risk_score"),
        Rule("risk_and_reliability_together", both_or_none("risk_score", "operational_reliability")),
        Rule("reliability_is_one_minus_risk", risk.isNull() | (F.abs(rel - (1 - risk)) <= 1e-12)),
        Rule("uncertainty_flag_agrees",
             c("uncertainty_available") == c("predictive_uncertainty").isNotNull()),
        Rule("abstained_without_risk", c("abstained") == risk.isNull()),
        Rule("uncalibrated_has_no_probability",
             implies(raw, p.isNull()
                     & (c("risk_semantics") == "uncalibrated_attack_risk_score"))),
        Rule("calibrated_has_probability",
             implies(~raw, p.isNotNull()
                     & (c("risk_semantics") == "calibrated_attack_probability"))),
        Rule("probability_equals_risk", implies(~raw, F.abs(p - risk) <= 1e-12)),
    ]


def state_rules() -> list[Rule]:
    return [
        Rule("input_flag_agrees", c("input_available") == c("input_risk_score").isNotNull()),
        unit_interval("input_risk_score"), unit_interval("ewma_risk_score"),
        one_of("previous_state", S.STATES), one_of("current_state", S.STATES),
        text("transition_reason"),
    ]


SHA256 = "^[0-9a-f]{64}$"


def packet_rules() -> list[Rule]:
    return [
        Rule("sender_is_agent", c("sender_id") == c("agent_id")),
        Rule("packet_has_source", c("source_time_ns").isNotNull()),
        Rule("payload_finite", (F.size("payload") > 0) & F.forall("payload", lambda v: finite(v))),
        Rule("size_positive", c("measured_size_bytes") > 0),
        Rule("digests_well_formed",
             c("payload_sha256").rlike(SHA256) & c("packet_sha256").rlike(SHA256)),
        unit_interval("local_confidence"),
    ]


def schedule_rules() -> list[Rule]:
    size = F.when(c("admitted"), c("measured_size_bytes")).otherwise(0)
    return [
        one_of("policy", S.POLICIES),
        Rule("admitted_bytes_agree", c("admitted_bytes") == size),
        Rule("schedule_has_source", c("source_time_ns").isNotNull()),
        Rule("size_positive", c("measured_size_bytes") > 0),
    ]


def fusion_rules() -> list[Rule]:
    reason = c("reason")
    return [
        Rule("abstained_without_vector", c("abstained") == c("fused_vector").isNull()),
        Rule("remote_within_total", c("remote_contributor_count") <= c("contributor_count")),
        Rule("uncertainty_flag_agrees",
             c("uncertainty_available") == c("predictive_uncertainty").isNotNull()),
        Rule("ego_absent_abstains", implies(reason == "ego_absent", c("abstained"))),
        Rule("fallback_is_degraded", implies(reason == "ego_only_fallback", c("degraded"))),
    ]


def metric_rules() -> list[Rule]:
    return [
        Rule("predictions_cover_observations",
             c("prediction_available_count") + c("abstention_count") == c("observation_count")),
        Rule("corrupted_within_admitted", c("corrupted_source_bytes") <= c("admitted_bytes")),
        Rule("error_and_utility_together",
             both_or_none("proxy_reconstruction_error", "proxy_utility")),
    ]


def capability_rules() -> list[Rule]:
    ext, cov = c("extrinsics"), c("nominal_coverage")
    matrix = ext["matrix_4x4"]
    square = (F.size(matrix) == 4) & F.forall(
        matrix, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: finite(v))
    )
    sides = F.array(cov["horizontal_fov_deg"], cov["vertical_fov_deg"], cov["range_m"])
    fields = F.coalesce(F.size("expected_odometry_fields"), F.lit(0))
    return [
        text("agent_id"), text("sensor_type"),
        one_of("agent_type", S.AGENT_TYPES), one_of("odometry", S.APPLICABILITY),
        Rule("matrix_iff_verified", (ext["status"] == "verified") == matrix.isNotNull()),
        Rule("matrix_is_4x4_finite", matrix.isNull() | square),
        Rule("coverage_complete_iff_verified",
             F.when(cov["status"] == "verified", F.forall(sides, lambda v: v.isNotNull()))
             .otherwise(F.forall(sides, lambda v: v.isNull()))),
        Rule("coverage_positive",
             F.forall(sides, lambda v: v.isNull() | (finite(v) & (v > 0)))),
        Rule("odometry_fields_iff_applicable",
             (c("odometry") == "not_applicable") == (fields == 0)),
    ]


def membership_rules() -> list[Rule]:
    return [
        text("sequence_id"), text("session_id"), text("agent_id"),
        at_least_zero("sync_frame_id"), at_least_zero("decision_time_ns"),
        Rule("non_member_expects_nothing", c("member") | ~c("message_expected")),
    ]


def label_rules() -> list[Rule]:
    parts = [c(n) for n in (
        "center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad")]
    return [
        one_of("class_id", (1, 2, 3)),
        Rule("label_finite", finite(*parts)),
        Rule("size_positive", (c("size_x_m") > 0) & (c("size_y_m") > 0) & (c("size_z_m") > 0)),
    ]


def observation_rules(vector: str = "vector") -> list[Rule]:
    return [
        Rule("present_iff_source", c("message_present") == c("source_time_ns").isNotNull()),
        Rule("vector_needs_message", implies(c(vector).isNotNull(), c("message_present"))),
        Rule("vector_finite", c(vector).isNull() | F.forall(vector, lambda v: finite(v))),
        Rule("residual_nonnegative",
             c("two_sided_count_residual").isNull() | (c("two_sided_count_residual") >= 0)),
        unit_interval("peer_corroboration_score"),
    ]


def observation_group_problems(obs: DataFrame, frame: list[str]) -> DataFrame:
    """Frames with more than one ego row or with a repeated agent."""
    egos = (
        obs.groupBy(*frame).agg(F.count_if("is_ego").alias("n")).filter("n > 1")
        .select(*frame, F.lit("one_ego_per_frame").alias("rule"))
    )
    twice = duplicate_keys(obs, [*frame, "agent_id"]).select(
        *frame, F.lit("unique_agents").alias("rule")
    )
    return egos.unionByName(twice)


def contribution_rules() -> list[Rule]:
    return [
        text("agent_id"),
        Rule("vector_present", c("vector").isNotNull() & (F.size("vector") > 0)),
        Rule("vector_finite", F.forall("vector", lambda v: finite(v))),
        Rule("quality_in_unit_interval", c("quality_score").between(0.0, 1.0)),
        Rule("uncertainty_nonnegative",
             c("predictive_uncertainty").isNull() | (c("predictive_uncertainty") >= 0)),
    ]


def overlay_spec_rules() -> list[Rule]:
    motion = c("kind").isin("velocity_spike", "velocity_drift")
    times = c("interval_sample_times_ns")
    delta, box = c("delta_v_mps"), c("box")
    box_parts = [box[n] for n in (
        "center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad")]
    sizes = [box[n] for n in ("size_x_m", "size_y_m", "size_z_m")]
    return [
        one_of("kind", ("velocity_spike", "velocity_drift", "point_addition", "point_removal")),
        Rule("family_agrees",
             c("family") == F.when(motion, "kinematic").otherwise("spatial_support")),
        Rule("modality_agrees",
             c("expected_modality") == F.when(motion, "kinematic").otherwise("spatial")),
        Rule("motion_has_delta_and_duration",
             implies(motion, delta.isNotNull() & (c("duration_samples") > 0)
                     & finite(*[delta[p] for p in "xyz"]))),
        Rule("motion_lists_every_sample",
             implies(motion, F.size(times) == c("duration_samples"))),
        Rule("sample_times_sorted_unique",
             times.isNull() | ((F.array_sort(F.array_distinct(times)) == times)
                               & F.forall(times, lambda t: t >= 0))),
        Rule("motion_has_no_object", implies(motion, c("object_key").isNull())),
        Rule("points_have_an_object", implies(~motion, c("object_key").isNotNull())),
        Rule("box_finite_and_positive",
             implies(~motion, finite(*box_parts)
                     & (sizes[0] > 0) & (sizes[1] > 0) & (sizes[2] > 0))),
        Rule("addition_has_only_a_count",
             implies(c("kind") == "point_addition",
                     (c("n_add") >= 0) & c("removal_fraction").isNull())),
        Rule("removal_has_only_a_fraction",
             implies(c("kind") == "point_removal",
                     c("removal_fraction").between(0.0, 1.0) & c("n_add").isNull())),
        Rule("tolerance_nonnegative", implies(~motion, c("boundary_tolerance_m") >= 0)),
        Rule("seed_nonnegative", c("seed") >= 0),
        Rule("path_safe", safe_relative_path(c("raw_relative_path"))),
    ]


def safe_relative_path(path: Column) -> Column:
    return path.isNotNull() & (F.length(path) > 0) & ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def validate_table(df: DataFrame, level: str) -> DataFrame:
    """Violations of a frame, object or evidence table: columns, nulls and unique key.

    Missing columns and float time columns are errors at once, because no row can
    be right then.
    """
    keys = {"frame": S.FRAME_KEY, "object": S.OBJECT_KEY, "evidence": S.EVIDENCE_KEY}.get(level)
    if keys is None:
        raise ContractError(f"unknown table level {level!r}")
    needed = set(S.IDENTITY) | ({"evidence_level", "evidence_name"} if level == "evidence" else set())
    missing = sorted(needed - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    for name in ("sync_frame_id", "decision_time_ns", "source_time_ns"):
        if not isinstance(df.schema[name].dataType, (T.LongType, T.IntegerType)):
            raise ContractError(f"{name} must be an integer column")
    for name in ("experiment_id", "variant_id", "sequence_id", "session_id", "agent_id", "agent_type"):
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise ContractError(f"{name} must be a string column")
    rules = [text(n) for n in (
        "experiment_id", "variant_id", "sequence_id", "session_id", "agent_id", "agent_type")]
    rules += [Rule(f"{n}_not_null", c(n).isNotNull()) for n in ("sync_frame_id", "decision_time_ns")]
    if level == "frame":
        rules.append(Rule("frame_has_no_object", c("object_key").isNull()))
    elif level == "object":
        rules.append(Rule("object_has_key", c("object_key").isNotNull()))
        rules.append(Rule("object_has_source", c("source_time_ns").isNotNull()))
    else:
        rules.append(one_of("evidence_level", ("frame", "object")))
        rules.append(Rule("object_key_iff_object",
                          (c("evidence_level") == "object") == c("object_key").isNotNull()))
    doubled = duplicate_keys(df, keys).select(*keys, F.lit("unique_key").alias("rule"))
    return violations(df, keys, rules).unionByName(doubled)


def order_violations(
    df: DataFrame, keys: list[str], time: str, slot_ns: int = DAY_NS
) -> DataFrame:
    """Rows whose time is not above that of the row before (by ``position``).

    ``position`` is the row's place in its source, e.g. the line number.
    """
    rows = previous_row(df, keys, ["position"], time_slot(c("position"), slot_ns), [time])
    return rows.filter(c(time) <= c(f"previous.{time}")).select(
        *keys, "position", time, c(f"previous.{time}").alias("previous_time")
    )


def contiguity(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per key: first, last, how many distinct numbers, and whether none is left out.

    Distinct numbers are counted in two grouped steps, so a crowded key is spread
    over its numbers.
    """
    once = df.select(*keys, number).distinct()
    return once.groupBy(*keys).agg(
        F.min(number).alias("first_number"), F.max(number).alias("last_number"),
        F.count("*").alias("distinct_numbers"),
        (F.max(number) - F.min(number) + 1 == F.count("*")).alias("contiguous"),
    )

