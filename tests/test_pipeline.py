"""Packets, gating, fusion and whole pipelines."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from trustweave import schemas as S
from trustweave.functions.canonical import number_text, self_including_size
from trustweave.operators import contracts as C
from trustweave.operators.fusion import ego_only, mean_fusion, reconstruction_error
from trustweave.operators.messaging import admit, build_packets, verify_packets
from trustweave.operators.metrics import coverage
from trustweave.plans.clean_evidence import build_evidence, frames_by_id
from trustweave.plans.fixture import fixture_report, run_fixture
from trustweave.plans.whatif import compare_replay

SEC = 1_000_000_000


def _observation(agent, time, vector, x, confidence, region):
    here = time is not None
    value = lambda v: v if here else None
    return {
        "agent_id": agent, "source_time_ns": time, "is_ego": agent == "ego", "message_present": here,
        "kinematic_error_m": value(0.0), "two_sided_count_residual": value(0.0),
        "peer_corroboration_score": value(1.0), "kinematic_applicable": True, "vector": vector,
        "pose": {"frame_id": "top", "xyz_m": [x, 0.0, 0.0], "yaw_rad": 0.0},
        "region_or_object_key": region, "local_confidence": confidence if here else 0.0,
        "quality_score": confidence if here else 0.0,
        "reason_code": "matched" if here else "missing_message",
    }


def _fixture():
    """Four frames, three agents; all present, all present, remotes gone, ego gone."""
    vectors = [
        ([0.0, 0.0], [1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0], [2.0, 2.0]),
        ([0.5, -0.5], None, None), (None, [0.0, 0.0], [0.0, 0.0]),
    ]
    references = [[1.0, 1.0], [1.0, 1.0], [0.5, -0.5], [0.0, 0.0]]
    regions = ["region-0", "region-0", "region-1", "region-2"]
    frames = []
    for i, (vs, reference, region) in enumerate(zip(vectors, references, regions)):
        now = 1000 * (i + 1)
        senders = (("ego", 0, 0.0, 1.0), ("remote-corrupted", 10, 1.0, 0.9), ("remote-companion", 5, -1.0, 0.8))
        frames.append({
            "sync_frame_id": i, "decision_time_ns": now, "clean_reference": reference,
            "observations": [
                _observation(a, None if v is None else now - lag, v, x, q, region)
                for (a, lag, x, q), v in zip(senders, vs)
            ],
        })
    return {
        "fixture_run_id": "m3-d2-fixture-v1", "source_id": "synthetic-m3-fixture",
        "sequence_id": "synthetic-sequence-m3", "session_id": "synthetic-session-m3",
        "ego_agent_id": "ego", "seed": 1729, "max_source_age_ns": 100,
        "ewma": {"alpha": 0.3, "threshold": 0.25, "initial_value": None,
                 "missing_evidence_policy": "hold_prior_mark_unknown"},
        "frames": frames,
        "integration_corruption": {
            "target_sync_frame_id": 1, "target_agent_id": "remote-corrupted",
            "replacement": {"kinematic_error_m": 0.057, "two_sided_count_residual": 3.0,
                            "peer_corroboration_score": 0.0, "vector": [8.0, 8.0]},
        },
    }


def test_fixture_pipeline_gives_the_published_values(spark, tmp_path):
    path = tmp_path / "fixture.json"
    path.write_text(json.dumps(_fixture()))
    episode = run_fixture(spark, str(path))
    target = {
        r["fixture_case"]: r for r in
        episode.senders.filter("sync_frame_id = 1 and agent_id = 'remote-corrupted'").collect()
    }
    assert target["clean"]["risk_score"] == pytest.approx(0.0)
    assert target["integration_corruption"]["risk_score"] == pytest.approx(1.0)
    assert target["integration_corruption"]["ewma_risk_score"] == pytest.approx(0.3)
    assert target["clean"]["current_state"] == "normal"
    assert target["integration_corruption"]["current_state"] == "quarantined"
    totals = {(r["fixture_case"], r["policy"]): r for r in fixture_report(episode).collect()}
    full, gated = (totals[("integration_corruption", p)] for p in ("full_share", "hard_gate"))
    assert full["corrupted_source_bytes"] == 725 and gated["corrupted_source_bytes"] == 0
    assert full["proxy_reconstruction_error"] == pytest.approx(3.299831645537222)
    assert gated["proxy_reconstruction_error"] == pytest.approx(0.0)
    assert episode.packets.filter("not integrity_valid").count() == 0
    frame3 = episode.fusion.filter("sync_frame_id = 3").collect()
    assert {r["reason"] for r in frame3} == {"ego_absent"}
    for rules, table, keys in (
        (C.schedule_rules(), episode.schedule, ["agent_id"]), (C.fusion_rules(), episode.fusion, ["sync_frame_id"]),
        (C.metric_rules(), episode.metrics, ["sync_frame_id"]), (C.packet_rules(), episode.packets, ["agent_id"]),
    ):
        assert C.violations(table, keys, rules).count() == 0


def test_packet_digests_follow_a_json_writer(spark):
    df = spark.createDataFrame(
        [("a", 5, [0.00025, 1e-05, 8.0, 12345678.9, 1e22, -0.5], 0.9, False, True, 4)],
        "agent_id string, decision_time_ns bigint, payload array<double>, local_confidence double, "
        "is_ego boolean, message_present boolean, source_time_ns bigint")
    r = build_packets(df, ["agent_id", "decision_time_ns", "source_time_ns"]).first()
    dump = lambda v: (json.dumps(v, sort_keys=True, separators=(",", ":")) + "\n").encode()
    payload = hashlib.sha256(dump(list(r["payload"]))).hexdigest()
    wire = {"agent_id": "a", "decision_time_ns": 5, "source_time_ns": 4, "payload": list(r["payload"]),
            "local_confidence": 0.9, "payload_sha256": payload, "measured_size_bytes": r["measured_size_bytes"]}
    assert r["payload_sha256"] == payload
    assert len(dump(wire)) == r["measured_size_bytes"]
    assert r["packet_sha256"] == hashlib.sha256(dump(wire)).hexdigest()


def test_number_text_and_size(spark):
    values = [0.0, 1.0, -1.5, 1e-3, 9.99e-4, 1e-4, 9.9e-5, 1e7, 123456789.125, 1e15, 1e16, 1.5e300, 5e-324, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(number_text(F.col("v"))).collect()]
    skip = {5e-324}  # this JVM prints the smallest denormal with an extra digit
    assert [g for g, v in zip(got, values) if v not in skip] == [repr(v) for v in values if v not in skip]
    sizes = spark.range(1, 3000).select("id", self_including_size(F.col("id")).alias("n")).collect()
    for r in sizes:
        n = next(d for d in range(r["id"], r["id"] + 12) if r["id"] + len(str(d)) == d or r["id"] + len(str(d)) < d)
        assert r["n"] - len(str(r["n"])) == r["id"] or r["n"] == n


def test_admission_order(spark):
    rows = [("bad", 10, False, "normal"), ("late", 500, True, "normal"), ("future", -1, True, "normal"),
            ("gated", 10, True, "unknown"), ("none", 10, True, None), ("good", 100, True, "normal")]
    df = spark.createDataFrame(
        [(n, 1000, 1000 - age, ok, st, 7) for n, age, ok, st in rows],
        "agent_id string, decision_time_ns bigint, source_time_ns bigint, integrity_valid boolean, "
        "current_state string, measured_size_bytes bigint")
    got = {(r["agent_id"], r["policy"]): (r["reason_code"], r["admitted_bytes"]) for r in
           admit(df, max_source_age_ns=100).collect()}
    assert got[("bad", "full_share")] == ("invalid_integrity", 0)
    assert got[("late", "hard_gate")] == got[("future", "full_share")] == ("late", 0)
    assert got[("gated", "full_share")] == ("admitted", 7)
    assert got[("gated", "hard_gate")] == got[("none", "hard_gate")] == ("hard_gated", 0)
    assert got[("good", "hard_gate")] == ("admitted", 7)


def test_tampering_is_found(spark):
    df = spark.createDataFrame(
        [(str(i), 5, [1.0, float(i)], 1.0, False, True, 4) for i in range(4)],
        "agent_id string, decision_time_ns bigint, payload array<double>, local_confidence double, "
        "is_ego boolean, message_present boolean, source_time_ns bigint")
    keys = ["agent_id", "decision_time_ns", "source_time_ns"]
    p = build_packets(df, keys).withColumns({
        "payload": F.when(F.col("agent_id") == "1", F.array(F.lit(9.0))).otherwise(F.col("payload")),
        "measured_size_bytes": F.col("measured_size_bytes") + F.when(F.col("agent_id") == "2", 1).otherwise(0),
        "local_confidence": F.when(F.col("agent_id") == "3", 0.5).otherwise(F.col("local_confidence")),
    })
    got = {r["agent_id"]: r["integrity_valid"] for r in verify_packets(p, keys).collect()}
    assert got == {"0": True, "1": False, "2": False, "3": False}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "frame int, agent_id string, is_ego boolean, vector array<double>, "
                                 "quality_score double, predictive_uncertainty double")


@pytest.mark.parametrize("width", [None, 2])
def test_mean_fusion_cases(spark, width):
    c = _vectors(spark, [
        (0, "e", True, [0.0, 0.0], 1.0, 0.2), (0, "r", False, [2.0, 4.0], 0.5, 0.4),
        (1, "e", True, [1.0, 1.0], 1.0, None), (2, "r", False, [3.0, 3.0], 1.0, 0.1)])
    got = {r["frame"]: r for r in mean_fusion(c, ["frame"], width=width).collect()}
    assert got[0]["fused_vector"] == [1.0, 2.0] and got[0]["reason"] == "cooperative"
    assert got[0]["quality_score"] == 0.75 and got[0]["predictive_uncertainty"] == pytest.approx(0.3)
    assert got[0]["total_remote_weight"] == 0.5
    assert got[1]["reason"] == "ego_only_fallback" and got[1]["predictive_uncertainty"] is None
    assert got[2]["abstained"] and got[2]["contributor_count"] == 0
    free = {r["frame"]: r for r in mean_fusion(c, ["frame"], width=width, require_ego=False).collect()}
    assert free[2]["fused_vector"] == [3.0, 3.0]
    alone = {r["frame"]: r for r in ego_only(c, ["frame"], width=width).collect()}
    assert alone[0]["fused_vector"] == [0.0, 0.0] and alone[2]["abstained"]
    err = reconstruction_error(mean_fusion(c, ["frame"], width=width).withColumn(
        "clean_reference", F.array(F.lit(1.0), F.lit(2.0))))
    assert err.filter("frame = 0").first()["proxy_utility"] == 1.0


def test_fusion_rejects_bad_input(spark):
    for rows in ([(0, "e", True, [0.0], 1.0, None), (0, "r", False, [1.0, 2.0], 1.0, None)],
                 [(0, "e", True, [0.0], 1.0, None), (0, "f", True, [0.0], 1.0, None)]):
        with pytest.raises(Exception):
            mean_fusion(_vectors(spark, rows), ["frame"]).collect()


def test_coverage_keeps_every_attempt(spark):
    df = spark.createDataFrame(
        [("k", "mild", "vehicle", "failed", "zero"), ("k", "mild", "vehicle", "succeeded", "low")],
        "family string, severity string, agent_type string, status string, realized_effect_band string")
    got = {(r["dimension"], r["value"]): r["attempts"] for r in coverage(df).collect()}
    assert got[("total", None)] == 2 and got[("status", "failed")] == 1 and got[("family", "k")] == 2
    assert len(got) == 1 + 3 + 4


# -- clean evidence, overlay and replay -------------------------------------------

def _scene(spark):
    agents = ["003", "004", "laser", "dome", "top"]
    unit = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    registry = spark.createDataFrame([
        (a, "infrastructure" if a in ("dome", "top") else "vehicle", "lidar",
         "not_applicable" if a in ("dome", "top") else "required",
         (a, "top", None if a == "dome" else unit, "unresolved" if a == "dome" else "verified", "n"),
         (360.0, 90.0, 50.0, "verified"), ["x"], [] if a in ("dome", "top") else ["v"]) for a in agents
    ], S.REGISTRY)
    assert C.violations(registry, ["agent_id"], C.capability_rules()).count() == 0
    clouds = spark.createDataFrame(
        [("s", "t", f, f * SEC, a) for f in range(3) for a in agents],
        "sequence_id string, session_id string, sync_frame_id bigint, source_time_ns bigint, agent_id string")
    frames, problems = frames_by_id(clouds, "top", max_age_ns=SEC, lookahead_ns=SEC)
    assert problems.count() == 0
    odometry = spark.createDataFrame([
        (a, f * SEC, f * SEC, (float(f), 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0))
        for a in agents[:3] for f in range(3)], S.ODOMETRY)
    points = spark.createDataFrame([
        ("s", "t", f, a, -0.75 + 1.5 * i / (k + 2), 0.0, 0.0)
        for f in range(3) for k, a in enumerate(agents) for i in range(k + 3)],
        "sequence_id string, session_id string, sync_frame_id bigint, agent_id string, x double, y double, z double")
    labels = spark.createDataFrame([
        ("s", "t", f, i, 1, 0.5 * i, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0) for f in range(3) for i in range(2)],
        "sequence_id string, session_id string, sync_frame_id bigint, local_index int, class_id int, "
        "center_x_m double, center_y_m double, center_z_m double, size_x_m double, size_y_m double, "
        "size_z_m double, yaw_rad double")
    return frames, registry, odometry, points, labels


def test_clean_evidence_and_replay(spark):
    frames, registry, odometry, points, labels = _scene(spark)
    frames = frames.withColumns({
        "pose_source_time_ns": F.lit(None).cast("bigint"), "pose_age_ns": F.lit(None).cast("bigint"),
        "experiment_id": F.lit("e"), "variant_id": F.lit("clean")})
    tables = build_evidence(frames, registry, odometry, points, labels, max_gap_s=2.0, slot_ns=SEC)
    evidence = tables.evidence.cache()
    assert tables.objects.count() == 30
    # per frame and agent 20 names, per object 13
    assert evidence.count() == 15 * 20 + 30 * 13
    assert {r[0] for r in evidence.select("evidence_name").distinct().collect()} == {
        *S.FRAME_EVIDENCE, *S.KINEMATIC_EVIDENCE, *S.SUMMARY_EVIDENCE, *S.RISK_EVIDENCE,
        *S.SPATIAL_EVIDENCE, *S.PEER_EVIDENCE}
    value = {(r["sync_frame_id"], r["agent_id"], r["object_key"], r["evidence_name"]): r for r in evidence.collect()}
    # both boxes hold every point of agent 003 that has x > -0.5 (second) or all (first)
    assert value[(1, "003", "0", "point_count")]["value"] == 3
    assert value[(1, "003", "1", "point_count")]["value"] == 2
    assert value[(1, "dome", "0", "point_count")]["reason_code"] == "unresolved_transform"
    assert value[(1, "003", None, "kinematic_residual_m")]["value"] == pytest.approx(0.0)
    assert value[(0, "003", None, "kinematic_residual_m")]["reason_code"] == "out_of_range"
    assert value[(1, "top", None, "kinematic_residual_m")]["reason_code"] == "not_applicable"
    assert value[(1, "003", "0", "eligible_peer_count")]["value"] == 3
    assert value[(1, "003", "0", "peer_corroboration_score")]["value"] == 1.0
    assert value[(1, "dome", None, "unknown_aware_fixed_abstained")]["value"] == 1.0
    deficit = max(0.0, 3.0 - math.log1p(2))
    assert value[(1, "003", None, "maximum_object_suspicion")]["value"] == pytest.approx(deficit)
    assert value[(1, "003", None, "unknown_aware_fixed_risk_uncalibrated")]["value"] == pytest.approx(0.3 * deficit / 3.0)
    bad = evidence.filter("available <> (value is not null) or (available and reason_code <> 'matched')")
    assert bad.count() == 0

    # a worse residual for agent 003 in frame 1, merged and replayed beside the clean run
    keys = ["sequence_id", "session_id", "sync_frame_id", "agent_id", "object_key", "evidence_name"]
    delta = evidence.filter("sync_frame_id = 1 and agent_id = '003' and evidence_name = 'kinematic_residual_m'").withColumn("value", F.lit(0.057))
    sender = keys[:4]
    run = compare_replay(
        tables.frames.select(*sender, "decision_time_ns", "source_time_ns", "message_present", "reason_code"),
        evidence, delta, sender=sender, evidence_keys=keys, ego="top", targets=delta, max_source_age_ns=SEC)
    risk = {(r["case"], r["sync_frame_id"], r["agent_id"]): r["risk_score"] for r in run.senders.collect()}
    assert risk[("perturbed", 1, "003")] - risk[("clean", 1, "003")] == pytest.approx(0.4)
    assert risk[("perturbed", 2, "003")] == pytest.approx(risk[("clean", 2, "003")])
    metrics = run.metrics.collect()
    assert len(metrics) == 2 * 3 * 2
    assert {r["observation_count"] for r in metrics} == {5}
    hit = [r for r in metrics if r["case"] == "perturbed" and r["sync_frame_id"] == 1]
    assert {r["honest_companion_count"] for r in hit} == {4}
