"""Frames, clouds, labels and odometry -> frame, object and evidence tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trustweave import schemas as S
from trustweave.functions import geometry as G
from trustweave.functions.scoring import fixed_diagnostic, missing_aware
from trustweave.operators.evidence import Item, to_long
from trustweave.operators.kinematics import attach_kinematics, interval_kinematics
from trustweave.operators.ordered import DAY_NS
from trustweave.operators.peers import (
    frame_shares, leave_one_out, mean_if_complete, object_suspicion, point_shares,
    summarize_suspicion, weakest_peer_score,
)
from trustweave.operators.spatial import BOX_COLUMNS, cloud_summary, spatial_support, transform_points
from trustweave.sources.stage import once, stage

SCENE = ["sequence_id", "session_id", "sync_frame_id"]
SENDER = [*SCENE, "agent_id"]
# The development reference for counts: expected log1p count and its scale.
COUNT_REFERENCE = (3.0, 1.0)


@dataclass(frozen=True)
class EvidenceTables:
    frames: DataFrame
    objects: DataFrame
    evidence: DataFrame
    problems: DataFrame


def frames_by_id(
    clouds: DataFrame, anchor: str, *, max_age_ns: int, lookahead_ns: int
) -> tuple[DataFrame, DataFrame]:
    """Frames whose decision time is the anchor agent's cloud of the same frame id.

    Returns (frames, problems): here an age beyond the limits is an error row.
    """
    decision = clouds.filter(F.col("agent_id") == anchor).select(
        *SCENE, F.col("source_time_ns").alias("decision_time_ns")
    )
    rows = clouds.join(decision, SCENE, "left").withColumn(
        "match_age_ns", F.col("decision_time_ns") - F.col("source_time_ns")
    )
    problem = (
        F.when(F.col("decision_time_ns").isNull(), "no_anchor")
        .when(F.col("match_age_ns") < -lookahead_ns, "exceeds_lookahead")
        .when(F.abs("match_age_ns") > max_age_ns, "exceeds_maximum_age")
    )
    rows = rows.withColumn("problem", problem)
    good = rows.filter("problem is null").drop("problem").withColumns({
        "match_policy": F.lit(S.BUFFERED),
        "lookahead_buffer_ns": F.lit(lookahead_ns).cast("bigint"),
        "source_matched": F.lit(True), "message_present": F.lit(True),
        "reason_code": F.lit("matched"),
    })
    return good, rows.filter("problem is not null")


def replicate_labels(labels: DataFrame, frames: DataFrame) -> DataFrame:
    """Every label of a scene once per matched agent of that scene."""
    return frames.filter("source_matched").join(labels, SCENE)


def build_evidence(
    frames: DataFrame,
    registry: DataFrame,
    odometry: DataFrame,
    points: DataFrame,
    labels: DataFrame,
    *,
    max_gap_s: float,
    reference: tuple[float, float] = COUNT_REFERENCE,
    slot_ns: int = DAY_NS,
    **spatial_options,
) -> EvidenceTables:
    """The three evidence tables, and problem rows of frames.

    ``frames``: SENDER, decision and source time, match columns and identity.
    ``odometry``: series per ``agent_id``. ``points``: SENDER, x, y, z, optionally
    ``intensity``. ``labels``: SCENE, ``local_index``, ``class_id`` and a box in the
    common frame. All agents and scenes are handled at once. A frame whose agent the
    registry doesn't know stays, with an unresolved transform and a problem row.
    """
    matrix, quality = G.resolve_extrinsics(F.col("extrinsics"))
    known = registry.select(
        "agent_id", "agent_type", (F.col("odometry") != "not_applicable").alias("__moves"),
        matrix.alias("__matrix"), quality.alias("transform_quality"), "nominal_coverage",
    )
    base = frames.drop("agent_type").join(known.withColumn("__known", F.lit(True)), "agent_id", "left").withColumns({
        "__moves": F.coalesce("__moves", F.lit(True)),
        "transform_quality": F.coalesce("transform_quality", F.lit("unresolved_transform")),
    })
    kinematics = interval_kinematics(odometry, ["agent_id"], max_gap_s=max_gap_s, slot_ns=slot_ns)
    base = stage(attach_kinematics(base, kinematics))

    # an agent's matrix is the same in all scenes, so points meet only the small registry
    transforms = known.select("agent_id", "__matrix").filter(F.col("__matrix").isNotNull())
    moved = transform_points(points.join(transforms, "agent_id"), "__matrix").drop("__matrix")
    boxes = replicate_labels(
        labels, base.select(*SENDER, "source_matched", "__matrix", "transform_quality", "nominal_coverage")
    )
    center = G.transform_point(
        G.invert_transform(F.col("__matrix")), *[F.col(f"center_{a}_m") for a in "xyz"]
    )
    boxes = boxes.withColumn("__center", F.when(F.col("__matrix").isNotNull(), center.col()))
    boxes = once(boxes, __seen=G.visibility(F.col("__center"), F.col("nominal_coverage"))).drop("__matrix", "__center")
    measured = stage(spatial_support(
        moved, boxes, SENDER, ["local_index"], reference=reference, **spatial_options
    ))

    scene_object = [*SCENE, "local_index"]
    eligible = measured.withColumn("eligible", F.col("transform_quality") == "verified")
    peers = stage(leave_one_out(
        eligible.select(*SENDER, "local_index", "point_count", "eligible"), scene_object
    ))
    suspicion = measured.select(
        *SENDER, object_suspicion(F.col("deficit_residual"), F.col("surplus_residual")).alias("suspicion")
    )
    summary = summarize_suspicion(suspicion, SENDER)
    means = mean_if_complete(measured, SENDER, "point_count", "mean_point_count")
    shares = frame_shares(point_shares(measured.select(*SENDER, "local_index", "point_count"), scene_object), SENDER)
    weakest = weakest_peer_score(peers, SENDER)
    clouds = cloud_summary(points, SENDER).select(*SENDER, F.col("points").alias("cloud_points"))

    wide = base
    for part in (summary, means, shares, weakest, clouds):
        wide = wide.join(part, SENDER, "left")
    wide = wide.fillna(0, ["object_count", "available_object_count", "cloud_points"])
    wide = wide.fillna(False, ["any_object_evidence_unavailable"])
    residual = F.when(F.col("kinematics.kinematics_available"), F.col("kinematics.residual_m"))
    moves = F.col("__moves")
    residual = F.when(moves, residual)
    wide = once(
        wide,
        __fixed=fixed_diagnostic(residual, F.col("mean_point_count"), F.col("raw_point_share")),
        __aware=missing_aware(
            residual, F.col("maximum_object_suspicion"), F.col("peer_corroboration_score"), moves
        ),
    )
    frame_rows = to_long(
        wide.withColumns({
            "object_key": F.lit(None).cast("string"), "object_index": F.lit(None).cast("bigint"),
            "evidence_level": F.lit("frame"),
        }),
        _identity(frames), _frame_items(moves),
    )
    found = measured.join(
        peers.drop("point_count", "eligible"), [*SENDER, "local_index"]
    ).join(base.select(*SENDER, *[c for c in _identity(frames) if c in base.columns and c not in SENDER]), SENDER)
    object_rows = to_long(
        found.withColumns({
            "object_key": F.col("local_index").cast("string"),
            "object_index": F.col("local_index").cast("bigint"), "evidence_level": F.lit("object"),
        }),
        _identity(frames), _object_items(),
    )
    objects = found.select(
        *[c for c in _identity(frames) if c in found.columns],
        F.col("local_index").cast("string").alias("object_key"),
        F.col("local_index").cast("bigint").alias("object_index"),
        F.lit("frame_local_index").alias("object_key_kind"), F.lit("oracle_gt").alias("source_kind"),
        F.lit(True).alias("oracle_gt"), "class_id", *BOX_COLUMNS,
    )
    problems = base.filter(F.col("__known").isNull()).select(*SENDER, F.lit("unknown_agent").alias("problem"))
    return EvidenceTables(
        base.drop("__moves", "__matrix", "__known"), objects, frame_rows.unionByName(object_rows), problems
    )


def _identity(frames: DataFrame) -> list[str]:
    known = (
        "experiment_id", "variant_id", *SCENE, "decision_time_ns", "source_time_ns", "agent_id",
        "match_policy", "match_age_ns", "lookahead_buffer_ns", "pose_source_time_ns", "pose_age_ns",
    )
    return [c for c in known if c in frames.columns] + ["object_key", "object_index", "evidence_level"]


def _when_matched(value: Column) -> Column:
    return F.when(F.col("source_matched"), value.cast("double"))


def _frame_items(moves: Column) -> list[Item]:
    absent = F.when(F.col("source_matched"), "incomplete_evidence").otherwise(F.col("reason_code"))
    still = F.when(~moves, "not_applicable")
    pose = F.when(moves, F.col("pose_age_ns"))
    values = dict(zip(S.FRAME_EVIDENCE, (
        F.col("message_present"), F.col("match_age_ns"), pose,
        F.col("transform_quality") == "verified", F.col("cloud_points"), moves,
    )))
    items = [
        Item(n, _when_matched(v), F.coalesce(still, F.lit("out_of_range")) if n == "pose_age_ns" else absent,
             moves if n == "pose_age_ns" else True)
        for n, v in values.items()
    ]
    fields = ("dt_s", "speed_mps", "acceleration_mps2", "yaw_change_rad", "residual_m")
    items += [
        Item(n, _when_matched(F.when(moves, F.col(f"kinematics.{f}"))),
             F.coalesce(still, F.col("kinematics.reason_code")), moves)
        for n, f in zip(S.KINEMATIC_EVIDENCE, fields)
    ]
    items += [Item(n, _when_matched(F.col(n)), "unresolved_transform") for n in S.SUMMARY_EVIDENCE]
    risks = (
        F.col("raw_point_share"), F.col("__fixed.risk"), F.col("__aware.risk"),
        F.col("__aware.abstained"),
    )
    items += [Item(n, _when_matched(v), "incomplete_evidence") for n, v in zip(S.RISK_EVIDENCE, risks)]
    return items


def _object_items() -> list[Item]:
    spatial = F.col("spatial_reason")
    values = dict(zip(S.SPATIAL_EVIDENCE, (
        F.col("point_count"), F.col("box_range_m"), F.col("box_volume_m3"), F.col("class_id"),
        F.col("__seen.eligible"), F.col("deficit_residual"), F.col("surplus_residual"),
    )))
    items = [
        Item(n, v, F.col("__seen.reason_code") if n == "visibility_eligible" else spatial)
        for n, v in values.items()
    ]
    peer = (
        "eligible_peer_count", "positive_peer_count", "peer_deficit_residual",
        "peer_surplus_residual", "peer_disagreement", "peer_corroboration_score",
    )
    items += [Item(n, F.col(c), F.col("peer_reason")) for n, c in zip(S.PEER_EVIDENCE, peer)]
    return items
