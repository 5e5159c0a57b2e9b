"""Observations -> risk -> state -> packets -> gate -> fusion -> metrics.

One DataFrame pipeline over all frames, cases and variants at once: the frame-by-
frame loop of a simulator becomes windows keyed by (case, source).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from trustweave.functions.scoring import missing_aware, prediction
from trustweave.operators.fusion import mean_fusion, reconstruction_error
from trustweave.operators.messaging import admit, build_packets
from trustweave.operators.metrics import episode_metrics, frame_metrics
from trustweave.operators.ordered import DAY_NS, time_slot
from trustweave.operators.temporal import Smoothing, ewma, label_state
from trustweave.schemas import POLICIES
from trustweave.sources.stage import once, stage


@dataclass(frozen=True)
class EpisodeKeys:
    """Which columns name a sender's history and which name a frame."""

    sender: list[str] = field(default_factory=lambda: ["case", "sequence_id", "session_id", "agent_id"])
    frame: list[str] = field(
        default_factory=lambda: ["case", "sequence_id", "session_id", "sync_frame_id", "decision_time_ns"]
    )


@dataclass(frozen=True)
class Episode:
    senders: DataFrame
    packets: DataFrame
    schedule: DataFrame
    fusion: DataFrame
    metrics: DataFrame


def score_senders(
    observations: DataFrame, keys: EpisodeKeys, smoothing: Smoothing = Smoothing(),
    slot_ns: int = DAY_NS,
) -> DataFrame:
    """Append prediction and state columns to every expected observation."""
    reason = (
        F.col("reason_code") if "reason_code" in observations.columns else F.lit("missing_message")
    )
    score = missing_aware(
        F.col("kinematic_error_m"), F.col("two_sided_count_residual"),
        F.col("peer_corroboration_score"), F.col("kinematic_applicable"),
    )
    rows = once(observations, __score=score)
    rows = once(rows, __p=prediction(F.col("__score"), F.col("message_present"), reason))
    kept = [c for c in observations.columns if c != "reason_code"]
    rows = rows.select(
        *kept, "__p.*", F.col("message_present").alias("evidence_available")
    )
    smoothed = ewma(
        rows, keys.sender, ["decision_time_ns"], time_slot(F.col("decision_time_ns"), slot_ns),
        "risk_score", smoothing,
    )
    return label_state(smoothed, smoothing).withColumnRenamed("ewma", "ewma_risk_score")


def run_episode(
    observations: DataFrame,
    keys: EpisodeKeys = EpisodeKeys(),
    *,
    smoothing: Smoothing = Smoothing(),
    max_source_age_ns: int = 100_000_000,
    packet_identity: list[str],
    nested: list[str] | None = None,
    replay: bool = False,
    width: int | None = None,
    reference: str | None = None,
    slot_ns: int = DAY_NS,
    digest: bool = True,
) -> Episode:
    """Run every case in ``observations`` (a ``case`` column belongs to the keys).

    The pipeline form carries packet integrity, needs an ego for fusion and counts the
    bytes of ``corrupted`` senders. ``replay`` has no integrity step, averages whatever
    exists, and reports the honest companions of the intended target. Its reports need no
    packet digests: without ``digest`` the packets have none.
    """
    senders = stage(score_senders(observations, keys, smoothing, slot_ns))
    packets = build_packets(senders, packet_identity, payload="payload", nested=nested, digest=digest)
    if not replay:  # built in this run; verify_packets is for packets that come from outside
        packets = packets.withColumn("integrity_valid", F.lit(True))
    schedule = stage(
        admit(packets, max_source_age_ns=max_source_age_ns, check_integrity=not replay)
    )
    confidence = F.col("local_confidence")
    quality = F.col("quality_score") if "quality_score" in observations.columns else F.lit(1.0)
    remote = schedule.filter("admitted").select(
        *keys.frame, "policy", "agent_id", F.lit(False).alias("is_ego"),
        F.col("payload").alias("vector"), confidence.alias("quality_score"),
    )
    ego = senders.filter(
        F.col("is_ego") & F.col("message_present") & F.col("payload").isNotNull()
    ).select(
        *keys.frame, F.explode(F.array(*[F.lit(p) for p in POLICIES])).alias("policy"),
        "agent_id", "is_ego", F.col("payload").alias("vector"), quality.alias("quality_score"),
    )
    frames = senders.select(*keys.frame).distinct().withColumn(
        "policy", F.explode(F.array(*[F.lit(p) for p in POLICIES]))
    )
    fusion = mean_fusion(
        ego.unionByName(remote), [*keys.frame, "policy"], width=width,
        require_ego=not replay, frames=frames,
    )
    if reference:
        clean = senders.groupBy(*keys.frame).agg(F.any_value(reference).alias(reference))
        fusion = reconstruction_error(fusion.join(clean, keys.frame), reference)
    if replay:
        metrics = episode_metrics(senders, schedule, fusion, keys.frame)
    else:
        metrics = frame_metrics(senders, schedule, fusion, keys.frame)
    return Episode(senders, packets, schedule, fusion, metrics)
