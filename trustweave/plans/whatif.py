"""Overlay -> delta -> clean-versus-perturbed replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustweave.operators.evidence import to_wide
from trustweave.operators.joins import merge_delta
from trustweave.plans.episode import Episode, EpisodeKeys, run_episode, score_senders

NAMES = [
    "kinematic_residual_m", "maximum_object_suspicion", "peer_corroboration_score",
    "kinematic_modality_applicable",
]


def replay_observations(
    frames: DataFrame, evidence: DataFrame, keys: list[str], case: str, *, ego: str,
    targets: DataFrame | None = None, affected: DataFrame | None = None,
) -> DataFrame:
    """Replay rows of one case: every expected sender, companions included.

    The vector holds the three inputs, with nothing known counting as zero.
    """
    wide = to_wide(evidence, keys, NAMES, largest=("maximum_object_suspicion",))
    rows = frames.join(wide, keys, "left")
    for name, hit in (("intended_target", targets), ("actually_affected", affected)):
        if hit is None:
            rows = rows.withColumn(name, F.lit(False))
        else:
            marked = hit.select(*keys).distinct().withColumn(name, F.lit(True))
            rows = rows.join(marked, keys, "left").fillna(False, [name])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    peer = F.coalesce(1 - F.col("peer_corroboration_score"), F.lit(0.0))
    return rows.select(
        F.lit(case).alias("case"), *[c for c in frames.columns if c != "reason_code"],
        (F.col("agent_id") == ego).alias("is_ego"),
        F.col("kinematic_residual_m").alias("kinematic_error_m"),
        F.col("maximum_object_suspicion").alias("two_sided_count_residual"),
        "peer_corroboration_score",
        (F.coalesce("kinematic_modality_applicable", F.lit(0.0)) != 0).alias("kinematic_applicable"),
        F.array(zero("kinematic_residual_m"), zero("maximum_object_suspicion"), peer).alias("payload"),
        F.lit(1.0).alias("local_confidence"), "intended_target", "actually_affected",
    )


def _cases(
    frames: DataFrame, evidence: DataFrame, delta: DataFrame, *, sender: list[str],
    evidence_keys: list[str], ego: str, targets: DataFrame,
) -> tuple[DataFrame, EpisodeKeys, list[str]]:
    """Rows of both cases, their keys and the packets' identity."""
    perturbed = merge_delta(evidence, delta, evidence_keys)
    both = replay_observations(frames, evidence, sender, "clean", ego=ego, targets=targets).unionByName(
        replay_observations(
            frames, perturbed, sender, "perturbed", ego=ego, targets=targets, affected=delta
        )
    )
    scene = [k for k in sender if k != "agent_id"]
    history = [k for k in scene if k != "sync_frame_id"]
    keys = EpisodeKeys(sender=["case", *history, "agent_id"], frame=["case", *scene, "decision_time_ns"])
    return both, keys, ["case", *scene, "decision_time_ns", "agent_id", "source_time_ns"]


def compare_replay(
    frames: DataFrame, evidence: DataFrame, delta: DataFrame, *, sender: list[str],
    evidence_keys: list[str], ego: str, targets: DataFrame, **options,
) -> Episode:
    """Both cases in one run: the clean evidence and the evidence with the delta."""
    both, keys, identity = _cases(
        frames, evidence, delta, sender=sender, evidence_keys=evidence_keys, ego=ego, targets=targets
    )
    return run_episode(both, keys, replay=True, packet_identity=identity, width=3, **options)


def compare_senders(
    frames: DataFrame, evidence: DataFrame, delta: DataFrame, *, sender: list[str],
    evidence_keys: list[str], ego: str, targets: DataFrame, **options,
) -> DataFrame:
    """The senders of :func:`compare_replay` alone, without packets, fusion and reports."""
    both, keys, _ = _cases(
        frames, evidence, delta, sender=sender, evidence_keys=evidence_keys, ego=ego, targets=targets
    )
    return score_senders(both, keys, **options)
