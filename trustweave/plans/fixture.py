"""The two-case pipeline report over nested fixture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trustweave.operators.metrics import policy_totals
from trustweave.operators.temporal import Smoothing
from trustweave.plans.episode import Episode, EpisodeKeys, run_episode
from trustweave.sources.files import read_fixture

CLEAN, CORRUPTED = "clean", "integration_corruption"
FRAME = [
    "fixture_run_id", "fixture_case", "source_id", "sequence_id", "session_id",
    "sync_frame_id", "decision_time_ns",
]
# The fields of a packet descriptor besides size and integrity.
DESCRIPTOR = [
    "schema_version", *FRAME, "agent_id", "source_time_ns", "sender_id", "pose",
    "region_or_object_key", "payload_type", "local_confidence",
]


def fixture_cases(rows: DataFrame) -> DataFrame:
    """Both cases of every fixture; in one, the named observation is replaced."""
    change = F.col("integration_corruption")
    hit = (F.col("sync_frame_id") == change["target_sync_frame_id"]) & (
        F.col("agent_id") == change["target_agent_id"]
    )
    both = rows.withColumn("fixture_case", F.explode(F.array(F.lit(CLEAN), F.lit(CORRUPTED))))
    both = both.withColumn("corrupted", hit & (F.col("fixture_case") == CORRUPTED))
    fields = ("kinematic_error_m", "two_sided_count_residual", "peer_corroboration_score", "vector")
    both = both.withColumns({
        f: F.when(F.col("corrupted"), change["replacement"][f]).otherwise(F.col(f)) for f in fields
    })
    return both.drop("integration_corruption").withColumnRenamed("vector", "payload").withColumns({
        "schema_version": F.lit("1.0.0"), "sender_id": F.col("agent_id"),
        "payload_type": F.lit("aligned_proxy_vector"),
    })


def run_fixture(spark: SparkSession, path: str) -> Episode:
    """Run both cases of one fixture file."""
    rows = read_fixture(spark, path)
    settings = rows.select("ewma", "max_source_age_ns").first()
    keys = EpisodeKeys(
        sender=["fixture_run_id", "fixture_case", "sequence_id", "session_id", "agent_id"], frame=FRAME
    )
    smoothing = Smoothing(
        settings["ewma"]["alpha"], settings["ewma"]["threshold"], settings["ewma"]["initial_value"]
    )
    return run_episode(
        fixture_cases(rows.drop("ewma", "max_source_age_ns")), keys, smoothing=smoothing,
        max_source_age_ns=settings["max_source_age_ns"], packet_identity=DESCRIPTOR,
        nested=DESCRIPTOR, reference="clean_reference",
    )


def fixture_report(episode: Episode) -> DataFrame:
    """Totals per case and policy."""
    return policy_totals(episode.metrics, ["fixture_case", "policy"])
