"""Frame, policy, episode and coverage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.operators.joins import checked_join, key_difference
from trustweave.schemas import STATES


def state_count_map(states: Column) -> Column:
    """Map state -> rows without the states that do not occur."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(s) for s in sorted(STATES)]),
        F.array(*[F.count_if(states == s) for s in sorted(STATES)]),
    )
    return F.map_filter(counts, lambda _, n: n > 0)


def completeness_problems(
    predictions: DataFrame, states: DataFrame, keys: list[str]
) -> DataFrame:
    """Senders with a prediction but no state row, or the reverse."""
    return key_difference(predictions, states, keys)


def frame_metrics(
    senders: DataFrame,
    schedule: DataFrame,
    fusion: DataFrame,
    frame_keys: list[str],
    *,
    corrupted: str = "corrupted",
) -> DataFrame:
    """One row per frame and policy; missing senders and companions all count.

    ``senders`` holds prediction and state of every expected sender, ``schedule``
    one row per packet and policy (with a boolean ``corrupted`` column), ``fusion``
    one row per frame and policy with its reconstruction error.
    """
    per_frame = senders.groupBy(*frame_keys).agg(
        F.count("*").alias("observation_count"),
        F.count_if(~F.col("evidence_available")).alias("missing_observation_count"),
        F.count("risk_score").alias("prediction_available_count"),
        F.count_if("abstained").alias("abstention_count"),
        F.max("risk_score").alias("maximum_uncalibrated_risk"),
        state_count_map(F.col("current_state")).alias("state_counts"),
    )
    nbytes = F.col("admitted_bytes")
    sent = schedule.groupBy(*frame_keys, "policy").agg(
        F.sum(nbytes).alias("admitted_bytes"),
        F.sum(F.when(F.col(corrupted), nbytes).otherwise(0)).alias("corrupted_source_bytes"),
    )
    shown = fusion.select(
        *frame_keys, "policy",
        *[c for c in ("proxy_reconstruction_error", "proxy_utility") if c in fusion.columns],
        F.col("degraded").alias("fallback"), F.col("abstained").alias("fusion_abstained"),
    )
    rows = checked_join(shown, sent, [*frame_keys, "policy"], "one_to_one", verify=False)
    rows = rows.fillna(0, ["admitted_bytes", "corrupted_source_bytes"])
    return checked_join(rows, per_frame, frame_keys, "many_to_one", verify=False)


def policy_totals(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, error and fallbacks summed per case and policy."""
    return metrics.groupBy(*by).agg(
        F.sum("admitted_bytes").alias("admitted_bytes"),
        F.sum("corrupted_source_bytes").alias("corrupted_source_bytes"),
        F.coalesce(F.sum("proxy_reconstruction_error"), F.lit(0.0)).alias(
            "proxy_reconstruction_error"
        ),
        F.count_if("fallback").alias("fallback_count"),
        F.count_if("fusion_abstained").alias("fusion_abstention_count"),
    )


def episode_metrics(
    senders: DataFrame, schedule: DataFrame, fusion: DataFrame, frame_keys: list[str]
) -> DataFrame:
    """Replay report per frame and policy with the honest companions kept."""
    honest = ~F.col("intended_target")
    per_frame = senders.groupBy(*frame_keys).agg(
        F.count("*").alias("observation_count"),
        F.count_if(honest).alias("honest_companion_count"),
        F.count_if(honest & F.col("actually_affected")).alias(
            "actually_affected_honest_companion_count"
        ),
    )
    nbytes = F.col("admitted_bytes")
    sent = schedule.groupBy(*frame_keys, "policy").agg(
        F.sum(nbytes).alias("admitted_bytes"),
        F.sum(F.when(F.col("actually_affected"), nbytes).otherwise(0)).alias(
            "affected_source_bytes"
        ),
    )
    shown = fusion.select(
        *frame_keys, "policy", F.col("degraded").alias("fallback"),
        F.col("abstained").alias("fusion_abstained"),
    )
    return (
        shown.join(sent, [*frame_keys, "policy"], "left")
        .fillna(0, ["admitted_bytes", "affected_source_bytes"])
        .join(per_frame, frame_keys)
    )


COVERAGE = ("family", "severity", "agent_type", "status", "realized_effect_band")


def coverage(attempts: DataFrame, dimensions: tuple[str, ...] = COVERAGE) -> DataFrame:
    """Total and one-dimensional counts of all attempts, failed ones included."""
    sets = [[], *[[F.col(d)] for d in dimensions]]
    counted = attempts.groupingSets(sets, *dimensions).agg(
        F.count("*").alias("attempts"), F.grouping_id(*dimensions).alias("__g")
    )
    full = (1 << len(dimensions)) - 1
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        here = F.col("__g") == full - (1 << (len(dimensions) - 1 - i))
        name = F.when(here, d).otherwise(name)
        value = F.when(here, F.col(d).cast("string")).otherwise(value)
    return counted.select(name.alias("dimension"), value.alias("value"), "attempts")


def effect_status(maximum: Column, low: float = 0.01) -> Column:
    return F.when(maximum == 0, "zero_effect").when(maximum < low, "low_effect").otherwise(
        "succeeded"
    )


def effect_band(maximum: Column, low: float = 0.1) -> Column:
    return F.when(maximum == 0, "zero").when(maximum < low, "low").otherwise("material")
