"""Long (entity, name, value) evidence and its wide view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Item:
    """One evidence name with its value and why the value may be missing."""

    name: str
    value: Column
    reason: Column | str = "incomplete_evidence"
    applicable: Column | bool = True


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def to_long(df: DataFrame, identity: list[str], items: list[Item]) -> DataFrame:
    """One row per (entity, evidence name); a missing value keeps its reason."""
    structs = []
    for item in items:
        value = item.value.cast("double")
        structs.append(F.struct(
            F.lit(item.name).alias("evidence_name"),
            value.alias("value"),
            _col(item.applicable).alias("applicable"),
            value.isNotNull().alias("available"),
            F.when(value.isNotNull(), "matched").otherwise(_col(item.reason)).alias("reason_code"),
        ))
    return df.select(*identity, F.inline(F.array(*structs)))


def to_wide(
    evidence: DataFrame, keys: list[str], names: list[str], largest: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key with a column per name: the largest or the smallest value.

    Conditional aggregates instead of ``pivot``: one pass, combined before the shuffle.
    """
    wanted = evidence.filter(F.col("evidence_name").isin(*names))
    pick = lambda n: F.when(F.col("evidence_name") == n, F.col("value"))
    return wanted.groupBy(*keys).agg(
        *[(F.max if n in largest else F.min)(pick(n)).alias(n) for n in names]
    )


STABLE_ORDER = [
    "sync_frame_id", "agent_id", "evidence_level", "object_index", "object_key", "evidence_name",
]


def stable_order(evidence: DataFrame, columns: list[str] = STABLE_ORDER) -> DataFrame:
    """Total order with nulls first (numeric object keys sort as numbers)."""
    return evidence.orderBy(*[F.asc_nulls_first(c) for c in columns if c in evidence.columns])


def playback(evidence: DataFrame, keys: list[str] = ("sync_frame_id", "agent_id")) -> DataFrame:
    """Per frame and agent: worst count residuals and how the cloud stood."""
    value = lambda n: F.when(F.col("evidence_name") == n, F.col("value"))
    reason = lambda n: F.when(F.col("evidence_name") == n, F.col("reason_code"))
    return evidence.groupBy(*keys).agg(
        F.max(value("count_deficit_residual_development")).alias("maximum_deficit"),
        F.max(value("count_surplus_residual_development")).alias("maximum_surplus"),
        F.min(value("kinematic_residual_m")).alias("kinematic_residual_m"),
        F.min(reason("kinematic_residual_m")).alias("kinematic_reason"),
        F.min(value("unknown_aware_fixed_risk_uncalibrated")).alias("risk"),
        F.min(reason("unknown_aware_fixed_risk_uncalibrated")).alias("risk_reason"),
        (F.max(value("transform_verified")) == 1.0).alias("transform_verified"),
    )
