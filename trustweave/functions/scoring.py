"""Missing-aware and fixed diagnostic scores as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Weights and caps of the published score.
KINEMATIC_CAP_M = 0.057
SUPPORT_CAP_POINTS = 350.0
COUNT_RESIDUAL_CAP = 3.0
MINIMUM_WEIGHT = 0.60
WEIGHT_EPSILON = 1e-12


@dataclass(frozen=True)
class Weights:
    kinematic: float = 0.40
    support: float = 0.30
    corroboration: float = 0.30

    def __post_init__(self):
        parts = (self.kinematic, self.support, self.corroboration)
        if not all(math.isfinite(p) and p >= 0 for p in parts):
            raise ValueError("weights must be finite and nonnegative")
        if abs(math.fsum(parts) - 1.0) > 1e-12:
            raise ValueError("weights must sum to one")


def _positive(**caps):
    for name, value in caps.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive")


def clip01(c: Column) -> Column:
    """Clip to [0, 1]; null stays null; a non-finite input fails the query."""
    clipped = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    broken = F.raise_error(F.lit("score input must be finite")).cast("double")
    # NaN and both infinities are the values that do not vanish when multiplied by zero
    return F.when(c * 0.0 == 0.0, clipped).when(c.isNotNull(), broken)


def missing_aware(
    kinematic_error: Column,
    count_residual: Column,
    peer_score: Column,
    kinematic_applicable: Column,
    weights: Weights = Weights(),
    kinematic_cap: float = KINEMATIC_CAP_M,
    residual_cap: float = COUNT_RESIDUAL_CAP,
    minimum_weight: float = MINIMUM_WEIGHT,
) -> Column:
    """Struct(trust, risk, available_weight, abstained, reason_code, three scores).

    Weights renormalise over what is present; too little weight, or missing but
    applicable kinematics, abstains.
    """
    _positive(kinematic_cap=kinematic_cap, residual_cap=residual_cap)
    if not 0 < minimum_weight <= 1:
        raise ValueError("minimum_weight must lie in (0, 1]")
    # weights depend on which inputs exist only, so the long score expressions occur once
    blocked = kinematic_applicable & kinematic_error.isNull()
    parts = {
        "kinematic": (weights.kinematic, kinematic_error, 1 - clip01(kinematic_error / kinematic_cap)),
        "support": (weights.support, count_residual, 1 - clip01(count_residual / residual_cap)),
        "corroboration": (weights.corroboration, peer_score, clip01(peer_score)),
    }
    weighted, present = F.lit(0.0), F.lit(0.0)
    for weight, given, score in parts.values():
        weighted = weighted + F.coalesce(score * weight, F.lit(0.0))
        present = present + F.when(given.isNotNull(), weight).otherwise(0.0)
    abstained = blocked | (present + WEIGHT_EPSILON < minimum_weight)
    trust = F.when(~abstained, weighted / present)
    return F.struct(
        trust.alias("trust"),
        (1 - trust).alias("risk"),
        F.when(blocked, 0.0).otherwise(present).alias("available_weight"),
        abstained.alias("abstained"),
        F.when(abstained, "incomplete_evidence").otherwise("matched").alias("reason_code"),
        *[F.when(~blocked, s).alias(f"{n}_score") for n, (_, _, s) in parts.items()],
    )


def fixed_diagnostic(
    kinematic_error: Column,
    mean_count: Column,
    raw_share: Column,
    weights: Weights = Weights(),
    kinematic_cap: float = KINEMATIC_CAP_M,
    support_cap: float = SUPPORT_CAP_POINTS,
) -> Column:
    """Struct(trust, risk, three scores): missing kinematics scores 1, others 0."""
    _positive(kinematic_cap=kinematic_cap, support_cap=support_cap)
    kin = F.coalesce(1 - clip01(kinematic_error / kinematic_cap), F.lit(1.0))
    support = F.coalesce(clip01(mean_count / support_cap), F.lit(0.0))
    share = F.coalesce(clip01(raw_share), F.lit(0.0))
    trust = weights.kinematic * kin + weights.support * support + weights.corroboration * share
    return F.struct(
        trust.alias("trust"),
        (1 - trust).alias("risk"),
        kin.alias("kinematic_score"),
        support.alias("support_score"),
        share.alias("raw_share_score"),
    )


def prediction(score: Column, message_present: Column, missing_reason: Column) -> Column:
    """Struct(risk_score, operational_reliability, abstained, reason_code)."""
    risk = F.when(message_present & ~score["abstained"], score["risk"])
    return F.struct(
        risk.alias("risk_score"),
        (1 - risk).alias("operational_reliability"),
        risk.isNull().alias("abstained"),
        F.when(message_present, score["reason_code"])
        .otherwise(missing_reason)
        .alias("reason_code"),
    )


def count_residuals(count: Column, expected_log1p: float, scale: float) -> tuple[Column, Column]:
    """Two-sided residual of a count against a fixed log1p reference."""
    if not math.isfinite(expected_log1p) or not math.isfinite(scale) or scale <= 0:
        raise ValueError("the count reference must be finite with a positive scale")
    signed = (F.log1p(count.cast("double")) - expected_log1p) / scale
    zero = F.lit(0.0)
    known = count.isNotNull()
    return (
        F.when(known, F.greatest(-signed, zero)),
        F.when(known, F.greatest(signed, zero)),
    )
