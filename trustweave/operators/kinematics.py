"""Interval kinematics: does the reported motion explain the travelled distance?"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.functions.geometry import (
    add, columns_of, cross, dot, finite_vec, norm, parts_of, quat_conjugate, quat_first_angle,
    quat_multiply, quat_normalize, quat_rotate, scale, sub,
)
from trustweave.operators.ordered import DAY_NS, previous_row, time_slot

SAMPLE = ["time_ns", "position_m", "quaternion_xyzw", "body_velocity_mps"]
SUBSTEPS = 10
NORM_TOLERANCE = 1e-3


def _turning(turn: str, substeps: int) -> dict[str, Column]:
    """Rotation axis and the means of cos and sin over the substep midpoints.

    Along the short arc only the angle grows, so the mean of a vector over the
    midpoint orientations needs the means of cos and sin of an arithmetic series of
    angles. These have closed forms: no loop per row.
    """
    w = F.col(f"{turn}w")
    s = norm(parts_of(turn))
    tiny = s < 1e-15
    angle = 2 * F.atan2(s, w)
    below = substeps * F.sin(angle / (2 * substeps))
    half = F.sin(angle / 2)
    out = {
        f"__n{p}": F.when(tiny, 0.0).otherwise(F.col(f"{turn}{p}") / F.when(tiny, 1.0).otherwise(s))
        for p in "xyz"
    }
    out["__cos"] = F.when(tiny, 1.0).otherwise(half * F.cos(angle / 2) / F.when(tiny, 1.0).otherwise(below))
    out["__sin"] = F.when(tiny, 0.0).otherwise(half * half / F.when(tiny, 1.0).otherwise(below))
    return out


def interval_kinematics(
    odometry: DataFrame,
    keys: list[str],
    *,
    max_gap_s: float,
    substeps: int = SUBSTEPS,
    norm_tolerance: float = NORM_TOLERANCE,
    slot_ns: int = DAY_NS,
) -> DataFrame:
    """One row per sample with the evidence of the interval that ends there.

    A key's first sample has no interval and is reported ``out_of_range``.
    """
    if substeps <= 0:
        raise ValueError("substeps must be positive")
    if not math.isfinite(max_gap_s) or max_gap_s <= 0:
        raise ValueError("max_gap_s must be finite and positive")
    rows = previous_row(
        odometry, keys, ["time_ns"], time_slot(F.col("time_ns"), slot_ns), SAMPLE
    )
    return measure_intervals(rows, max_gap_s, substeps, norm_tolerance)


def measure_intervals(
    rows: DataFrame, max_gap_s: float, substeps: int = SUBSTEPS,
    norm_tolerance: float = NORM_TOLERANCE,
) -> DataFrame:
    """Evidence columns for rows that already hold their ``previous`` sample."""
    prev, cur = F.col("previous"), F.struct(*SAMPLE)
    keep = [c for c in rows.columns if c not in ("previous", *SAMPLE[1:])]
    good = finite_vec(prev["position_m"]) & finite_vec(cur["position_m"])
    good = good & finite_vec(prev["body_velocity_mps"]) & finite_vec(cur["body_velocity_mps"])
    good = good & finite_vec(prev["quaternion_xyzw"], "xyzw")
    good = good & finite_vec(cur["quaternion_xyzw"], "xyzw")
    dt_ns = cur["time_ns"] - prev["time_ns"]
    dt = dt_ns.cast("double") / 1e9
    off = lambda q: (norm(q, "xyzw") == 0) | (
        F.abs(norm(q, "xyzw") - 1) > norm_tolerance
    )
    reason = (
        F.when(prev.isNull(), "out_of_range")
        .when(~good, "nonfinite")
        .when(dt_ns <= 0, "nonpositive_dt")
        .when(dt > max_gap_s, "excessive_gap")
        .when(off(prev["quaternion_xyzw"]) | off(cur["quaternion_xyzw"]), "invalid_quaternion")
        .otherwise("matched")
    )
    # one projection per step, so that no expression is repeated inside another
    ok = F.col("reason_code") == "matched"
    q0, q1 = parts_of("__a", "xyzw"), parts_of("__b", "xyzw")
    v0, v1 = prev["body_velocity_mps"], F.col("body_velocity_mps")
    steps = rows.select("*", reason.alias("reason_code"), dt.alias("__dt")).withColumns({
        **{f"__a{p}": F.when(ok, prev["quaternion_xyzw"][p]) for p in "xyzw"},
        **{f"__b{p}": F.when(ok, F.col(f"quaternion_xyzw.{p}")) for p in "xyzw"},
        **columns_of("__v", scale(add(v0, v1), F.lit(0.5))),
    })
    steps = steps.withColumns({**columns_of("__a", quat_normalize(q0)), **columns_of("__b", quat_normalize(q1))})
    steps = steps.withColumns(columns_of("__t", quat_multiply(quat_conjugate(q0), q1)))
    short = F.when(F.col("__tw") < 0, -1.0).otherwise(1.0)
    steps = steps.withColumns({f"__t{p}": short * F.col(f"__t{p}") for p in "xyzw"})
    steps = steps.withColumns(_turning("__t", substeps))
    n, v = parts_of("__n"), parts_of("__v")
    steps = steps.withColumn("__along", dot(n, v))
    along = scale(n, F.col("__along"))
    turned = add(add(along, scale(sub(v, along), F.col("__cos"))), scale(cross(n, v), F.col("__sin")))
    steps = steps.withColumns(columns_of("__l", turned))
    steps = steps.withColumns(columns_of("__m", scale(quat_rotate(q0, parts_of("__l")), F.col("__dt"))))
    actual = sub(F.col("position_m"), prev["position_m"])
    steps = steps.withColumns(columns_of("__d", actual))
    moved, gone = parts_of("__m"), parts_of("__d")
    left = sub(gone, moved)
    pick = lambda c: F.when(ok, c)
    return steps.select(
        *keep,
        ok.alias("kinematics_available"),
        "reason_code",
        pick(F.col("__dt")).alias("dt_s"),
        pick(0.5 * (norm(v0) + norm(v1))).alias("speed_mps"),
        pick(norm(sub(v1, v0)) / F.col("__dt")).alias("acceleration_mps2"),
        pick(quat_first_angle(quat_multiply(q1, quat_conjugate(q0)))).alias("yaw_change_rad"),
        pick(gone.col()).alias("actual_displacement_m"),
        pick(moved.col()).alias("integrated_displacement_m"),
        pick(left.col()).alias("residual_vector_m"),
        pick(norm(left)).alias("residual_m"),
        F.lit(substeps).alias("integration_substeps"),
    )


def attach_kinematics(
    frames: DataFrame, kinematics: DataFrame, keys: list[str] = ("agent_id",)
) -> DataFrame:
    """Join frames to the interval ending exactly at their source time.

    No sample at that time, or only a first one, is ``out_of_range``.
    """
    found = kinematics.select(
        *keys, F.col("time_ns").alias("source_time_ns"),
        F.struct(
            "kinematics_available", "reason_code", "dt_s", "speed_mps", "acceleration_mps2",
            "yaw_change_rad", "residual_m",
        ).alias("kinematics"),
    )
    none = F.struct(
        F.lit(False).alias("kinematics_available"), F.lit("out_of_range").alias("reason_code"),
        *[F.lit(None).cast("double").alias(c) for c in
          ("dt_s", "speed_mps", "acceleration_mps2", "yaw_change_rad", "residual_m")],
    )
    return frames.join(found, [*keys, "source_time_ns"], "left").withColumn(
        "kinematics", F.coalesce("kinematics", none)
    )
