"""Pose lookup by bracketing samples, without extrapolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustweave.functions.geometry import parts_of, slerp, vec
from trustweave.operators.ordered import DAY_NS, Running, running, time_slot
from trustweave.schemas import BUFFERED, CAUSAL, SOURCE_KEY


def pose_at(
    targets: DataFrame,
    samples: DataFrame,
    *,
    policy: str = CAUSAL,
    max_gap_ns: int,
    lookahead_ns: int = 0,
    slot_ns: int = DAY_NS,
    keys: list[str] = SOURCE_KEY,
) -> DataFrame:
    """Append the pose at ``target_time_ns`` as known at ``decision_time_ns``.

    An exact sample wins; else the two neighbours are interpolated (straight line
    and short arc) when their gap is allowed and the newer one is known in time.
    """
    if max_gap_ns <= 0:
        raise ValueError("max_gap_ns must be positive")
    if policy not in (CAUSAL, BUFFERED) or (policy == CAUSAL) != (lookahead_ns == 0):
        raise ValueError("the look-ahead must be zero for causal and positive for buffered")
    known = samples.select(
        *keys, F.col("time_ns").alias("__t"), F.lit(0).alias("__kind"),
        F.struct("time_ns", "translation_m", "quaternion_xyzw").alias("__sample"),
    )
    asked = targets.select("*", F.col("target_time_ns").alias("__t"), F.lit(1).alias("__kind"))
    line = asked.unionByName(known, allowMissingColumns=True)
    line = running(
        line, keys, ["__t", "__kind"], time_slot(F.col("__t"), slot_ns),
        [
            Running("__p", F.col("__sample")),
            Running("__f", F.col("__sample"), reverse=True, include_current=False),
        ],
    )
    rows = line.filter("__kind = 1")
    target = F.col("target_time_ns")
    exact = F.col("__p.time_ns") == target
    rows = rows.withColumn("__n", F.when(exact, F.col("__p")).otherwise(F.col("__f")))
    before, after = F.col("__p"), F.col("__n")
    limit = F.col("decision_time_ns") + lookahead_ns
    reason = (
        F.when(before.isNull() | after.isNull(), "out_of_range")
        .when(after["time_ns"] - before["time_ns"] > max_gap_ns, "invalid_pose")
        .when(after["time_ns"] > limit, "future_pose_unavailable")
        .otherwise("matched")
    )
    span = (after["time_ns"] - before["time_ns"]).cast("double")
    share = F.when(span > 0, (target - before["time_ns"]).cast("double") / span).otherwise(0.0)
    ok = F.col("reason_code") == "matched"
    a, b = before["translation_m"], after["translation_m"]
    q, r = before["quaternion_xyzw"], after["quaternion_xyzw"]
    rows = rows.withColumn("reason_code", reason).withColumns({
        "__share": share,
        **{f"__a{c}": F.when(ok, q[c]) for c in "xyzw"},
        **{f"__b{c}": F.when(ok, r[c]) for c in "xyzw"},
    })
    rows = slerp(rows, parts_of("__a", "xyzw"), parts_of("__b", "xyzw"), F.col("__share"), "__q")
    moved = vec(*[a[c] + F.col("__share") * (b[c] - a[c]) for c in "xyz"])
    return rows.select(
        *targets.columns,
        "reason_code",
        before["time_ns"].alias("previous_time_ns"),
        after["time_ns"].alias("next_time_ns"),
        F.when(ok, after["time_ns"]).alias("pose_source_time_ns"),
        F.when(ok, F.col("decision_time_ns") - after["time_ns"]).alias("pose_age_ns"),
        F.when(ok, moved.col()).alias("translation_m"),
        F.when(ok, F.when(exact, q).otherwise(parts_of("__q", "xyzw").col())).alias("quaternion_xyzw"),
    )
