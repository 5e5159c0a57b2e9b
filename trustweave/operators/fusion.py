"""Mean fusion of aligned vectors and its error against a reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustweave.functions.canonical import vector_error


def _same_width(selected) -> "F.Column":
    low = F.min(F.when(selected, F.size("vector")))
    high = F.max(F.when(selected, F.size("vector")))
    return F.when(
        low != high, F.raise_error(F.lit("fused vectors must have one width")).cast("int")
    ).otherwise(low)


def mean_fusion(
    contributions: DataFrame,
    frame_keys: list[str],
    *,
    width: int | None = None,
    require_ego: bool = True,
    frames: DataFrame | None = None,
) -> DataFrame:
    """One fused row per frame.

    ``contributions``: frame keys, ``agent_id, is_ego, valid, aligned, vector,
    quality_score, predictive_uncertainty``. With ``require_ego`` a frame without a
    usable ego abstains and one with only the ego is degraded; without it, whatever
    exists is averaged. ``frames`` adds frames that have no contribution at all.

    When ``width`` is known the means are plain columns, all combined before the
    one shuffle; otherwise vectors are unfolded by position first.
    """
    rows = contributions
    if "valid" not in rows.columns:
        rows = rows.withColumn("valid", F.lit(True))
    if "aligned" not in rows.columns:
        rows = rows.withColumn("aligned", F.lit(True))
    for name, default in (("quality_score", 1.0), ("predictive_uncertainty", None)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default).cast("double"))
    use = F.col("valid") & F.col("aligned") & F.col("vector").isNotNull()
    mine = F.col("is_ego")
    scalars = [
        F.count_if(mine).alias("__egos"),
        F.count_if(mine & use).alias("__ego"),
        F.count_if(~mine & use).alias("__remote"),
        F.avg(F.when(use, F.col("quality_score"))).alias("__quality"),
        F.count_if(use & F.col("predictive_uncertainty").isNull()).alias("__unsure"),
        F.avg(F.when(use, F.col("predictive_uncertainty"))).alias("__uncertainty"),
        _same_width(use).alias("__width"),
    ]
    if width is not None:
        means = [F.avg(F.when(use, F.col("vector")[i])).alias(f"__m{i}") for i in range(width)]
        grouped = rows.groupBy(*frame_keys).agg(*scalars, *means).withColumn(
            "__mean", F.array(*[F.col(f"__m{i}") for i in range(width)])
        )
        grouped = grouped.withColumn(
            "__mean",
            F.when(
                F.col("__width") != width,
                F.raise_error(F.lit("declared width differs")).cast("array<double>"),
            ).otherwise(F.col("__mean")),
        )
    else:
        parts = (
            rows.filter(use)
            .select(*frame_keys, F.posexplode("vector").alias("__pos", "__x"))
            .groupBy(*frame_keys, "__pos").agg(F.avg("__x").alias("__x"))
            .groupBy(*frame_keys)
            # one entry per position: bounded by the vector width
            .agg(F.array_sort(F.collect_list(F.struct("__pos", "__x"))).alias("__p"))
            .select(*frame_keys, F.transform("__p", lambda p: p["__x"]).alias("__mean"))
        )
        grouped = rows.groupBy(*frame_keys).agg(*scalars).join(parts, frame_keys, "left")
    if frames is not None:
        grouped = frames.select(*frame_keys).distinct().join(grouped, frame_keys, "left").fillna(
            0, ["__egos", "__ego", "__remote"]
        )
    total = F.col("__ego") + F.col("__remote")
    usable = (F.col("__ego") > 0) if require_ego else (total > 0)
    usable = usable & (F.when(
        F.col("__egos") > 1, F.raise_error(F.lit("more than one ego in a frame")).cast("boolean")
    ).otherwise(F.lit(True)))
    usable = usable & (F.coalesce("__width", F.lit(0)) >= 0)  # keeps the width check in the plan
    lonely = F.col("__remote") == 0
    reason = (
        F.when(~usable, "ego_absent" if require_ego else "no_contributor")
        .when(lonely, "ego_only_fallback").otherwise("cooperative")
    )
    n = F.when(usable, total).otherwise(0)
    remote = F.when(usable, F.col("__remote")).otherwise(0)
    uncertainty = F.when(usable & (F.col("__unsure") == 0), F.col("__uncertainty"))
    degraded = ~usable | lonely if require_ego else usable & lonely
    return grouped.select(
        *frame_keys,
        F.when(usable, F.col("__mean")).alias("fused_vector"),
        (~usable).alias("abstained"),
        degraded.alias("degraded"),
        reason.alias("reason"),
        n.alias("contributor_count"),
        remote.alias("remote_contributor_count"),
        F.when(n > 0, remote / n).otherwise(0.0).alias("total_remote_weight"),
        F.when(usable, F.col("__quality")).alias("quality_score"),
        uncertainty.alias("predictive_uncertainty"),
        uncertainty.isNotNull().alias("uncertainty_available"),
    )


def ego_only(contributions: DataFrame, frame_keys: list[str], **options) -> DataFrame:
    """The ego-only answer: frames whose ego is missing abstain."""
    frames = contributions.select(*frame_keys)
    return mean_fusion(
        contributions.filter("is_ego"), frame_keys, frames=frames, **options
    )


def admitted_packets(packets: DataFrame, schedule: DataFrame, by: list[str]) -> DataFrame:
    """Packets that a schedule admits, matched by packet hash (and ``by``)."""
    keys = [*by, "packet_sha256"]
    return packets.join(schedule.filter("admitted").select(*keys), keys, "left_semi")


def reconstruction_error(fused: DataFrame, reference: str = "clean_reference") -> DataFrame:
    """Append the distance to the reference vector and the utility 1 / (1 + error)."""
    same = F.size("fused_vector") == F.size(reference)
    error = F.when(
        F.col("fused_vector").isNotNull(),
        F.when(same, vector_error(F.col("fused_vector"), F.col(reference))).otherwise(
            F.raise_error(F.lit("fused and reference vectors differ in width")).cast("double")
        ),
    )
    return fused.withColumn("proxy_reconstruction_error", error).withColumn(
        "proxy_utility", 1 / (1 + F.col("proxy_reconstruction_error"))
    )
