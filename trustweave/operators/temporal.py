"""Exponential smoothing with missing values held, and threshold state labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustweave.operators.ordered import SLOT, int_div

CUTOFF = 1e-20


@dataclass(frozen=True)
class Smoothing:
    alpha: float = 0.30
    threshold: float = 0.25
    initial_value: float | None = None

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError("alpha must lie in (0, 1]")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")
        if self.initial_value is not None and not 0 <= self.initial_value <= 1:
            raise ValueError("initial_value must lie in [0, 1]")


def ewma(
    df: DataFrame, keys: list[str], order: list[str], slot: Column, value: str,
    config: Smoothing = Smoothing(),
) -> DataFrame:
    """Append ``ewma``, ``available``, ``ewma_previous``, ``available_previous``.

    ``e = a*x + (1-a)*e_prev`` over the available rows of a key. Expanded, every
    term of the sum carries a power of ``r = 1-a``, so the fold becomes a prefix
    sum. Positions are cut into blocks so long that ``r**block`` vanishes: powers
    inside a block stay in range, and only the block before matters. One shuffle
    of the rows by (key, slot); slots hand over through one row per (key, slot).
    """
    r = 1.0 - config.alpha
    a = config.alpha
    block = 1 if r == 0 else max(2, math.ceil(math.log(CUTOFF) / math.log(r)))
    x = F.col(value)
    has = x.isNotNull()
    part = [*keys, SLOT]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    rows = df.withColumn(SLOT, slot).withColumn("__p", F.count(x).over(upto))
    power = lambda e: F.pow(F.lit(r), e.cast("double"))

    rows = rows.withColumn(
        "__b", int_div(F.greatest(F.col("__p"), F.lit(1)) - 1, block)
    ).withColumn("__q", F.col("__p") - F.col("__b") * block)
    # positions never fall along the order, so (block, order) is the order itself and
    # one sort serves all windows from here on
    step = Window.partitionBy(*part).orderBy("__b", *order)
    if r == 0:
        local = F.last(x, ignorenulls=True).over(step.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__e", local)
    else:
        in_block = Window.partitionBy(*part, "__b").orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0
        )
        prior_block = Window.partitionBy(*part).orderBy("__b").rangeBetween(-1, -1)
        rows = rows.withColumn("__s", F.sum(a * x * power(-F.col("__q"))).over(in_block))
        rows = rows.withColumn(
            "__l", F.sum(a * x * power(F.lit(block) - F.col("__q"))).over(prior_block)
        )
        zero = F.lit(0.0)
        rows = rows.withColumn(
            "__e", power(F.col("__q")) * (F.coalesce("__s", zero) + F.coalesce("__l", zero))
        )
    rows = rows.withColumns({
        "__e1": F.lag("__e").over(step), "__p1": F.lag("__p").over(step), "__has1": F.lag(has).over(step),
    })

    # one row per (key, slot): how many values it has and what it adds
    position = F.struct(*order)
    ends = rows.groupBy(*part).agg(
        F.count(x).alias("__n"),
        F.max_by("__e", position).alias("__d"),
        F.min_by(x, F.when(has, position)).alias("__x1"),
        F.max_by(has, position).alias("__last_has"),
    )
    chain = Window.partitionBy(*keys).orderBy(SLOT)
    ends = ends.withColumn(
        "__N", F.sum("__n").over(chain.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("__first_x", F.first("__x1", ignorenulls=True).over(
        chain.rowsBetween(Window.unboundedPreceding, 0)
    ))
    ends = ends.withColumn(
        "__B", int_div(F.greatest(F.col("__N"), F.lit(1)) - 1, block)
    ).withColumn("__Q", F.col("__N") - F.col("__B") * block)
    added = F.when(F.col("__n") > 0, F.col("__d"))
    same = Window.partitionBy(*keys, "__B").orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__B").rangeBetween(-1, -1)
    if r == 0:
        smoothed = F.last(added, ignorenulls=True).over(
            chain.rowsBetween(Window.unboundedPreceding, 0)
        )
    else:
        smoothed = power(F.col("__Q")) * (
            F.coalesce(F.sum(added * power(-F.col("__Q"))).over(same), F.lit(0.0))
            + F.coalesce(
                F.sum(added * power(F.lit(block) - F.col("__Q"))).over(earlier), F.lit(0.0)
            )
        )
    # the value before the first: the configured one, or the first value itself
    start = F.lit(config.initial_value) if config.initial_value is not None else F.col("__first_x")
    ends = ends.withColumn("__E", smoothed)
    lagged = lambda c: F.lag(c).over(chain)
    carry = ends.select(
        *part,
        F.coalesce(lagged("__N"), F.lit(0)).alias("__N0"),
        F.coalesce(lagged("__E"), F.lit(0.0)).alias("__E0"),
        start.cast("double").alias("__start"),
        lagged("__last_has").alias("__has0"),
    )
    out = rows.join(carry, part, "left")

    def value_at(local: Column, position: Column) -> Column:
        """Smoothed value after ``position`` values of the slot; null before the first."""
        count = F.col("__N0") + position
        if r == 0:
            return F.coalesce(local, F.when(F.col("__N0") > 0, F.col("__E0")))
        full = (
            local
            + power(position) * F.col("__E0")
            + power(count) * F.coalesce(F.col("__start"), F.lit(0.0))
        )
        return F.when(count > 0, full)

    first = F.col("__p1").isNull()
    nothing = F.lit(None).cast("double") if r == 0 else F.lit(0.0)
    before = F.when(first, value_at(nothing, F.lit(0))).otherwise(value_at(F.col("__e1"), F.col("__p1")))
    return out.select(
        *df.columns,
        value_at(F.col("__e"), F.col("__p")).alias("ewma"),
        has.alias("available"),
        before.alias("ewma_previous"),
        F.when(first, F.col("__has0")).otherwise(F.col("__has1")).alias("available_previous"),
    )


def _label(available: Column, value: Column, threshold: float) -> Column:
    return (
        F.when(~F.coalesce(available, F.lit(False)), "unknown")
        .when(value >= threshold, "quarantined")
        .otherwise("normal")
    )


def label_state(df: DataFrame, config: Smoothing = Smoothing()) -> DataFrame:
    """Append state columns to the output of :func:`ewma`; no hysteresis."""
    first = F.col("available") & F.col("ewma_previous").isNull()
    reason = (
        F.when(~F.col("available") & F.col("ewma").isNull(), "missing_evidence_no_prior")
        .when(~F.col("available"), "missing_evidence_prior_held_marked_unknown")
        .when(
            first,
            "initialized_from_first_available"
            if config.initial_value is None
            else "initialized_from_configured_value",
        )
        .otherwise("updated")
    )
    current = _label(F.col("available"), F.col("ewma"), config.threshold)
    previous = _label(F.col("available_previous"), F.col("ewma_previous"), config.threshold)
    labelled = df.select(
        "*",
        F.when(F.col("available"), F.col("ewma") >= config.threshold).alias("threshold_exceeded"),
        previous.alias("previous_state"),
        current.alias("current_state"),
        reason.alias("update_reason"),
    )
    return labelled.withColumn(
        "transition_reason",
        F.concat(
            F.when(F.col("current_state") == F.col("previous_state"), "remained").otherwise(
                "transitioned"
            ),
            F.lit(":"), "previous_state", F.lit("->"), "current_state", F.lit(":"), "update_reason",
        ),
    )
