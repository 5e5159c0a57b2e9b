"""Ordered per-key computations that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in a single task, so
one key with a third of all rows becomes the whole job. Here rows are partitioned
by ``(key, slot)``, where the slot is a coarse step of the ordering value. A small
table with one row per (key, slot), built with map-side combine, carries the state
from earlier slots into later ones, and joins back on the partitioning the rows
already have. The results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_NS = 86_400_000_000_000
SLOT = "__slot"


@dataclass(frozen=True)
class Running:
    """One running value: ``last`` (ignores nulls), ``max``, ``min`` or ``sum``.

    ``reverse`` scans from the last row to the first; ``include_current`` decides
    whether a row sees its own value.
    """

    name: str
    value: Column
    how: str = "last"
    reverse: bool = False
    include_current: bool = True


def int_div(a: Column, b) -> Column:
    """Exact integer quotient (``/`` goes through double and loses nanoseconds)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def time_slot(time: Column, slot_ns: int) -> Column:
    """Slot number of a nonnegative integer time."""
    if slot_ns <= 0:
        raise ValueError("slot_ns must be positive")
    return int_div(time, slot_ns)


def densest_rows(df: DataFrame, time: str, step_ns: int, keys: list[str] = ()) -> int:
    """Most rows that any key has in any ``step_ns`` of time, wherever they crowd.

    A histogram with partial sums before its shuffle; one number reaches the driver.
    """
    steps = df.groupBy(*keys, time_slot(F.col(time), step_ns).alias(SLOT)).agg(F.count("*").alias("n"))
    return steps.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def slot_for(densest: int, step_ns: int, target_rows: int) -> int:
    """Slot width whose fullest slot holds about the target, given the fullest step."""
    return max(1, step_ns * target_rows // max(densest, 1))


def choose_slot_ns(
    df: DataFrame, keys: list[str], time: str, target_rows: int = 2_000_000, step_ns: int = DAY_NS,
) -> int:
    """Slot width that keeps every slot of every key near the target, uneven fill included.

    Widths come from the fullest step of any key. A step that alone exceeds the target is
    looked at again in finer steps, since rows may crowd within it.
    """
    while True:
        densest = densest_rows(df, time, step_ns, keys)
        if densest <= target_rows or step_ns == 1:
            return slot_for(densest, step_ns, target_rows)
        step_ns = max(1, step_ns // 64)


def _combine(how: str, here: Column, before: Column) -> Column:
    if how == "max":
        return F.greatest(here, before)
    if how == "min":
        return F.least(here, before)
    if how == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    return F.coalesce(here, before)


def running(
    df: DataFrame, keys: list[str], order: list[str], slot: Column, values: list[Running]
) -> DataFrame:
    """Append running values over ``order`` within ``keys``.

    ``slot`` must not decrease along ``order``, and ``order`` must be a total order
    for ``last``. Both directions share one shuffle of the rows.
    """
    rows = df.withColumn(SLOT, slot)
    start = Window.unboundedPreceding
    position = F.struct(*order)
    here, totals, carried = [], [], []
    for v in values:
        way = F.desc if v.reverse else F.asc
        inside = (
            Window.partitionBy(*keys, SLOT).orderBy(*[way(c) for c in order])
            .rowsBetween(start, 0 if v.include_current else -1)
        )
        before = Window.partitionBy(*keys).orderBy(way(SLOT)).rowsBetween(start, -1)
        total = f"__t_{v.name}"
        if v.how == "last":
            pick = F.min_by if v.reverse else F.max_by
            here.append(F.last(v.value, ignorenulls=True).over(inside).alias(v.name))
            totals.append(pick(v.value, F.when(v.value.isNotNull(), position)).alias(total))
            carried.append(F.last(total, ignorenulls=True).over(before).alias(f"__c_{v.name}"))
        else:
            agg = {"max": F.max, "min": F.min, "sum": F.sum}[v.how]
            here.append(agg(v.value).over(inside).alias(v.name))
            totals.append(agg(v.value).alias(total))
            carried.append(agg(total).over(before).alias(f"__c_{v.name}"))
    scanned = rows.select("*", *here)
    carry = rows.groupBy(*keys, SLOT).agg(*totals).select(*keys, SLOT, *carried)
    return scanned.join(carry, [*keys, SLOT], "left").select(
        *df.columns,
        *[_combine(v.how, F.col(v.name), F.col(f"__c_{v.name}")).alias(v.name) for v in values],
    )


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], slot: Column, columns: list[str],
    name: str = "previous",
) -> DataFrame:
    """Append a struct of the previous row's ``columns`` (null on a key's first row)."""
    value = Running(name, F.struct(*columns), include_current=False)
    return running(df, keys, order, slot, [value])


def rank_in_key(
    df: DataFrame, keys: list[str], order: list[str], slot: Column, name: str = "rank"
) -> DataFrame:
    """Append the 1-based position in ``order`` within ``keys``."""
    return running(df, keys, order, slot, [Running(name, F.lit(1).cast("bigint"), "sum")])
