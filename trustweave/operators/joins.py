"""Joins with declared cardinality, key audits and keyed delta merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")


class ContractError(ValueError):
    """A table or a join breaks its declared contract."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def null_safe(left: str, right: str, keys: list[str]) -> Column:
    """Equality of two aliased sides in which null equals null."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
    )


def cardinality_violations(
    left: DataFrame, right: DataFrame, on: list[str], cardinality: str
) -> DataFrame:
    """Duplicate keys on every side that is declared to be unique."""
    if cardinality not in CARDINALITIES:
        raise ContractError(f"unknown cardinality {cardinality!r}")
    one_left, one_right = cardinality.startswith("one_to"), cardinality.endswith("to_one")
    sides = [("left", left, one_left), ("right", right, one_right)]
    parts = [
        duplicate_keys(df, on).select(F.lit(name).alias("side"), *on, "rows")
        for name, df, unique in sides
        if unique
    ]
    if not parts:
        parts = [duplicate_keys(left, on).select(F.lit("left").alias("side"), *on, "rows").limit(0)]
    return reduce(DataFrame.unionByName, parts)


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    cardinality: str,
    how: str = "left",
    right_rename: dict[str, str] | None = None,
    *,
    nullable_keys: bool = False,
    verify: bool = True,
) -> DataFrame:
    """Join after checking the declared cardinality and every overlapping column.

    ``verify=False`` skips the data check (one aggregate per unique side) when the
    caller has already run ``cardinality_violations``.
    """
    if not on:
        raise ContractError("join columns must be declared")
    if how not in ("left", "right", "inner", "outer"):
        raise ContractError(f"unsupported join type {how!r}")
    absent = sorted(c for c in on if c not in left.columns or c not in right.columns)
    if absent:
        raise ContractError(f"join columns absent from an input: {absent}")
    rename = dict(right_rename or {})
    overlap = (set(left.columns) & set(right.columns)) - set(on)
    if overlap != set(rename):
        raise ContractError(
            f"overlapping columns must be renamed: overlap={sorted(overlap)}, "
            f"renamed={sorted(rename)}"
        )
    targets = list(rename.values())
    if len(set(targets)) != len(targets):
        raise ContractError("rename targets must be unique")
    taken = (set(targets) & (set(left.columns) | set(right.columns))) - set(on)
    if taken:
        raise ContractError(f"rename targets collide: {sorted(taken)}")
    if verify:
        bad = cardinality_violations(left, right, on, cardinality).take(3)
        if bad:
            raise ContractError(f"join violates {cardinality}: {bad}")
    prepared = right.withColumnsRenamed(rename)
    if not nullable_keys:
        return left.join(prepared, on, how)
    l, r = left.alias("l"), prepared.alias("r")
    rest = [F.col(f"r.{c}") for c in prepared.columns if c not in on]
    key = [F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in on]
    mine = [F.col(f"l.{c}") for c in left.columns if c not in on]
    return l.join(r, null_safe("l", "r", on), how).select(*key, *mine, *rest)


def absent_keys(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` does not have (null equals null)."""
    wanted = df.select(*keys).distinct()
    return wanted.alias("l").join(
        known.select(*keys).alias("r"), null_safe("l", "r", keys), "left_anti"
    )


def key_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and extra keys between two key sets."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    a = actual.select(*keys).distinct().withColumn("__a", F.lit(True))
    side = F.when(F.col("__a").isNull(), "missing").otherwise("extra")
    return (
        e.join(a, keys, "full_outer")
        .filter(F.col("__e").isNull() | F.col("__a").isNull())
        .select(*keys, side.alias("difference"))
    )


def delta_problems(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate base keys, duplicate delta keys and delta keys the base lacks."""
    dup = lambda df, name: duplicate_keys(df, keys).select(
        *keys, F.lit(name).alias("problem")
    )
    unknown = absent_keys(delta, base, keys).select(*keys, F.lit("unknown_key").alias("problem"))
    return dup(base, "duplicate_base").unionByName(dup(delta, "duplicate_delta")).unionByName(unknown)


def merge_delta(
    base: DataFrame, delta: DataFrame, keys: list[str], *, verify: bool = True
) -> DataFrame:
    """Replace the base rows whose key occurs in ``delta``; keys may hold nulls.

    The whole row is chosen by "the delta has this key", so a delta may set nulls.
    """
    if verify:
        bad = delta_problems(base, delta, keys).take(3)
        if bad:
            raise ContractError(f"delta cannot be merged: {bad}")
    values = [c for c in base.columns if c not in keys]
    d = delta.select(*keys, F.struct(*values).alias("__new"))
    joined = base.alias("b").join(d.alias("d"), null_safe("b", "d", keys), "left")
    hit = F.col("d.__new").isNotNull()
    return joined.select(*[
        F.col(f"b.{c}") if c in keys
        else F.when(hit, F.col(f"d.__new.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
        for c in base.columns
    ])


def frame_range(df: DataFrame, first: int, end: int, column: str = "sync_frame_id") -> DataFrame:
    """Rows of the frames ``first`` up to but without ``end``; the filter reaches the scan."""
    if not 0 <= first < end:
        raise ContractError("a frame range needs 0 <= first < end")
    return df.filter((F.col(column) >= first) & (F.col(column) < end))
