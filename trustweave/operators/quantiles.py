"""Exact medians that never hold a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustweave.operators.ordered import int_div
from trustweave.sources.stage import stage

SKETCH_ACCURACY = 10_000
BAND = 2.0 / SKETCH_ACCURACY
#: Groups (about 100 bytes each) whose brackets may be broadcast to the rows.
BROADCAST_GROUPS = 200_000


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of the non-null values per group, one row per group.

    A mergeable sketch brackets the two middle ranks (its rank error is bounded),
    so only the thin band between the brackets has to be ordered; everything
    outside the band is merely counted. The brackets are written once; where their
    counted number allows, they are broadcast, so that rows stay where they are until
    copies have collapsed. With more groups the rows are joined by shuffle.
    """
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    bounds = data.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.percentile_approx(
            "__v", [0.5 - BAND, 0.5 + BAND], F.lit(SKETCH_ACCURACY)
        ).alias("__b"),
        F.min("__v").alias("__lo"),
        F.max("__v").alias("__hi"),
    ).select(
        *keys, "__n",
        # a small group is bracketed by its extremes: the band is the whole group
        F.when(F.col("__n") < SKETCH_ACCURACY, F.col("__lo")).otherwise(F.col("__b")[0]).alias("__lo"),
        F.when(F.col("__n") < SKETCH_ACCURACY, F.col("__hi")).otherwise(F.col("__b")[1]).alias("__hi"),
    )
    bounds = stage(bounds)
    placed = data.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_GROUPS else bounds, keys)
    counted = (
        placed.withColumn("__in", F.col("__v") >= F.col("__lo"))
        .filter(F.col("__v") <= F.col("__hi"))
        .withColumn("__v", F.when(F.col("__in"), F.col("__v")))
        .groupBy(*keys, "__v")
        .agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    )
    by_value = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = counted.withColumn("__cum", F.sum("__c").over(by_value))
    low_rank, high_rank = int_div(F.col("__n") + 1, 2), int_div(F.col("__n"), 2) + 1
    return ranked.groupBy(*keys).agg(
        ((F.min(F.when(F.col("__cum") >= low_rank, F.col("__v")))
          + F.min(F.when(F.col("__cum") >= high_rank, F.col("__v")))) / 2).alias(name)
    )


def leave_one_out_deviation(hist: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Median and median absolute deviation of a weighted group without one copy of each value.

    ``hist`` has one row per (group, value) with its multiplicity. Appends ``total``,
    ``location`` (the median of the others) and ``mad`` (of their distances from it), null
    where nothing remains or the row has no weight. Removing one copy of ``v`` shifts only the
    ranks at or above its last copy, so three order statistics per group answer every row;
    the location takes one of three values, and for each the distances are ranked once. All
    windows share the partitioning by ``keys``.
    """
    group = Window.partitionBy(*keys)
    n, h, w = F.col("total"), F.col("__h"), F.col(weight)
    odd = F.pmod(n, F.lit(2)) == 1

    def ranked(rows: DataFrame, of: str, k: int) -> DataFrame:
        """Cumulated weights along ``of`` and the three middle values."""
        cum = f"__cum{k}"
        rows = rows.withColumn(cum, F.sum(weight).over(group.orderBy(of).rowsBetween(Window.unboundedPreceding, 0)))
        middle = lambda i: F.min(F.when(F.col(cum) >= h + i, F.col(of))).over(group)
        return rows.withColumns({f"__s{k}{i}": middle(i) for i in range(3)})

    def places(k: int) -> list[Column]:
        """The median of the others for a copy removed above, between and below the middle."""
        s0, s1, s2 = (F.col(f"__s{k}{i}") for i in range(3))
        return [F.when(odd, (s0 + s1) / 2).otherwise(s0), (s0 + s2) / 2, F.when(odd, (s1 + s2) / 2).otherwise(s1)]

    def chosen(k: int, options: list[Column]) -> Column:
        cum = F.col(f"__cum{k}")
        # an even number of values leaves one middle rank, an odd one two
        return F.when(F.when(odd, cum > h + 1).otherwise(cum > h), options[0]).when(odd & (cum == h + 1), options[1]).otherwise(options[2])

    rows = hist.withColumn("total", F.sum(weight).over(group)).withColumn("__h", int_div(n, 2))
    rows = ranked(rows, value, 0)
    for k, place in enumerate(places(0), 1):
        rows = ranked(rows.withColumn(f"__g{k}", F.abs(F.col(value) - place)), f"__g{k}", k)
    known = (n > 1) & (w > 0)
    return rows.select(
        *hist.columns, "total",
        F.when(known, chosen(0, places(0))).alias("location"),
        F.when(known, chosen(0, [chosen(k, places(k)) for k in (1, 2, 3)])).alias("mad"),
    )
