"""Leave-one-sender-out corroboration and per-frame summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trustweave.operators.quantiles import exact_median, leave_one_out_deviation

MAD_SCALE = 1.4826


def leave_one_out(
    counts: DataFrame,
    keys: list[str],
    *,
    count: str = "point_count",
    eligible: str = "eligible",
    minimum_peers: int = 2,
    scale_floor: float = 0.25,
) -> DataFrame:
    """Compare each sender with the other eligible senders of its (frame, object).

    A sender's own count never enters its peer statistics. Senders of one object
    that report the same count share one answer, so the work is done on a
    histogram of counts per object (built with map-side combine) and joined back by
    shuffle, for it may have nearly as many rows as the counts: no pairs of senders and no collected groups. Taking one sender away
    moves the median to one of three places; the deviations from each are ranked beside
    the counts, in the one partitioning that the histogram has.
    """
    if minimum_peers < 1 or not 0 < scale_floor < float("inf"):
        raise ValueError("minimum_peers and scale_floor must be positive")
    n = F.col(count)
    usable = F.coalesce(F.col(eligible), F.lit(False)) & n.isNotNull()
    hist = counts.groupBy(*keys, n.alias("__n")).agg(
        F.sum(F.when(usable, 1).otherwise(0)).alias("__c")
    ).withColumn("__v", F.log1p(F.col("__n").cast("double")))
    stats = leave_one_out_deviation(hist, keys, "__v", "__c").withColumn(
        "__positive", F.coalesce(F.sum(F.when(F.col("__n") > 0, F.col("__c"))).over(Window.partitionBy(*keys)), F.lit(0))
    )
    answer = stats.select(
        *keys, F.coalesce("__n", F.lit(-1)).alias("__join"), F.col("total").alias("__total"), "__positive",
        "location", "mad",
    )
    own = usable.cast("int")
    rows = counts.withColumn("__join", F.coalesce(n, F.lit(-1))).join(
        answer.hint("merge"), [*keys, "__join"], "left"
    )
    peers = F.col("__total") - own
    positive = F.col("__positive") - F.when(usable & (n > 0), 1).otherwise(0)
    enough = peers >= minimum_peers
    ok = enough & usable
    scale = F.greatest(MAD_SCALE * F.col("mad"), F.lit(scale_floor))
    signed = (F.log1p(n.cast("double")) - F.col("location")) / scale
    pick = lambda c: F.when(ok, c)
    return rows.select(
        *counts.columns,
        ok.alias("peer_available"),
        F.when(ok, "matched").when(enough, "visibility_unknown").otherwise("insufficient_peers")
        .alias("peer_reason"),
        peers.alias("eligible_peer_count"),
        positive.alias("positive_peer_count"),
        pick(F.col("location")).alias("peer_location_log1p"),
        pick(scale).alias("peer_scale_log1p"),
        pick(F.greatest(-signed, F.lit(0.0))).alias("peer_deficit_residual"),
        pick(F.greatest(signed, F.lit(0.0))).alias("peer_surplus_residual"),
        pick(F.abs(signed)).alias("peer_disagreement"),
        pick(positive / peers).alias("peer_corroboration_score"),
    )


def object_suspicion(deficit: Column, surplus: Column) -> Column:
    """Larger residual; unknown unless both are known."""
    return F.when(deficit.isNotNull() & surplus.isNotNull(), F.greatest(deficit, surplus))


def summarize_suspicion(objects: DataFrame, keys: list[str], value: str = "suspicion") -> DataFrame:
    """Count, available, maximum and exact median of object suspicion per frame."""
    v = F.col(value)
    counts = objects.groupBy(*keys).agg(
        F.count("*").alias("object_count"),
        F.count(v).alias("available_object_count"),
        (F.count("*") - F.count(v)).alias("unavailable_object_count"),
        F.max(v).alias("maximum_object_suspicion"),
        (F.count("*") > F.count(v)).alias("any_object_evidence_unavailable"),
    )
    medians = exact_median(objects, keys, value, "median_object_suspicion")
    return counts.join(medians, keys, "left")


def mean_if_complete(objects: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Mean per group, null unless every row has a value."""
    return objects.groupBy(*keys).agg(
        F.when(F.count("*") == F.count(value), F.avg(value)).alias(name)
    )


def point_shares(
    counts: DataFrame, object_keys: list[str], agent: str = "agent_id", count: str = "point_count"
) -> DataFrame:
    """Own share of an object's points; unknown when a count is missing or all are zero."""
    totals = counts.groupBy(*object_keys).agg(
        F.when(F.count("*") == F.count(count), F.sum(count)).alias("__total")
    )
    share = F.when(F.col("__total") > 0, F.col(count) / F.col("__total"))
    return counts.join(totals.hint("merge"), object_keys).select(*counts.columns, share.alias("point_share"))


def frame_shares(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the known shares per frame and agent."""
    return shares.groupBy(*keys).agg(F.avg("point_share").alias("raw_point_share"))


def weakest_peer_score(peers: DataFrame, keys: list[str]) -> DataFrame:
    return peers.groupBy(*keys).agg(
        F.min("peer_corroboration_score").alias("peer_corroboration_score")
    )
