"""Plans whose tasks must not grow with the tables."""

import pathlib

import pytest
from pyspark.sql import functions as F

from catalog import message_queries, overlay_queries, views
from trustweave.plans import whatif
from trustweave.sources.stage import stage_root


def events(spark, path, users=60, each=4):
    rows = spark.range(users * each).select(
        F.col("id").alias("event_id"), (F.col("id") % users).alias("user_id"),
        F.timestamp_micros(F.lit(views.BASE_NS // 1000) + F.col("id") * 7_000_000_000).alias("ts"),
        F.element_at(F.array(*[F.lit(t) for t in views.TYPES]), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 90).cast("double").alias("value"),
    )
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_memberships_unfold_in_parts_of_bounded_rows(spark, tmp_path, monkeypatch):
    """user ids are few bytes, but each unfolds to 180 rows."""
    d = events(spark, tmp_path)
    monkeypatch.setattr(views, "UNFOLDED_ROWS", 360, raising=False)
    rows = views.memberships(spark, d).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in rows) == 60 * 180
    assert len(rows) >= 15


def test_event_boxes_lie_in_parts_by_the_rows_they_unfold_to(spark, tmp_path, monkeypatch):
    """a box is a few bytes, but is listed for its senders and cells."""
    d = events(spark, tmp_path)
    monkeypatch.setattr(views, "UNFOLDED_ROWS", 360, raising=False)
    rows = views.event_boxes(spark, d).groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in rows) == 60
    assert len(rows) >= 8


def test_series_dependencies_are_counted_before_names_unfold(spark, tmp_path):
    """six names a key make no six rows a key in the shuffle and its hash tables."""
    out = overlay_queries.series_dependencies(spark, events(spark, tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")
    rows = out.collect()
    # a target's spike reaches the interval that ends at its sample and the next one
    assert len(rows) == len({(r["variant_id"], r["evidence_name"]) for r in rows}) == 2 * 60 * 3 * 6
    assert {r["keys"] for r in rows} <= {1, 2, 3}


def test_replay_delta_builds_no_packets(spark, tmp_path, monkeypatch):
    """the query returns senders; packets, schedule and reports are not its job."""
    def unused(*args, **kwargs):
        raise AssertionError("the whole episode was run")

    d = events(spark, tmp_path)
    monkeypatch.setattr(whatif, "run_episode", unused)
    assert message_queries.replay_delta(spark, d).count() == 2 * 240


def test_reports_need_no_packet_digests(spark, tmp_path):
    """the payload's text is made once, and a report's packets have no digest of their own."""
    d = events(spark, tmp_path)
    run = message_queries._episode(spark, d, replay=False)
    assert "packet_sha256" not in run.packets.columns
    assert run.packets.filter("payload_sha256 is null or measured_size_bytes < 100").count() == 0
    assert run.metrics.count() == 2 * 30 * 2


def _plan_at_size(spark, df):
    """The plan without broadcasts, as for tables too large for them."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(setting)
    spark.conf.set(setting, -1)
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, old)


@pytest.mark.parametrize("query", ["series_delta", "series_delta_problems"])
def test_series_delta_unfolds_names_after_the_last_shuffle(spark, tmp_path, query):
    """six names for each variant and interval, shuffled to meet base rows, fill the disk."""
    d = events(spark, tmp_path)
    plan = _plan_at_size(spark, lambda: getattr(overlay_queries, query)(spark, d))
    assert plan.index("Generate ") < plan.index("Exchange ")


def test_series_variants_are_shuffled_without_samples(spark, tmp_path):
    """each variant took both samples of its intervals through a shuffle of its own."""
    d = events(spark, tmp_path)
    root = pathlib.Path(stage_root(spark))
    staged = set(root.iterdir())
    plan = _plan_at_size(spark, lambda: overlay_queries.incremental_series(spark, d))
    assert "hashpartitioning(variant_id" not in plan
    assert set(root.iterdir()) == staged
