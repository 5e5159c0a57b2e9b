"""Published tables, deltas, reports and recorded attempts, written to the shared folder and
read back; small column and set operators that other queries don't reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.overlay_queries import SQL_ADD, SQL_ATTEMPT_COVERAGE, _attempts, add_points
from catalog.views import SQL_EVENT_BOXES, SQL_EVENT_POINTS, _mod, event_boxes, event_points, r6, table, with_sql
from trustweave.functions.geometry import box_volume, center_range
from trustweave.operators.joins import frame_range
from trustweave.operators.metrics import coverage
from trustweave.operators.overlays import with_added_points
from trustweave.sources.stage import stage_root
from trustweave.sources.tables import publish, read_attempts, write_delta, write_report


def _new(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def published_table(spark, d):
    """A table published once, resumed for the same request after verification."""
    path = _new(spark, "table")
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    publish(events, path, "request-1", partition_by=["event_type"], sort_by=["event_id"])
    again = publish(events.limit(0), path, "request-1")  # resumed: what is there, not what is asked
    return again.select("event_id", "event_type", "user_id", r6("value").alias("value"))


SQL_PUBLISHED = "SELECT event_id, event_type, user_id, round(value,6)+0.0 AS value FROM events"


def published_delta(spark, d):
    """Deltas of many variants, a folder each."""
    path = _new(spark, "delta")
    write_delta(table(spark, d, "events").select(
        F.concat(F.lit("v"), _mod("user_id", 9).cast("string")).alias("variant_id"), "event_id", r6("value").alias("value")), path)
    return spark.read.parquet(path).groupBy("variant_id").agg(F.count("*").alias("rows"), F.max("event_id").alias("last_event"))


SQL_PUBLISHED_DELTA = "SELECT 'v'||(user_id%9) AS variant_id, count(*) AS rows, max(event_id) AS last_event FROM events GROUP BY 1"


def report_rows(spark, d):
    """A JSON report, written in a stable order; its rows carry their place in it."""
    path = _new(spark, "report")
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("rows"), r6(F.sum("value")).alias("total"))
    write_report(rows, path, ["event_type"])
    # a file name, and a row's place in its file, tell the written order
    read = spark.read.schema("event_type string, rows bigint, total double").json(path)
    first = read.select("*", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("at"))
    return first.select("event_type", "rows", F.round("total", 3).alias("total"), F.expr("CAST(row_number() OVER (ORDER BY at) AS BIGINT)").alias("position"))


SQL_REPORT = "SELECT event_type, count(*) AS rows, round(sum(value),3) AS total, row_number() OVER (ORDER BY event_type) AS position FROM events GROUP BY event_type"


def recorded_coverage(spark, d):
    """Coverage of attempts that were recorded in a published table and read back."""
    path = _new(spark, "attempts")
    publish(_attempts(spark, d), path, "attempts-1")
    return coverage(read_attempts(spark, path, "attempts-1"))


def cloud_with_added(spark, d):
    """Clouds united with added points, counted per frame."""
    both = with_added_points(event_points(spark, d), add_points(spark, d))
    return both.groupBy("frame", "added").agg(F.count("*").alias("points"), r6(F.sum("x")).alias("sum_x"))


SQL_CLOUD_WITH_ADDED = f"""WITH a AS ({SQL_ADD}), {SQL_EVENT_POINTS}
SELECT frame, false AS added, count(*) AS points, round(sum(x),6)+0.0 AS sum_x FROM event_points GROUP BY frame
UNION ALL SELECT frame, true, count(*), round(sum(x),6)+0.0 FROM a GROUP BY frame"""


def box_geometry(spark, d):
    """Volume and distance of every box."""
    c = F.col
    return event_boxes(spark, d).select(
        "frame", r6(box_volume(c("size_x_m"), c("size_y_m"), c("size_z_m"))).alias("volume_m3"),
        r6(center_range(c("center_x_m"), c("center_y_m"), c("center_z_m"))).alias("range_m"),
    )


SQL_BOX_GEOMETRY = with_sql(SQL_EVENT_BOXES, "SELECT frame, round(sx*sy*sz,6)+0.0 AS volume_m3, round(sqrt(cx*cx+cy*cy+cz*cz),6)+0.0 AS range_m FROM event_boxes")


def frame_selection(spark, d):
    """Half-open frame ranges, each row of the events as a frame."""
    frames = table(spark, d, "events").select(F.col("user_id").alias("sync_frame_id"), "event_id")
    return frame_range(frames, 10, 60)


SQL_FRAME_SELECTION = "SELECT user_id AS sync_frame_id, event_id FROM events WHERE user_id >= 10 AND user_id < 60"

QUERIES = {
    "published_table": (published_table, SQL_PUBLISHED),
    "published_delta": (published_delta, SQL_PUBLISHED_DELTA),
    "report_rows": (report_rows, SQL_REPORT),
    "recorded_coverage": (recorded_coverage, SQL_ATTEMPT_COVERAGE),
    "cloud_with_added": (cloud_with_added, SQL_CLOUD_WITH_ADDED),
    "box_geometry": (box_geometry, SQL_BOX_GEOMETRY),
    "frame_selection": (frame_selection, SQL_FRAME_SELECTION),
}
