"""Files written from the tables into the shared folder and read back through the readers;
hashes that follow a delta; rules over groups of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.views import (
    SQL_EVENT_POINTS, SQL_OBSERVATIONS, SQL_ODOMETRY, _mod, event_points, observations, odometry, r6, table, with_sql,
)
from trustweave.functions.geometry import resolve_extrinsics
from trustweave.operators import contracts as C, governance as R
from trustweave.operators.joins import merge_delta
from trustweave.sources import clouds, files
from trustweave.sources.stage import stage_root


def _new(spark, name):
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def odometry_files(spark, d):
    """Every user's series written as a CSV file and read again."""
    path = _new(spark, "odometry")
    series = odometry(spark, d)
    value = {
        "%time": F.col("time_ns"), "field.header.stamp": F.col("time_ns"),
        **{f"field.pose.pose.position.{a}": F.col(f"position_m.{a}") for a in "xyz"},
        **{f"field.pose.pose.orientation.{a}": F.col(f"quaternion_xyzw.{a}") for a in "xyzw"},
        **{f"field.twist.twist.linear.{a}": F.col(f"body_velocity_mps.{a}") for a in "xyz"},
    }
    line = F.to_csv(F.struct(*[value[f].alias(f) for f in files.ODOMETRY_FIELDS]))
    rows = series.select(F.format_string("odometry_%s.csv", "agent_id").alias("file"), "time_ns", line.alias("line"))
    files.write_text_files(rows, path, "file", "line", ["time_ns"], header=",".join(files.ODOMETRY_FIELDS))
    back = files.read_odometry(spark, path)
    return back.select(
        "agent_id", "time_ns", (F.col("header_time_ns") - F.col("time_ns")).alias("off"),
        r6("position_m.x").alias("px"), r6("position_m.y").alias("py"), r6("quaternion_xyzw.w").alias("qw"),
        (F.round("body_velocity_mps.x", 9) + F.lit(0.0)).alias("vx"), (F.round("body_velocity_mps.y", 9) + F.lit(0.0)).alias("vy"),
    )


SQL_ODOMETRY_FILES = with_sql(SQL_ODOMETRY, """
SELECT agent_id, time_ns, 0::BIGINT AS off, round(px,6)+0.0 AS px, round(py,6)+0.0 AS py, round(cos(yaw/2),6)+0.0 AS qw, round(vx,9)+0.0 AS vx, round(vy,9)+0.0 AS vy FROM odometry""")


def fixture_rows(spark, d):
    """Nested fixtures of eight frames with eight observations each, one in a line, read as rows."""
    path = _new(spark, "fixture")
    fields = [
        "agent_id", "source_time_ns", "is_ego", "message_present", "kinematic_error_m", "two_sided_count_residual",
        "peer_corroboration_score", "kinematic_applicable", F.col("payload").alias("vector"), "local_confidence",
    ]
    obs = observations(spark, d)
    frames = obs.groupBy("frame").agg(F.min("decision_time_ns").alias("decision_time_ns"), F.collect_list(F.struct(*fields)).alias("observations"))
    runs = frames.groupBy(F.floor(F.col("frame") / 8).alias("run")).agg(F.collect_list(F.struct(
        F.col("frame").alias("sync_frame_id"), "decision_time_ns", F.array(F.lit(0.0), F.lit(1.0)).alias("clean_reference"), "observations",
    )).alias("frames"))
    whole = F.struct(
        F.format_string("run-%d", "run").alias("fixture_run_id"), F.lit("src").alias("source_id"), F.lit("seq").alias("sequence_id"),
        F.lit("ses").alias("session_id"), F.lit("0").alias("ego_agent_id"), F.lit(1_000).alias("max_source_age_ns"), "frames",
    )
    runs.select(F.to_json(whole).alias("value")).write.text(path)
    rows = files.read_fixture(spark, path, one_per_line=True)
    return rows.select(
        "fixture_run_id", "sync_frame_id", "decision_time_ns", "agent_id", "source_time_ns", "is_ego", "message_present",
        r6("kinematic_error_m").alias("kin"), r6("two_sided_count_residual").alias("residual"), r6("peer_corroboration_score").alias("peer"),
        "kinematic_applicable", F.size("clean_reference").alias("reference_width"),
    )


SQL_FIXTURE_ROWS = with_sql(SQL_OBSERVATIONS, """
SELECT 'run-'||(frame//8) AS fixture_run_id, frame AS sync_frame_id, min(decision_time_ns) OVER (PARTITION BY frame) AS decision_time_ns, agent_id, source_time_ns,
 is_ego, message_present, round(kin,6)+0.0 AS kin, round(residual,6)+0.0 AS residual, round(peer,6)+0.0 AS peer, applicable AS kinematic_applicable, 2::INTEGER AS reference_width FROM observations""")

STATUSES = ("verified", "declared", "unknown")


def registry_rows(spark, d):
    """A registry file for each nation's suppliers; transforms of every status are resolved."""
    path = _new(spark, "registry")
    k = F.col("s_suppkey")
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), _mod(k, 3).cast("int"))
    line = lambda *v: F.array(*[F.lit(float(x)) if not hasattr(x, "cast") else x.cast("double") for x in v])
    matrix = F.array(line(1, 0, 0, k), line(0, 1, 0, 2), line(0, 0, 1, 3), line(0, 0, 0, 1))
    agent = F.struct(
        k.cast("string").alias("agent_id"), F.when(_mod(k, 2) == 0, "vehicle").otherwise("infrastructure").alias("agent_type"), F.lit("lidar").alias("sensor_type"),
        F.struct(F.lit("raw").alias("from_frame"), F.lit("common").alias("to_frame"), F.when(_mod(k, 3) < 2, matrix).alias("matrix_4x4"), status.alias("status")).alias("extrinsics"),
        F.array(F.lit("x"), F.lit("y")).alias("expected_point_fields"),
    )
    nations = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(agent).alias("agents"))
    nations.select("s_nationkey", F.to_json(F.struct("agents")).alias("value")).write.partitionBy("s_nationkey").text(path)
    rows = files.read_registry(spark, path)
    matrix, quality = resolve_extrinsics(F.col("extrinsics"))
    return rows.select(
        "agent_id", "agent_type", F.col("extrinsics.status").alias("status"), quality.alias("quality"), matrix[0][3].alias("x_offset"),
        F.size("expected_point_fields").alias("fields"), F.col("odometry").alias("odometry"),
    )


SQL_REGISTRY_ROWS = """SELECT s_suppkey::VARCHAR AS agent_id, CASE WHEN s_suppkey%2=0 THEN 'vehicle' ELSE 'infrastructure' END AS agent_type,
 (['verified','declared','unknown'])[s_suppkey%3+1] AS status, CASE WHEN s_suppkey%3=0 THEN 'verified' ELSE 'unresolved_transform' END AS quality,
 CASE WHEN s_suppkey%3=0 THEN s_suppkey::DOUBLE END AS x_offset, 2::INTEGER AS fields, NULL::VARCHAR AS odometry FROM supplier"""


def inventory_files(spark, d):
    """Size and digest of a file for each user, as the readers find them."""
    path = _new(spark, "files")
    rows = table(spark, d, "events").select(
        F.format_string("user_id=%d.txt", "user_id").alias("file"), "event_id", F.col("event_id").cast("string").alias("value")
    )
    files.write_text_files(rows, path, "file", "value", ["event_id"])
    return files.file_inventory(spark, path, "user_id=*").select(
        F.regexp_extract("path", r"user_id=(-?[0-9]+)\.txt$", 1).try_cast("bigint").alias("user_id"), "bytes", "sha256"
    )


SQL_INVENTORY_FILES = """SELECT user_id, strlen(s)::BIGINT AS bytes, sha256(s) AS sha256 FROM (
 SELECT user_id::BIGINT AS user_id, string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id)||chr(10) AS s FROM events GROUP BY user_id)"""

CLOUD_FIELDS = ["x", "y", "z", "intensity"]


def binary_clouds(spark, d):
    """A binary cloud for each user, read in ranges of a few records: most files take several."""
    path = _new(spark, "clouds")
    points = event_points(spark, d).withColumn("file", F.format_string("c_%d.pcd", "frame"))
    clouds.write_binary_clouds(points, path, "file", CLOUD_FIELDS, ["event_id"])
    back = clouds.read_binary_clouds(spark, path, CLOUD_FIELDS, records=40)
    return back.select(F.regexp_extract("path", r"c_(-?[0-9]+)\.pcd$", 1).cast("bigint").alias("frame"), "point_index", *[r6(c).alias(c) for c in CLOUD_FIELDS])


SQL_BINARY_CLOUDS = with_sql(SQL_EVENT_POINTS, """
SELECT frame::BIGINT AS frame, row_number() OVER (PARTITION BY frame ORDER BY event_id)-1 AS point_index, round(x::FLOAT::DOUBLE,6)+0.0 AS x, round(y::FLOAT::DOUBLE,6)+0.0 AS y,
 round(z::FLOAT::DOUBLE,6)+0.0 AS z, round(intensity::FLOAT::DOUBLE,6)+0.0 AS intensity FROM event_points""")


# -- hashes that follow a delta --------------------------------------------------

SUMMED = ["event_id", "event_type", "user_id"]


def merged_hash(spark, d):
    """The hash of a table after a delta, from the base's sums and the delta alone, and from
    the merged table itself."""
    base = table(spark, d, "events").select(*SUMMED)
    delta = base.filter(_mod("event_id", 10) == 3).withColumn("event_type", F.concat(F.lit("new-"), "event_type"))
    added, removed = R.delta_sums(base, delta, ["event_id"], SUMMED)
    merged = R.sum_digest(R.merge_sums(R.table_sum(base, SUMMED), added, removed))
    whole = R.sum_digest(R.table_sum(merge_delta(base, delta, ["event_id"], verify=False), SUMMED))
    return merged.withColumn("source", F.lit("sums")).unionByName(whole.withColumn("source", F.lit("rows")))


_SUM_TEXT = "||':'||".join(f"sum(('0x'||substr(h,{8 * i + 1},8))::BIGINT)::VARCHAR" for i in range(R.SUM_WORDS))
SQL_MERGED_HASH = f"""WITH m AS (SELECT event_id, CASE WHEN event_id%10=3 THEN 'new-'||event_type ELSE event_type END AS event_type, user_id FROM events),
h AS (SELECT sha256('{{"event_id":'||event_id||',"event_type":"'||event_type||'","user_id":'||user_id||'}}'||chr(10)) AS h FROM m),
s AS (SELECT count(*) AS rows, sha256(count(*)::VARCHAR||':'||{_SUM_TEXT}) AS table_digest FROM h)
SELECT rows, table_digest, unnest(['sums','rows']) AS source FROM s"""


def observation_groups(spark, d):
    """Frames with more than one ego, and senders that a frame holds twice."""
    obs = observations(spark, d).withColumn("is_ego", F.col("is_ego") | (_mod("event_id", 64) == 5))
    return C.observation_group_problems(obs, ["frame"])


SQL_OBSERVATION_GROUPS = with_sql(SQL_OBSERVATIONS, """
SELECT frame, 'one_ego_per_frame' AS rule FROM observations GROUP BY frame HAVING count(*) FILTER (WHERE is_ego OR event_id%64=5) > 1
UNION ALL SELECT frame, 'unique_agents' FROM observations GROUP BY frame, agent_id HAVING count(*) > 1""")

QUERIES = {
    "odometry_files": (odometry_files, SQL_ODOMETRY_FILES),
    "fixture_rows": (fixture_rows, SQL_FIXTURE_ROWS),
    "registry_rows": (registry_rows, SQL_REGISTRY_ROWS),
    "inventory_files": (inventory_files, SQL_INVENTORY_FILES),
    "binary_clouds": (binary_clouds, SQL_BINARY_CLOUDS),
    "merged_hash": (merged_hash, SQL_MERGED_HASH),
    "observation_groups": (observation_groups, SQL_OBSERVATION_GROUPS),
}
