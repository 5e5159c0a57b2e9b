"""Contracts, checked joins, provenance, files and published tables."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from trustweave import schemas as S
from trustweave.operators import contracts as C
from trustweave.operators import governance as R
from trustweave.operators.joins import ContractError, checked_join, delta_problems, merge_delta
from trustweave.sources import files
from trustweave.sources.tables import StoreError, publish, read_verified, write_delta, write_report


def _broken(df, keys, rules):
    return {r["rule"] for r in C.violations(df, keys, rules).collect()}


def test_frame_rules(spark):
    base = dict(
        experiment_id="e", variant_id="v", sequence_id="s", session_id="t", sync_frame_id=0,
        decision_time_ns=100, source_time_ns=90, agent_id="a", agent_type="vehicle", object_key=None,
        member=True, message_present=True, source_matched=True, evidence_available=True,
        reason_code="matched", match_policy=S.CAUSAL, match_age_ns=10, lookahead_buffer_ns=0,
        pose_source_time_ns=90, pose_age_ns=10, oracle_gt=True)
    make = lambda **change: spark.createDataFrame([{**base, **change}], S.FRAMES)
    assert _broken(make(), ["agent_id"], C.frame_rules()) == set()
    assert _broken(make(match_age_ns=11), ["agent_id"], C.frame_rules()) == {"age_is_decision_minus_source"}
    assert "source_and_age_together" in _broken(make(match_age_ns=None), ["agent_id"], C.frame_rules())
    assert "causal_is_not_in_the_future" in _broken(make(source_time_ns=110, match_age_ns=-10), ["agent_id"], C.frame_rules())
    assert "matched_reason" in _broken(make(reason_code="late"), ["agent_id"], C.frame_rules())
    assert "evidence_needs_full_match" in _broken(make(reason_code="empty_scene"), ["agent_id"], C.frame_rules())
    assert "pose_age_is_decision_minus_pose" in _broken(make(pose_age_ns=9), ["agent_id"], C.frame_rules())
    assert C.validate_table(make(), "frame").count() == 0
    doubled = make().unionByName(make())
    assert {r["rule"] for r in C.validate_table(doubled, "frame").collect()} == {"unique_key"}
    assert {r["rule"] for r in C.validate_table(make(object_key="1"), "frame").collect()} == {"frame_has_no_object"}
    with pytest.raises(ContractError):
        C.validate_table(make().drop("agent_type"), "frame")
    with pytest.raises(ContractError):
        C.validate_table(make().withColumn("source_time_ns", F.col("source_time_ns").cast("double")), "frame")
    with pytest.raises(ContractError):
        C.require(make(match_age_ns=11), ["agent_id"], C.frame_rules())


def test_other_row_rules(spark):
    p = spark.createDataFrame(
        [("ok", 0.25, 0.75, None, False, False, "uncalibrated", None, "uncalibrated_attack_risk_score"),
         ("rel", 0.25, 0.5, None, False, False, "uncalibrated", None, "uncalibrated_attack_risk_score"),
         ("abst", None, None, None, False, False, "uncalibrated", None, "uncalibrated_attack_risk_score"),
         ("cal", 0.25, 0.75, None, False, False, "calibrated", 0.5, "calibrated_attack_probability")],
        "id string, risk_score double, operational_reliability double, predictive_uncertainty double, "
        "uncertainty_available boolean, abstained boolean, calibration_status string, calibrated_p_attack double, risk_semantics string")
    got = {(r["id"], r["rule"]) for r in C.violations(p, ["id"], C.prediction_rules()).collect()}
    assert got == {("rel", "reliability_is_one_minus_risk"), ("abst", "abstained_without_risk"), ("cal", "probability_equals_risk")}
    s = spark.createDataFrame(
        [("velocity_spike", "kinematic", "kinematic", [1, 2], (1.0, 0.0, 0.0), 2, None, 7, "a/b.csv"),
         ("velocity_spike", "kinematic", "kinematic", [2, 1], (1.0, 0.0, 0.0), 3, None, -1, "/a")],
        "kind string, family string, expected_modality string, interval_sample_times_ns array<bigint>, "
        "delta_v_mps struct<x:double,y:double,z:double>, duration_samples int, object_key string, seed int, raw_relative_path string"
    ).withColumns({
        "box": F.lit(None).cast("struct<center_x_m:double,center_y_m:double,center_z_m:double,size_x_m:double,size_y_m:double,size_z_m:double,yaw_rad:double>"),
        "n_add": F.lit(None).cast("int"), "removal_fraction": F.lit(None).cast("double"), "boundary_tolerance_m": F.lit(1e-6)})
    assert {r["rule"] for r in C.violations(s, ["seed"], C.overlay_spec_rules()).collect() if r["seed"] == 7} == set()
    assert {r["rule"] for r in C.violations(s, ["seed"], C.overlay_spec_rules()).collect()} == {
        "motion_lists_every_sample", "sample_times_sorted_unique", "seed_nonnegative", "path_safe"}
    ego = spark.createDataFrame([(0, "a", True), (0, "b", True), (1, "c", True), (1, "c", False)],
                                "frame int, agent_id string, is_ego boolean")
    assert {(r["frame"], r["rule"]) for r in C.observation_group_problems(ego, ["frame"]).collect()} == {
        (0, "one_ego_per_frame"), (1, "unique_agents")}


def test_checked_join(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    out = checked_join(left, right, ["k"], "many_to_one", "left", {"v": "w"})
    assert {tuple(r) for r in out.collect()} == {(1, "a", "x"), (1, "b", "x"), (2, "c", None)}
    for args in (("one_to_one", "left", {"v": "w"}), ("many_to_one", "left", {}), ("many_to_one", "left", {"v": "v"}),
                 ("many_to_one", "cross", {"v": "w"}), ("some_to_some", "left", {"v": "w"})):
        with pytest.raises(ContractError):
            checked_join(left, right, ["k"], *args)
    with pytest.raises(ContractError):
        checked_join(left, right, ["absent"], "many_to_one")
    nulls = spark.createDataFrame([(None, "n")], "k int, w string")
    both = checked_join(left.limit(0).unionByName(spark.createDataFrame([(None, "l")], "k int, v string")),
                        nulls, ["k"], "one_to_one", nullable_keys=True)
    assert both.first()["w"] == "n"


def test_delta_merge_is_null_safe(spark):
    schema = "f int, o string, n string, value double, reason string"
    base = spark.createDataFrame([(1, None, "a", 1.0, "m"), (1, "0", "a", 2.0, "m")], schema)
    delta = spark.createDataFrame([(1, None, "a", None, "incomplete_evidence")], schema)
    keys = ["f", "o", "n"]
    got = {(r["o"], r["value"], r["reason"]) for r in merge_delta(base, delta, keys).collect()}
    assert got == {(None, None, "incomplete_evidence"), ("0", 2.0, "m")}
    unknown = spark.createDataFrame([(9, None, "a", 0.0, "m")], schema)
    with pytest.raises(ContractError):
        merge_delta(base, unknown, keys)
    assert {r["problem"] for r in delta_problems(base, delta.unionByName(delta), keys).collect()} == {"duplicate_delta"}


def test_leakage_and_roles(spark):
    row = lambda seq, episode, role: (seq, "t", episode, "b-" + seq, "c-" + seq, "v", role, "a", None)
    lineage = spark.createDataFrame(
        [row("s1", "e1", "training"), row("s2", "e1", "calibration"), row("s3", "e3", "training")], S.LINEAGE)
    assert [(r["kind"], r["group_key"]) for r in R.leakage(lineage).collect()] == [("source_episode", "e1")]
    splits = spark.createDataFrame(
        [("x1", "s1", "training", True, True), ("x2", "s2", "training", True, True)], S.SPLITS)
    got = {(r["sequence_id"], r["problem"]) for r in R.role_conflicts(lineage, splits).collect()}
    assert got == {("s2", "role_conflict"), ("s3", "unassigned")}
    requests = spark.createDataFrame([("s1", "supervised_fit"), ("s1", "calibration")], "sequence_id string, action string")
    assert [r["action"] for r in R.forbidden_actions(requests, splits, R.allowed_actions(spark)).collect()] == ["calibration"]
    assert {r["rule"] for r in R.split_problems(splits).collect()} == {"sole_development_source"}


def test_table_hash_ignores_order_and_layout(spark):
    rows = [(i % 50, float(i % 7), None if i % 3 else "x") for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, c string")
    again = spark.createDataFrame(rows[::-1], df.schema).repartition(7)
    one, two = (R.table_hash(x).first()[0] for x in (df, again))
    assert one == two != R.table_hash(df.limit(299)).first()[0]
    empty = R.table_hash(df.limit(0)).first()[0]
    assert empty == hashlib.sha256(b"").hexdigest()


HEADER = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity ring\nSIZE 4 4 4 4 2\nTYPE F F F F U\nCOUNT 1 1 1 1 1\nWIDTH 3\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 3\nDATA {}\n"


def test_files(spark, tmp_path):
    clouds = tmp_path / "clouds"
    clouds.mkdir()
    text = HEADER.format("ascii") + "1 2 3 3500 7\n-1 0.5 0 7000 8\n0 0 0 0 9\n"
    (clouds / "003_000000_1712121167.80167605.pcd").write_text(text)
    rows = [(1.0, 2.0, 3.0, 10.0, 70), (4.0, 5.0, 6.0, 20.0, 80), (7.0, 8.0, 9.0, 30.0, 90)]
    (clouds / "top_000000_1712121167.5.pcd").write_bytes(
        HEADER.format("binary").encode() + b"".join(struct.pack("<ffffH", *r) for r in rows))
    index = files.index_clouds(files.list_files(spark, str(clouds), "*.pcd"))
    got = {r["agent_id"]: (r["sync_frame_id"], r["source_time_ns"]) for r in index.collect()}
    assert got == {"003": (0, 1712121167080167605), "top": (0, 1712121167000000005)}
    decimal = files.index_clouds(files.list_files(spark, str(clouds), "*.pcd"), files.DECIMAL_DIGITS)
    assert decimal.filter("agent_id = 'top'").first()["source_time_ns"] == 1712121167500000000
    points = files.read_clouds(spark, str(clouds), ["x", "y", "z", "intensity", "ring"])
    assert points.count() == 6
    top = points.filter(F.col("path").contains("top_")).orderBy("point_index").collect()
    assert [(r["x"], r["ring"]) for r in top] == [(1.0, 70.0), (4.0, 80.0), (7.0, 90.0)]
    native = files.parse_ascii_clouds(
        files.read_texts(spark, str(clouds), "003*"), ["x", "ring"]).orderBy("point_index").collect()
    assert [(r["x"], r["ring"], r["parsed_points"]) for r in native] == [(1.0, 7.0, 3), (-1.0, 8.0, 3), (0.0, 9.0, 3)]
    meta = files.cloud_metadata(files.read_texts(spark, str(clouds), "003*")).first()
    assert meta["problem"] is None and meta["points"] == 3

    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "frame_1.txt").write_text("1 0 0 0 2 2 2 0.5\n\n 2  1 1 1 1 1 1 0 \n")
    (labels / "frame_2.txt").write_text("")
    texts = files.index_labels(files.read_texts(spark, str(labels), "*.txt"))
    parsed = files.parse_labels(texts.drop("problem")).orderBy("local_index").collect()
    assert [(r["sync_frame_id"], r["local_index"], r["class_id"], r["yaw_rad"]) for r in parsed] == [(0, 0, 1, 0.5), (0, 1, 2, 0.0)]
    assert _broken(spark.createDataFrame([(4, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0)],
                   "class_id int, center_x_m double, center_y_m double, center_z_m double, size_x_m double, size_y_m double, size_z_m double, yaw_rad double"),
                   ["class_id"], C.label_rules()) == {"class_id_known", "size_positive"}

    odo = tmp_path / "odo"
    odo.mkdir()
    head = ",".join(files.ODOMETRY_FIELDS)
    (odo / "odometry_003.csv").write_text(
        head + "\n1700000000000000001,1700000000000000001,10,20,0,0,0,0,1,2,0,0\n"
        "1700000000100000001,1700000000100000002,10.2,20,0,0,0,0,1,2,0,0\n")
    series = files.read_odometry(spark, str(odo)).orderBy("time_ns").collect()
    assert series[0]["agent_id"] == "003" and series[0]["time_ns"] == 1700000000000000001
    assert series[1]["position_m"]["x"] == 10.2
    assert _broken(files.read_odometry(spark, str(odo)), ["agent_id"], C.odometry_rules()) == {"header_time_agrees"}
    (odo / "odometry_004.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_odometry(spark, str(odo / "odometry_004.csv"))


def test_registry_file(spark, tmp_path):
    path = tmp_path / "split.json"
    path.write_text('{"assignments": [{"source_id": "x", "sequence_id": "s", "role": "training", "resolved": true, "frozen": true}]}')
    row = files.read_registry(spark, str(path), S.SPLITS, "assignments").first()
    assert (row["source_id"], row["frozen"]) == ("x", True)


def test_publish_verify_resume(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("sequence_id"))
    path = str(tmp_path / "table")
    out = publish(df, path, "f1", partition_by=["sequence_id"], sort_by=["id"])
    assert out.count() == 100
    assert publish(df, path, "f1").count() == 100  # resumed
    with pytest.raises(StoreError):
        publish(df, path, "f2")
    victim = next((tmp_path / "table" / "data").rglob("*.parquet"))
    victim.unlink()
    with pytest.raises(StoreError):
        read_verified(spark, path, "f1")
    partial = str(tmp_path / "partial")
    df.write.parquet(partial + "/data")
    with pytest.raises(StoreError):
        publish(df, partial, "f1")
    assert write_delta(df.withColumnRenamed("sequence_id", "variant_id"), str(tmp_path / "delta")) == 100
    write_report(df, str(tmp_path / "report"), ["id"])
    assert spark.read.json(str(tmp_path / "report")).count() == 100
    inv = files.file_inventory(spark, str(tmp_path / "report"), "*.json")
    assert R.verify_inventory(inv, inv).count() == 0 and R.manifest_problems(inv).filter("rule <> 'path_safe'").count() == 0


def test_binary_clouds_are_read_in_ranges(spark, tmp_path):
    import numpy as np

    from trustweave.sources import clouds

    kind = np.dtype([("x", "<f4"), ("n", "<f4", (3,)), ("ring", "<u2"), ("t", "<f8")])
    rng = np.random.default_rng(2)
    want = {}
    for k, n in enumerate((0, 1, 7, 2500)):
        data = np.zeros(n, kind)
        data["x"], data["ring"], data["t"] = rng.random(n), rng.integers(0, 60_000, n), rng.random(n)
        head = f"# c\nVERSION 0.7\nFIELDS x n ring t\nSIZE 4 4 2 8\nTYPE F F U F\nCOUNT 1 3 1 1\nPOINTS {n}\nDATA binary\n"
        (tmp_path / f"c{k}.pcd").write_bytes(head.encode() + data.tobytes())
        want |= {(f"c{k}.pcd", i): (float(r["x"]), float(r["ring"]), float(r["t"])) for i, r in enumerate(data)}
    ranges = clouds.cloud_ranges(spark, str(tmp_path), records=100).collect()
    assert len(ranges) == 1 + 1 + 25 and all(r.n <= 100 for r in ranges)
    got = {(r.path.rsplit("/", 1)[1], r.point_index): (r.x, r.ring, r.t) for r in clouds.read_binary_clouds(spark, str(tmp_path), ["x", "ring", "t"], records=100).collect()}
    assert got == want
    whole = {(r.path.rsplit("/", 1)[1], r.point_index): (r.x, r.ring, r.t) for r in files.read_clouds(spark, str(tmp_path), ["x", "ring", "t"]).collect()}
    assert got == whole
    (tmp_path / "short.pcd").write_bytes(head.encode() + b"1234")
    with pytest.raises(Exception, match="declares"):
        clouds.cloud_ranges(spark, str(tmp_path)).collect()


def test_table_sums_follow_deltas(spark):
    from trustweave.operators import governance as R

    rows = [(k, "a" * (k % 5), k % 3 == 0) for k in range(200)] + [(7, "a" * 2, False)]
    base = spark.createDataFrame(rows, "id long, text string, flag boolean")
    delta = spark.createDataFrame([(k, "new", None) for k in range(0, 200, 9)] + [(900, "x", True)], base.schema)
    columns = base.columns
    digest = lambda df: R.sum_digest(R.table_sum(df, columns)).first()
    merged = base.join(delta.select("id"), "id", "left_anti").unionByName(delta)
    got = R.sum_digest(R.merge_sums(R.table_sum(base, columns), *R.delta_sums(base, delta, ["id"], columns))).first()
    assert got == digest(merged) and got.rows == merged.count()
    assert digest(base) == digest(base.repartition(7)) != digest(base.dropDuplicates())  # rows count as often as they occur
    assert digest(base.limit(0)).rows == 0


def test_registries_in_either_format(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"agents": [{"agent_id": "1", "odometry": "o"}, {"agent_id": "2"}], "more": 1}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text('{"agents": []}')
    assert sorted((r.agent_id, r.odometry) for r in files.read_registry(spark, str(tmp_path)).collect()) == [("1", "o"), ("2", None)]
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        files.read_registry(spark, str(tmp_path)).collect()


def test_cloud_index_of_large_ids_equals_its_sql(spark, tmp_path):
    """From id 126,279 on the fraction has ten digits, which no nanosecond time has."""
    import datetime

    import duckdb

    from catalog import registry

    rows = [(i, datetime.datetime(2024, 1, 1), 7, "view", 1.0, "") for i in (0, 40, 101, 126278, 126279, 600001)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    run, sql = registry.ALL["cloud_index"]
    df = run(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql}) ORDER BY event_id").fetchall()
    got = sorted(tuple(r) for r in df.collect())
    assert got == want and [r[-1] for r in got][3:] == [None, "invalid_cloud_name", "invalid_cloud_name"]


def test_files_of_a_query_are_written_in_place(spark, tmp_path, monkeypatch):
    """A file for each sender and nothing else: no folder, rename or part for each of them."""
    from catalog import file_queries

    events = [(k, k % 7, 0.5 * k, "2024-01-01 00:00:00") for k in range(200)]
    df = spark.createDataFrame(events, "event_id bigint, user_id bigint, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in" / "events.parquet"))
    monkeypatch.setattr(file_queries, "_new", lambda spark, name: f"{tmp_path}/{name}")
    got = {r["user_id"]: (r["bytes"], r["sha256"]) for r in file_queries.inventory_files(spark, str(tmp_path / "in")).collect()}
    texts = {u: "".join(f"{k}\n" for k in range(200) if k % 7 == u).encode() for u in range(7)}
    assert got == {u: (len(t), hashlib.sha256(t).hexdigest()) for u, t in texts.items()}
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == [f"user_id={u}.txt" for u in range(7)]
    rows = file_queries.odometry_files(spark, str(tmp_path / "in")).collect()
    assert sorted((r["agent_id"], r["px"]) for r in rows) == sorted((str(k % 7), 0.5 * k) for k in range(200))
    assert sorted(p.name for p in (tmp_path / "odometry").iterdir()) == [f"odometry_{u}.csv" for u in range(7)]
