"""Spatial, peer, score, overlay and table operators."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave import schemas as S
from trustweave.functions import geometry as G
from trustweave.functions.scoring import Weights, count_residuals, fixed_diagnostic, missing_aware
from trustweave.operators import overlays as O
from trustweave.operators.evidence import Item, to_long, to_wide
from trustweave.operators.peers import leave_one_out, point_shares, summarize_suspicion
from trustweave.operators.quantiles import exact_median
from trustweave.operators.spatial import LEVELS, box_cells, count_in_boxes, spatial_support

BOX = "center_x_m double, center_y_m double, center_z_m double, size_x_m double, size_y_m double, size_z_m double, yaw_rad double"


def _inside(p, b, tol=1e-6):
    cx, cy, cz, sx, sy, sz, yaw = b
    dx, dy, dz = p[0] - cx, p[1] - cy, p[2] - cz
    lx, ly = math.cos(yaw) * dx + math.sin(yaw) * dy, -math.sin(yaw) * dx + math.cos(yaw) * dy
    return abs(lx) <= sx / 2 + tol and abs(ly) <= sy / 2 + tol and abs(dz) <= sz / 2 + tol


@pytest.mark.parametrize("cell", [0.7, 4.0, 100.0])
def test_points_in_boxes_equals_brute_force(spark, cell):
    random.seed(4)
    points = [(f, random.uniform(-9, 9), random.uniform(-9, 9), random.uniform(-3, 3), i)
              for i in range(900) for f in (0, 1)]
    boxes = [(f, b, *(random.uniform(-6, 6) for _ in range(2)), 0.0, random.uniform(1, 9),
              random.uniform(0.5, 4), 4.0, random.uniform(-7, 7)) for f in (0, 1) for b in range(8)]
    boxes.append((2, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0))
    p = spark.createDataFrame(points, "frame int, x double, y double, z double, id int")
    b = spark.createDataFrame(boxes, "frame int, box int, " + BOX)
    got = {(r["frame"], r["box"]): r["point_count"] for r in
           count_in_boxes(p, b, ["frame"], ["box"], cell_m=cell).collect()}
    assert got == {(x[0], x[1]): sum(_inside(q[1:4], x[2:]) for q in points if q[0] == x[0]) for x in boxes}


def test_boxes_of_any_size_are_listed_in_few_cells(spark):
    random.seed(5)
    sizes = [1e-3, 1.0, 3.9, 4.0, 4.1, 17.0, 1000.0, 5e4, 1e12, math.inf]
    boxes = [(k, random.uniform(-50, 50), random.uniform(-50, 50), 0.0, s, s * random.uniform(0.1, 1), 4.0, random.uniform(-7, 7))
             for k, s in enumerate(sizes * 8)]
    unknown = [(900, 0.0, 0.0, 0.0, math.nan, 1.0, 1.0, 0.0), (901, None, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (902, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, math.inf)]
    b = spark.createDataFrame([(0, *x) for x in boxes + unknown], "frame int, box int, " + BOX)
    listed = {r["box"]: r["count"] for r in box_cells(b, ["frame"], ["box"], 1e-6, 4.0).groupBy("box").count().collect()}
    assert max(listed.values()) <= 9
    points = [(0, random.uniform(-600, 600), random.uniform(-60, 60), random.uniform(-3, 3), i) for i in range(2000)]
    p = spark.createDataFrame(points, "frame int, x double, y double, z double, id int")
    got = {r["box"]: r["point_count"] for r in count_in_boxes(p, b, ["frame"], ["box"]).collect()}
    want = {x[0]: sum(_inside(q[1:4], x[1:]) for q in points) for x in boxes if math.isfinite(x[4])}
    assert {k: got[k] for k in want} == want and sum(want.values()) > 2000
    assert all(got[x[0]] == 0 for x in unknown)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_boxes_are_not_broadcast(spark, tmp_path):
    """A box list looks as small as the file it is unfolded from."""
    spark.range(50).select((F.col("id") % 5).alias("frame"), F.col("id").alias("box")).write.parquet(f"{tmp_path}/b")
    one = {c.split()[0]: F.lit(0.0 if "center" in c or "yaw" in c else 2.0) for c in BOX.split(", ")}
    boxes = spark.read.parquet(f"{tmp_path}/b").withColumn("agent", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumns(one)
    points = spark.range(100).select((F.col("id") % 5).alias("frame"), (F.col("id") % 2).cast("int").alias("agent"), *[F.lit(0.5).alias(c) for c in "xyz"])
    out = spatial_support(points, boxes, ["frame", "agent"], ["box"], reference=(1.0, 0.5))
    assert sum(r["point_count"] for r in out.collect()) == 1000
    kept = boxes.select("frame", "agent", "box").withColumn("eligible", F.lit(True))
    counts = count_in_boxes(points, boxes, ["frame", "agent"], ["box"])
    peers = leave_one_out(counts.join(kept.hint("merge"), ["frame", "agent", "box"]), ["frame", "box"])
    shares = point_shares(spark.createDataFrame([(0, 0, 1, 3)], "frame int, box int, agent_id int, point_count long"), ["frame", "box"])
    assert "BroadcastHashJoin" not in _plan(counts) + _plan(peers) + _plan(shares)
    assert _plan(out).count("BroadcastHashJoin") <= 1  # at most the clouds with a bad point


def test_points_at_one_place_are_tested_once(spark):
    """Repeated points travel as one row with their number; boxes wider than all points are one level."""
    box = lambda k, at, s: (0, k, at, 0.0, 0.0, s, s, 2.0, 0.3)
    boxes = [box(0, 0.0, 2.0), box(1, 0.0, 9.0), box(2, 5.0, 20.0), box(3, 0.0, 90.0), box(4, 0.0, 9e3), box(5, 0.0, 9e5), box(6, 9e6, 9e5)]
    b = spark.createDataFrame(boxes, "frame int, box int, " + BOX)
    points = [(0, x, 0.0, z) for x in (-9.5, -0.0, 0.0, 0.25, 9.5) for z in (0.0, 3.0)] * 40 + [(0, math.nan, 0.0, 0.0)]
    p = spark.createDataFrame(points, "frame int, x double, y double, z double")
    df = count_in_boxes(p, b, ["frame"], ["box"])
    got = {r["box"]: r["point_count"] for r in df.collect()}
    assert got == {x[1]: sum(_inside(q[1:], x[2:]) for q in points) for x in boxes} and got[5] == 200
    listed = box_cells(b, ["frame"], ["box"], 1e-6, 4.0, 9.5)
    assert {r[0] for r in listed.filter("box IN (3, 4, 5)").select("__level").distinct().collect()} == {LEVELS}
    assert listed.filter("box = 6").count() == 0
    assert "x#" in _plan(df).split("HashAggregate(keys=[frame")[-1].split("]")[0]  # places are grouped first


def test_support_reasons_and_two_sided_residual(spark):
    box = (0.0, 0.0, 0.0, 2.0, 2.0, 2.0, 0.0)
    b = spark.createDataFrame(
        [("few", 0, *box, "verified"), ("many", 0, *box, "verified"), ("nan", 0, *box, "verified"),
         ("raw", 0, *box, "unresolved_transform")], "agent string, box int, " + BOX + ", transform_quality string")
    p = spark.createDataFrame(
        [("many", 0.07 * i, 0.2, -0.3) for i in range(13)] + [("nan", math.nan, 0.0, 0.0), ("raw", 0.0, 0.0, 0.0)],
        "agent string, x double, y double, z double")
    out = {r["agent"]: r for r in spatial_support(
        p, b, ["agent"], ["box"], reference=(math.log1p(5), 0.7)).collect()}
    assert out["few"]["point_count"] == 0
    assert out["few"]["deficit_residual"] > 0 and out["few"]["surplus_residual"] == 0
    assert out["many"]["point_count"] == 13
    assert out["many"]["deficit_residual"] == 0 and out["many"]["surplus_residual"] > 0
    assert out["nan"]["spatial_reason"] == "nonfinite" and out["nan"]["point_count"] is None
    assert out["raw"]["spatial_reason"] == "unresolved_transform"
    assert out["few"]["box_volume_m3"] == 8.0


def _peer(counts, eligible, sender):
    peers = [c for a, c in counts.items() if a != sender and eligible[a] and c is not None]
    own = counts[sender]
    if len(peers) < 2:
        return "insufficient_peers", len(peers), None, None
    if not eligible[sender] or own is None:
        return "visibility_unknown", len(peers), None, None
    logs = [math.log1p(v) for v in peers]
    mid = statistics.median(logs)
    scale = max(1.4826 * statistics.median(abs(v - mid) for v in logs), 0.25)
    return "matched", len(peers), abs(math.log1p(own) - mid) / scale, sum(v > 0 for v in peers) / len(peers)


def test_leave_one_out_equals_brute_force(spark):
    random.seed(8)
    groups = {}
    for g in range(60):
        n = random.randint(1, 8)
        groups[g] = ({a: random.choice([None, 0, 0, 1, 2, 5, 40]) for a in range(n)},
                     {a: random.random() < 0.8 for a in range(n)})
    rows = [(g, a, c, groups[g][1][a]) for g, (counts, _) in groups.items() for a, c in counts.items()]
    df = spark.createDataFrame(rows, "g int, agent int, point_count bigint, eligible boolean")
    for r in leave_one_out(df, ["g"]).collect():
        reason, n, gap, score = _peer(*groups[r["g"]], r["agent"])
        assert (r["peer_reason"], r["eligible_peer_count"]) == (reason, n)
        assert r["peer_disagreement"] == (None if gap is None else pytest.approx(gap, abs=1e-9))
        assert r["peer_corroboration_score"] == (None if score is None else pytest.approx(score))


def test_own_count_does_not_change_own_score(spark):
    schema = "g int, agent int, point_count bigint, eligible boolean"
    score = lambda own: leave_one_out(spark.createDataFrame(
        [(0, 0, own, True), (0, 1, 3, True), (0, 2, 0, True)], schema), ["g"]).filter("agent = 0").first()
    assert score(0)["peer_corroboration_score"] == score(500)["peer_corroboration_score"] == 0.5


def test_medians_and_summary(spark):
    random.seed(1)
    values = [("big", random.random()) for _ in range(30_001)] + [("even", v) for v in (1.0, 2.0, 4.0, 9.0)]
    df = spark.createDataFrame(values + [("none", None)], "g string, v double")
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], "v").collect()}
    assert got == {"big": statistics.median(v for g, v in values if g == "big"), "even": 3.0}
    rows = spark.createDataFrame([(3, 1.25), (3, None), (3, 6.5), (3, 1.25)], "f int, suspicion double")
    r = summarize_suspicion(rows, ["f"]).first()
    assert (r["maximum_object_suspicion"], r["median_object_suspicion"], r["any_object_evidence_unavailable"]) == (6.5, 1.25, True)


def test_scores(spark):
    schema = "k double, c double, p double, a boolean"
    rows = [(None, None, None, True), (0.0, 0.0, 1.0, True), (None, 3.0, 0.0, False), (0.057, 3.0, 0.0, True), (0.0, None, None, True)]
    df = spark.createDataFrame(rows, schema).withColumn("s", missing_aware(*[F.col(c) for c in "kcpa"]))
    got = [r["s"] for r in df.collect()]
    assert got[0]["abstained"] and got[0]["available_weight"] == 0.0
    assert got[1]["risk"] == pytest.approx(0.0) and got[3]["risk"] == pytest.approx(1.0)
    assert got[2]["risk"] == pytest.approx(1.0) and not got[2]["abstained"]
    assert got[4]["abstained"] and got[4]["available_weight"] == pytest.approx(0.4)
    null = F.lit(None).cast("double")
    assert df.select(fixed_diagnostic(null, null, null)["trust"]).first()[0] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        Weights(0.7, 0.2, 0.3)
    with pytest.raises(ValueError):
        count_residuals(F.lit(1), 0.0, 0.0)
    with pytest.raises(Exception):
        spark.createDataFrame([(math.nan, 0.0, 0.0, True)], schema).select(
            missing_aware(*[F.col(c) for c in "kcpa"])["risk"]).collect()


def test_transforms_round_trip(spark):
    m = [[0.0, -1.0, 0.0, 2.0], [1.0, 0.0, 0.0, -1.0], [0.0, 0.0, 1.0, 3.0], [0.0, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(m, 1.0, 2.0, 3.0)], "m array<array<double>>, x double, y double, z double")
    df = df.withColumn("t", G.transform_point(F.col("m"), *[F.col(c) for c in "xyz"]).col())
    df = df.withColumn("i", G.invert_transform(F.col("m")))
    back = G.transform_point(F.col("i"), *[F.col(f"t.{c}") for c in "xyz"])
    row = df.select(*[back[c].alias(c) for c in "xyz"], G.matrix_is_rigid(F.col("m")).alias("ok"),
                    G.compose_transforms(F.col("m"), F.col("i")).alias("unit"), G.matrix_to_quat(F.col("m")).alias("q")).first()
    assert (row["x"], row["y"], row["z"]) == pytest.approx((1.0, 2.0, 3.0)) and row["ok"]
    assert np.allclose(row["unit"], np.eye(4))
    again = spark.createDataFrame([(row["q"],)], "q struct<x:double,y:double,z:double,w:double>").select(
        G.quat_to_matrix(F.col("q"))).first()[0]
    assert np.allclose(again, np.array(m)[:3, :3])


def test_long_and_wide(spark):
    df = spark.createDataFrame([(1, 2.0, None), (1, 3.0, True)], "id int, a double, b boolean")
    long = to_long(df, ["id"], [Item("a", F.col("a")), Item("b", F.col("b"), "not_applicable", False)])
    rows = {(r["evidence_name"], r["value"], r["available"], r["reason_code"]) for r in long.collect()}
    assert rows == {("a", 2.0, True, "matched"), ("a", 3.0, True, "matched"),
                    ("b", None, False, "not_applicable"), ("b", 1.0, True, "matched")}
    wide = to_wide(long, ["id"], ["a", "b"], largest=("a",)).first()
    assert (wide["a"], wide["b"]) == (3.0, 1.0)


# -- overlays --------------------------------------------------------------------

def _series(spark):
    rows = [("v", t, t, (float(t), 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0)) for t in range(6)]
    rows = [(a, t * 10**9, h * 10**9, p, q, v) for a, t, h, p, q, v in rows]
    return spark.createDataFrame(rows, S.ODOMETRY)


def _spec(spark, kind, times, delta=(2.0, 0.0, 0.0)):
    return spark.createDataFrame(
        [("x", "v", kind, [t * 10**9 for t in times], delta)],
        "variant_id string, agent_id string, kind string, interval_sample_times_ns array<bigint>, "
        "delta_v_mps struct<x:double,y:double,z:double>")


def test_spike_and_drift_spill_over(spark):
    odo = _series(spark)
    drift = O.velocity_changes(odo, _spec(spark, "velocity_drift", [2, 3]), ["agent_id"])
    assert [r["applied_delta_mps"]["x"] for r in drift.orderBy("time_ns").collect()] == [1.0, 2.0]
    spike = O.velocity_changes(odo, _spec(spark, "velocity_spike", [2, 3]), ["agent_id"])
    hit = O.recompute_series(odo, spike, ["agent_id"], max_gap_s=2.0).orderBy("time_ns").collect()
    assert [r["time_ns"] // 10**9 for r in hit] == [2, 3, 4]
    assert [r["clean"]["residual_m"] for r in hit] == pytest.approx([0, 0, 0])
    assert [r["perturbed"]["residual_m"] for r in hit] == pytest.approx([1, 2, 1])


def test_incremental_series_equals_full(spark):
    from trustweave.operators.kinematics import interval_kinematics

    odo = _series(spark)
    change = O.velocity_changes(odo, _spec(spark, "velocity_drift", [1, 2, 3]), ["agent_id"])
    part = {r["time_ns"]: r["perturbed"]["residual_m"] for r in
            O.recompute_series(odo, change, ["agent_id"], max_gap_s=2.0).collect()}
    new = change.select("agent_id", "time_ns", "perturbed_velocity_mps")
    whole = odo.join(new, ["agent_id", "time_ns"], "left").withColumn(
        "body_velocity_mps", F.coalesce("perturbed_velocity_mps", "body_velocity_mps")).drop("perturbed_velocity_mps")
    full = {r["time_ns"]: r["residual_m"] for r in interval_kinematics(whole, ["agent_id"], max_gap_s=2.0).collect()}
    clean = {r["time_ns"]: r["residual_m"] for r in interval_kinematics(odo, ["agent_id"], max_gap_s=2.0).collect()}
    for t, value in full.items():
        expected = part.get(t, clean[t])
        assert value == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_failed_specs_stay_in_the_attempts(spark):
    specs = _spec(spark, "velocity_spike", [2, 4]).unionByName(
        _spec(spark, "velocity_spike", [99]).withColumn("variant_id", F.lit("absent"))).unionByName(
        _spec(spark, "velocity_spike", [2], (0.0, 0.0, 0.0)).withColumn("variant_id", F.lit("nothing")))
    odo = _series(spark)
    changes = O.velocity_changes(odo, specs, ["agent_id"])
    status = O.spec_status(specs, changes)
    effects = O.series_effects(O.recompute_series(odo, changes, ["agent_id"], max_gap_s=2.0))
    got = {r["variant_id"]: (r["status"], r["reason_code"]) for r in O.attempts(status, effects).collect()}
    assert got == {"x": ("failed", "samples_not_consecutive"), "absent": ("failed", "sample_unavailable"),
                   "nothing": ("zero_effect", "no_evidence_change")}


def test_series_delta_equals_the_join_of_single_rows(spark):
    """Repeated, lacking and further base rows, frames that share a time or have no number."""
    odo = _series(spark)
    specs = _spec(spark, "velocity_drift", [2, 3]).unionByName(
        _spec(spark, "velocity_spike", [3]).withColumn("variant_id", F.lit("y")))
    again = O.recompute_series(odo, O.velocity_changes(odo, specs, ["agent_id"]), ["agent_id"], max_gap_s=2.0)
    frames = spark.createDataFrame(
        [("v", 1, 2), ("v", 2, 3), ("v", 22, 3), ("v", None, 4), ("v", 5, 5), ("v", 6, None), ("w", 1, 2)],
        "agent_id string, sync_frame_id bigint, t bigint",
    ).selectExpr("agent_id", "sync_frame_id", "t * 1000000000 source_time_ns")
    names = [*S.KINEMATIC_EVIDENCE, "unknown_aware_fixed_risk_uncalibrated"]
    rows = [("v", f, None, n, 1.0, True, "matched", f"{f}{n}") for f in (1, 2, None) for n in names[:5]]
    rows += [("v", 2, None, names[1], 1.5, True, "matched", "again"), ("v", 1, "o", names[5], 9.0, True, "matched", "object"),
             ("v", 1, None, names[5], None, False, "out_of_range", "null"), ("v", 5, None, "other", 1.0, True, "matched", ""),
             ("v", 1, None, "maximum_object_suspicion", 0.3, True, "matched", ""),
             ("v", 1, "o", "maximum_object_suspicion", 0.6, True, "matched", ""),
             ("v", 1, None, "peer_corroboration_score", 0.5, True, "matched", ""), ("w", 1, None, names[0], 1.0, True, "matched", "w")]
    base = spark.createDataFrame(
        rows, "agent_id string, sync_frame_id bigint, object_key string, evidence_name string, "
        "value double, available boolean, reason_code string, note string")
    hit = again.join(frames.withColumnRenamed("source_time_ns", "time_ns"), ["agent_id", "time_ns"])
    known = F.col("sync_frame_id") == 1
    risk = missing_aware(F.col("perturbed.residual_m"), F.when(known, 0.6), F.when(known, 0.5), F.lit(True))["risk"]
    fields = ("dt_s", "speed_mps", "acceleration_mps2", "yaw_change_rad", "residual_m")
    single = F.array(*[F.struct(F.lit(n).alias("evidence_name"), v.alias("new_value"))
                       for n, v in zip(names, [*[F.col(f"perturbed.{f}") for f in fields], risk])])
    values = hit.select(F.col("variant_id").alias("overlay_id"), "agent_id", "sync_frame_id",
                        F.lit(None).cast("string").alias("object_key"), F.inline(single))
    wanted = O.replacement_rows(base, values, ["agent_id", "sync_frame_id", "object_key", "evidence_name"], O.ROUNDING)
    sizes = []
    for made, want in zip(O.series_delta(base, again, frames, ["agent_id"]), wanted):
        assert made.columns == want.columns
        got = sorted(map(repr, made.collect()))
        assert got == sorted(map(repr, want.collect()))
        sizes.append(len(got))
    # frame 1: one variant; 2 and 22: two, at one time; null: two
    assert sizes == [6 + 2 * 6 + 2 * 5, 2 + 2 * 6 + 2]


def _cloud(spark):
    rows = [(0, i, 0.1 * i - 1, 0.0, 0.0, float(i), i % 3) for i in range(21)]
    return spark.createDataFrame(rows, "frame int, id int, x double, y double, z double, intensity double, ring int")


def test_points_are_removed_and_added_exactly(spark):
    points = _cloud(spark)
    spec = spark.createDataFrame(
        [("r", 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.3, 0.5, 7, 5000)],
        "variant_id string, frame int, " + BOX + ", removal_fraction double, seed int, n_add int")
    gone = O.removal_choice(points, spec, ["frame"], ["id"])
    inside = [i for i in range(21) if _inside((0.1 * i - 1, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.3))]
    picked = [r["id"] for r in gone.collect()]
    assert len(picked) == len(inside) // 2 and set(picked) <= set(inside)
    assert sorted(picked) == sorted(r["id"] for r in O.removal_choice(points, spec, ["frame"], ["id"]).collect())
    assert O.remove_points(points, gone, ["id"]).count() == 21 - len(picked)
    added = O.added_points(spec, ["frame"]).collect()
    assert len({r["draw"] for r in added}) == len(added) == 5000
    assert all(_inside((r["x"], r["y"], r["z"]), (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.3)) for r in added)
    filled = O.fill_fields(O.added_points(spec, ["frame"]), points, ["frame"], ["intensity", "ring"]).first()
    assert (filled["intensity"], filled["ring"]) == (10.0, 1)
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in
                       ((1, 0, 0, 100), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1))])
    raw = O.added_points(spec.withColumn("matrix", matrix), ["frame"]).first()
    assert -101 < raw["x"] < -99


def test_incremental_peers_equal_full(spark):
    random.seed(6)
    counts = [(f, o, a, random.choice([0, 1, 4, 9]), random.random() < 0.9)
              for f in range(6) for o in range(2) for a in range(5)]
    df = spark.createDataFrame(counts, "frame int, object int, agent_id int, point_count bigint, eligible boolean")
    changes = spark.createDataFrame(
        [("v", 1, 0, 2, 3), ("v", 4, 1, 0, 2)], "variant_id string, frame int, object int, agent_id int, count_change bigint")
    part = O.recompute_peers(df, changes, ["frame", "object"])
    whole = df.join(changes.drop("variant_id"), ["frame", "object", "agent_id"], "left").withColumn(
        "point_count", F.col("point_count") + F.coalesce("count_change", F.lit(0))).drop("count_change")
    full = leave_one_out(whole, ["frame", "object"])
    key = lambda r: (r["frame"], r["object"], r["agent_id"])
    view = lambda r: (r["point_count"], r["peer_reason"], r["peer_disagreement"], r["peer_corroboration_score"])
    want = {key(r): view(r) for r in full.collect()}
    got = {key(r): view(r) for r in part.collect()}
    assert len(got) == 10
    assert all(want[k] == v for k, v in got.items())
    before = {key(r): view(r) for r in leave_one_out(df, ["frame", "object"]).collect()}
    assert all(before[k] == v for k, v in want.items() if k not in got)


def test_rounding_of_a_measured_value_is_no_change(spark):
    """A value measured anew may differ from the base in its last bits."""
    names = "k int, value double, available boolean, reason_code string"
    old = [(0, 0.4), (1, 0.4), (2, None), (3, 0.4), (4, math.nan), (5, 5e9), (6, math.inf)]
    new = [(0, 0.4 + 2**-54 * 4), (1, 0.4 + 1e-8), (2, 0.4), (3, None), (4, math.nan), (5, 5e9 + 1), (6, math.inf)]
    base = spark.createDataFrame([(k, v, v is not None, "matched") for k, v in old], names)
    values = spark.createDataFrame([("o", k, v) for k, v in new], "overlay_id string, k int, new_value double")
    changed = lambda *noise: {r["k"] for r in O.replacement_rows(base, values, ["k"], *noise)[0].filter("changed").collect()}
    assert changed() == {0, 1, 2, 3, 5}
    assert changed(O.ROUNDING) == {1, 2, 3}
