"""Matching, poses, kinematics and smoothing against plain restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trustweave import schemas as S
from trustweave.operators.kinematics import interval_kinematics
from trustweave.operators.match import match_messages, reason_counts
from trustweave.operators.ordered import choose_slot_ns, previous_row, rank_in_key, time_slot
from trustweave.operators.pose import pose_at
from trustweave.operators.temporal import Smoothing, ewma, label_state
from tests.brute import match_one

SEC = 1_000_000_000


def _random_case(seed):
    random.seed(seed)
    messages, members = [], []
    for agent in ("a", "b", "silent", "tail"):
        for s in random.sample(range(3000), 100):
            if agent == "silent" or (agent == "tail" and s < 1500):
                continue
            delay = random.choice([0, 5, 60, 150, 400])
            messages.append(("s", "t", agent, s, s + delay, random.random() < 0.1,
                             random.random() < 0.8, s - 1 if s else None))
        for f in range(120):
            members.append(("s", "t", f, random.randint(0, 3300), agent,
                            random.random() < 0.9, random.random() < 0.9))
    return messages, members


@pytest.mark.parametrize("policy,age,ahead,slot", [
    (S.CAUSAL, 30, 0, 100), (S.CAUSAL, 200, 0, 10**6),
    (S.BUFFERED, 30, 100, 100), (S.BUFFERED, 20, 500, 10**6), (S.BUFFERED, 300, 7, 50),
])
def test_match_equals_brute_force(spark, policy, age, ahead, slot):
    messages, members = _random_case(age + ahead)
    out = match_messages(
        spark.createDataFrame(members, S.MEMBERSHIPS), spark.createDataFrame(messages, S.MESSAGES),
        policy=policy, max_age_ns=age, lookahead_ns=ahead, slot_ns=slot,
    )
    got = {(r["agent_id"], r["sync_frame_id"]): (r["reason_code"], r["source_time_ns"]) for r in out.collect()}
    assert got == {(m[4], m[2]): match_one(m, messages, policy, age, ahead) for m in members}


def test_timeline_of_reasons(spark):
    """One frame of agents for every outcome, each decision at 70,000."""
    at, age = 70_000, 640
    cases = {  # agent: (member, expected, source, arrival, empty, pose valid, pose time)
        "fresh": (True, True, at - 310, at - 30, False, True, None), "slow": (True, True, at - 120, at + 1, False, True, None),
        "silent": (True, False, None, None, None, None, None), "tilted": (True, True, at - 77, at, False, False, at - 90),
        "bare": (True, True, at, at, True, True, None), "old": (True, True, at - 641, at - 600, False, True, None),
        "early": (True, True, at + 5, at + 6, False, True, None), "guest": (False, False, at - 10, at - 10, False, True, None),
    }
    members = [("s", "t", 4, at, agent, c[0], c[1]) for agent, c in cases.items()]
    messages = [("s", "t", agent, *c[2:]) for agent, c in cases.items() if c[2] is not None]
    causal = match_messages(
        spark.createDataFrame(members, S.MEMBERSHIPS), spark.createDataFrame(messages, S.MESSAGES), max_age_ns=age
    )
    ahead = match_messages(
        spark.createDataFrame([("s", "t", 5, at, "far", True, True)], S.MEMBERSHIPS),
        spark.createDataFrame([("s", "t", "far", at + 700, at + 700, False, True, None)], S.MESSAGES),
        policy=S.BUFFERED, max_age_ns=age, lookahead_ns=900,
    )
    rows = {r["agent_id"]: r for r in causal.unionByName(ahead).collect()}
    assert {k: r["reason_code"] for k, r in rows.items()} == {
        "fresh": "matched", "slow": "late", "silent": "missing_message", "tilted": "invalid_pose", "bare": "empty_scene",
        "old": "stale", "early": "unmatched", "guest": "not_member", "far": "out_of_range",
    }
    assert rows["fresh"]["match_age_ns"] == 310
    assert rows["tilted"]["pose_source_time_ns"] is None
    assert sum(r["rows"] for r in reason_counts(causal).collect()) == len(cases)


def test_tie_goes_to_the_past(spark):
    m = spark.createDataFrame([("s", "t", 0, 1000, "a", True, True)], S.MEMBERSHIPS)
    g = spark.createDataFrame(
        [("s", "t", "a", t, t, False, True, None) for t in (990, 1010)], S.MESSAGES)
    row = match_messages(m, g, policy=S.BUFFERED, max_age_ns=100, lookahead_ns=50).first()
    assert row["source_time_ns"] == 990


def test_match_parameters_are_checked(spark):
    m, g = spark.createDataFrame([], S.MEMBERSHIPS), spark.createDataFrame([], S.MESSAGES)
    for options in ({"policy": S.CAUSAL, "lookahead_ns": 1}, {"policy": S.BUFFERED}, {"policy": "none"}):
        with pytest.raises(ValueError):
            match_messages(m, g, max_age_ns=1, **options)


def test_pose_between_two_samples(spark):
    r = math.sqrt(0.5)
    samples = spark.createDataFrame(
        [("s", "t", "a", 100, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)),
         ("s", "t", "a", 200, (10.0, 0.0, 0.0), (0.0, 0.0, r, r))], S.POSE_SAMPLES)
    targets = spark.createDataFrame(
        [("s", "t", "a", t, d) for t, d in ((100, 100), (150, 200), (150, 199), (99, 300), (201, 300), (200, 150))],
        "sequence_id string, session_id string, agent_id string, target_time_ns bigint, decision_time_ns bigint")
    out = {(x["target_time_ns"], x["decision_time_ns"]): x for x in
           pose_at(targets, samples, max_gap_ns=100, slot_ns=30).collect()}
    assert out[(100, 100)]["reason_code"] == "matched" and out[(100, 100)]["translation_m"]["x"] == 0.0
    mid = out[(150, 200)]
    assert mid["pose_source_time_ns"] == 200 and mid["pose_age_ns"] == 0
    assert mid["translation_m"]["x"] == 5.0
    assert mid["quaternion_xyzw"]["z"] == pytest.approx(math.sin(math.pi / 8), abs=1e-12)
    assert out[(150, 199)]["reason_code"] == "future_pose_unavailable"
    assert out[(99, 300)]["reason_code"] == out[(201, 300)]["reason_code"] == "out_of_range"
    assert out[(200, 150)]["reason_code"] == "future_pose_unavailable"
    gap = pose_at(targets, samples, max_gap_ns=99, slot_ns=1000).filter("target_time_ns = 150").first()
    assert gap["reason_code"] == "invalid_pose"


def _quaternion(yaw):
    return (0.0, 0.0, math.sin(yaw / 2), math.cos(yaw / 2))


def test_kinematics_analytic_cases(spark):
    rows = [
        ("straight", 0, 0, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("straight", SEC, SEC, (1.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("turn", 0, 0, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("turn", SEC, SEC, (0.0, 0.0, 0.0), _quaternion(math.pi / 2), (1.0, 0.0, 0.0)),
        ("gap", 0, 0, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("gap", 3 * SEC, 3 * SEC, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("nan", 0, 0, (math.nan, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("nan", SEC, SEC, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("norm", 0, 0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.1), (1.0, 0.0, 0.0)),
        ("norm", SEC, SEC, (0.0, 0.0, 0.0), _quaternion(0), (1.0, 0.0, 0.0)),
        ("flip", 0, 0, (0.0, 0.0, 0.0), _quaternion(0.1), (1.0, 0.0, 0.0)),
        ("flip", SEC, SEC, (0.0, 0.0, 0.0), tuple(-v for v in _quaternion(0.3)), (1.0, 0.0, 0.0)),
    ]
    odo = spark.createDataFrame(rows, S.ODOMETRY)
    out = {r["agent_id"]: r for r in interval_kinematics(odo, ["agent_id"], max_gap_s=2.0).collect() if r["time_ns"]}
    assert out["straight"]["residual_m"] == pytest.approx(0, abs=1e-12)
    assert out["straight"]["speed_mps"] == 1.0
    mids = [(k + 0.5) / 10 * math.pi / 2 for k in range(10)]
    moved = out["turn"]["integrated_displacement_m"]
    assert moved["x"] == pytest.approx(sum(map(math.cos, mids)) / 10, abs=1e-12)
    assert moved["y"] == pytest.approx(sum(map(math.sin, mids)) / 10, abs=1e-12)
    assert out["turn"]["yaw_change_rad"] == pytest.approx(math.pi / 2)
    assert out["gap"]["reason_code"] == "excessive_gap"
    assert out["nan"]["reason_code"] == "nonfinite"
    assert out["norm"]["reason_code"] == "invalid_quaternion"
    assert out["flip"]["yaw_change_rad"] == pytest.approx(0.2)
    first = interval_kinematics(odo, ["agent_id"], max_gap_s=2.0).filter("time_ns = 0").first()
    assert first["reason_code"] == "out_of_range"


@pytest.mark.parametrize("config", [
    Smoothing(), Smoothing(alpha=0.5, initial_value=0.4), Smoothing(alpha=0.01), Smoothing(alpha=1.0)])
@pytest.mark.parametrize("slot", [60, 10**9])
def test_ewma_equals_the_recurrence(spark, config, slot):
    random.seed(2)
    rows = [(k, t * 10 + k, None if random.random() < 0.3 or (k == 2 and t < 40) else random.random())
            for k in range(3) for t in range(400)]
    df = spark.createDataFrame(rows, "k int, t bigint, x double")
    got = {(r["k"], r["t"]): r for r in
           label_state(ewma(df, ["k"], ["t"], time_slot(F.col("t"), slot), "x", config), config).collect()}
    for key in range(3):
        value, state = None, "unknown"
        for k, t, x in (r for r in rows if r[0] == key):
            if x is not None:
                start = config.initial_value if value is None else value
                value = x if start is None else config.alpha * x + (1 - config.alpha) * start
            now = "unknown" if x is None else "quarantined" if value >= config.threshold else "normal"
            r = got[(k, t)]
            assert (r["previous_state"], r["current_state"]) == (state, now)
            assert r["ewma"] == (None if value is None else pytest.approx(value, abs=1e-12))
            state = now


def test_hot_key_is_split_over_slots(spark):
    """One key with almost all rows: rows spread over slots, results unchanged."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("k"), F.col("id").alias("t"))
    slot = choose_slot_ns(df, ["k"], "t", target_rows=2_000)
    assert slot <= 2_021
    ranked = rank_in_key(df, ["k"], ["t"], time_slot(F.col("t"), slot))
    assert ranked.filter("k = 'hot'").agg(F.max("rank")).first()[0] == 19_800
    lagged = previous_row(df, ["k"], ["t"], time_slot(F.col("t"), slot), ["t"])
    assert lagged.filter("previous is null").count() == 2
    assert lagged.filter("k = 'cold' and t - previous.t <> 100").count() == 0


def test_parameters(spark):
    for bad in ({"alpha": 0}, {"alpha": 1.1}, {"threshold": 2}, {"initial_value": -1}):
        with pytest.raises(ValueError):
            Smoothing(**bad)


def test_slots_stay_near_the_target_where_rows_crowd(spark):
    """A key with a third of all rows, most of them within one hour."""
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 180_000_000).alias("t"))
    rest = spark.range(40_000).select((F.col("id") % 40).cast("string").alias("k"), (F.col("id") * 60_000_000_000).alias("t"))
    df = hot.unionByName(rest)
    slot = choose_slot_ns(df, ["k"], "t", target_rows=1_000)
    fullest = df.groupBy("k", time_slot(F.col("t"), slot).alias("s")).count().agg(F.max("count")).first()[0]
    assert fullest <= 1_100


def test_future_sources_by_sweep_equal_brute_force(spark, monkeypatch):
    """Slots, equal times, repeated decisions and null keys, in small pieces of rows."""
    import random

    from trustweave.operators import match

    monkeypatch.setattr(match, "SWEEP_ROWS", 20)
    rng = random.Random(3)
    messages = sorted({(rng.choice(["a", "b", None]), rng.randrange(400)) for _ in range(250)}, key=str)
    messages = [(k, s, s + rng.choice([0, 0, 3, 9, 40])) for k, s in messages]
    decisions = [(rng.choice(["a", "b", "c", None]), rng.randrange(420)) for _ in range(300)]
    m = spark.createDataFrame([(k, s, a, (s, a, "x")) for k, s, a in messages], "k string, source_time_ns bigint, arrival_time_ns bigint, __message struct<source_time_ns:bigint,arrival_time_ns:bigint,note:string>")
    d = spark.createDataFrame(decisions, "k string, decision_time_ns bigint")
    for ahead in (1, 7, 90):
        got = {(r.k, r.decision_time_ns): tuple(r.future) for r in match.nearest_future(d, m, ["k"], ahead).collect()}
        want = {}
        for k, t in decisions:
            fits = [(s, a) for q, s, a in messages if q == k and t < s <= t + ahead and a <= t + ahead]
            if fits:
                want[k, t] = (*min(fits), "x")
        assert got == want
    assert match.nearest_future(d.limit(0), m, ["k"], 5).count() == match.nearest_future(d, m.limit(0), ["k"], 5).count() == 0
