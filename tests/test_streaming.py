"""Streams must give what the batch rules give."""

import random

from pyspark.sql import functions as F

from trustweave import schemas as S
from trustweave.operators.ordered import time_slot
from trustweave.operators.temporal import Smoothing, ewma, label_state
from trustweave.streaming import jobs
from tests.brute import match_one

SECOND = 1_000_000_000


def _files(spark, df, path, parts, time):
    """Write rows as several files, in time order, one per micro-batch."""
    ordered = sorted(df.collect(), key=lambda r: r[time])
    step = -(-len(ordered) // parts)
    for i in range(parts):
        rows = ordered[i * step:(i + 1) * step]
        if rows:
            spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(str(path))


def _stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_smooth_stream_equals_batch(spark, tmp_path):
    jobs.use_rocksdb(spark)
    random.seed(5)
    rows = [
        (str(k), t * SECOND + k, None if random.random() < 0.3 else random.random())
        for k in range(3) for t in range(1, 60)
    ]
    df = spark.createDataFrame(rows, "agent_id string, decision_time_ns bigint, risk_score double")
    # a last, far-away row moves the watermark past all others
    flush = spark.createDataFrame([("flush", 10_000 * SECOND, 0.0)], df.schema)
    _files(spark, df.unionByName(flush), tmp_path / "in", 4, "decision_time_ns")
    out = jobs.smooth_stream(_stream(spark, df, tmp_path / "in"), ["agent_id"], delay="0 seconds")
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {
        (r["agent_id"], r["decision_time_ns"]): (r["ewma"], r["previous_state"], r["current_state"])
        for r in spark.read.parquet(str(tmp_path / "out")).filter("agent_id <> 'flush'").collect()
    }
    batch = label_state(ewma(
        df, ["agent_id"], ["decision_time_ns"], time_slot(F.col("decision_time_ns"), 7 * SECOND), "risk_score"
    ))
    want = {
        (r["agent_id"], r["decision_time_ns"]): (r["ewma"], r["previous_state"], r["current_state"])
        for r in batch.collect()
    }
    assert set(got) == set(want)
    for k, (value, *labels) in want.items():
        assert got[k][1:] == tuple(labels)
        assert (value is None) == (got[k][0] is None)
        assert value is None or abs(value - got[k][0]) < 1e-12


def test_smooth_stream_reset_and_expiry(spark, tmp_path):
    jobs.use_rocksdb(spark)
    schema = "agent_id string, decision_time_ns bigint, risk_score double, reset boolean"
    rows = [
        ("a", 1 * SECOND, 1.0, False), ("a", 2 * SECOND, None, True), ("a", 3 * SECOND, 0.1, False),
        ("b", 1 * SECOND, 1.0, False), ("b", 100 * SECOND, 0.1, False), ("flush", 9999 * SECOND, 0.0, False),
    ]
    df = spark.createDataFrame(rows, schema)
    _files(spark, df, tmp_path / "in", 2, "decision_time_ns")
    out = jobs.smooth_stream(_stream(spark, df, tmp_path / "in"), ["agent_id"], delay="0 seconds", expire_after_ns=50 * SECOND)
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["agent_id"], r["decision_time_ns"] // SECOND): (r["ewma"], r["previous_state"])
           for r in spark.read.parquet(str(tmp_path / "out")).filter("agent_id <> 'flush'").collect()}
    assert got == {
        ("a", 1): (1.0, "unknown"), ("a", 3): (0.1, "unknown"),
        ("b", 1): (1.0, "unknown"), ("b", 100): (0.1, "unknown"),
    }


def test_match_stream_equals_rules(spark, tmp_path):
    jobs.use_rocksdb(spark)
    random.seed(9)
    key = ["sequence_id", "session_id", "agent_id"]
    messages, members = [], []
    for agent in "ab":
        for s in random.sample(range(1, 300), 60):
            delay = random.choice([0, 1, 5, 30])
            messages.append(("s", "t", agent, s * SECOND, (s + delay) * SECOND,
                             random.random() < 0.1, random.random() < 0.8, None))
        for f in range(60):
            members.append(("s", "t", f, random.randint(0, 320) * SECOND, agent,
                            random.random() < 0.9, random.random() < 0.9))
    flush = [("s", "t", "z", 9999 * SECOND, 9999 * SECOND, False, True, None)]
    m = spark.createDataFrame(messages + flush, S.MESSAGES)
    late_decision = [("s", "t", 0, 9990 * SECOND, "z", True, True)]
    d = spark.createDataFrame(members + late_decision, S.MEMBERSHIPS)
    _files(spark, m, tmp_path / "m", 5, "arrival_time_ns")
    d.coalesce(1).write.parquet(str(tmp_path / "d"))
    age, ahead, wait = 6 * SECOND, 4 * SECOND, 40 * SECOND
    out = jobs.match_stream(
        spark.readStream.schema(d.schema).parquet(str(tmp_path / "d")), _stream(spark, m, tmp_path / "m"),
        key, max_age_ns=age, lookahead_ns=ahead, wait_ns=wait, delay="0 seconds",
    )
    jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["agent_id"], r["sync_frame_id"]): (r["reason_code"], r["source_time_ns"])
           for r in spark.read.parquet(str(tmp_path / "out")).filter("agent_id <> 'z'").collect()}
    want = {}
    for row in members:
        seen = [x for x in messages if x[4] <= row[3] + ahead + wait]
        want[(row[4], row[2])] = match_one(row, seen, "buffered_nearest", age, ahead)
    assert got == want


def test_distinct_windows_and_gate(spark, tmp_path):
    schema = "agent_id string, source_time_ns bigint, arrival_time_ns bigint"
    rows = [("a", 1 * SECOND, 1 * SECOND), ("a", 1 * SECOND, 2 * SECOND), ("a", 3 * SECOND, 3 * SECOND),
            ("b", 1 * SECOND, 1 * SECOND), ("b", 200 * SECOND, 200 * SECOND)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.run_available(
        jobs.distinct_messages(stream, ["agent_id"], "1 minute"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 4

    timed = stream.withColumn("t", jobs.event_time(F.col("arrival_time_ns")))
    jobs.run_available(
        jobs.windowed_counts(timed, "t", ["agent_id"], "10 seconds", "0 seconds"),
        str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = {(r["agent_id"], r["rows"]) for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert ("a", 3) in got and ("b", 1) in got
    jobs.run_available(
        jobs.session_counts(timed, "t", ["agent_id"], "5 seconds", "0 seconds"),
        str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert ("a", 3) in {(r["agent_id"], r["rows"]) for r in spark.read.parquet(str(tmp_path / "o3")).collect()}

    packets = stream.select(
        "agent_id", "source_time_ns", F.col("arrival_time_ns").alias("decision_time_ns"),
        F.lit(10).cast("bigint").alias("measured_size_bytes"))
    states = spark.createDataFrame([("a", "normal"), ("b", "quarantined")], "agent_id string, current_state string")
    gated = jobs.admit_stream(packets, states, ["agent_id"], max_source_age_ns=SECOND, check_integrity=False)
    totals = []
    query = gated.writeStream.foreachBatch(
        lambda batch, _: totals.extend(jobs.byte_counts(batch).collect())
    ).option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["policy"], r["reason_code"]): r["admitted_bytes"] for r in totals}
    assert got == {("full_share", "admitted"): 50, ("hard_gate", "admitted"): 30, ("hard_gate", "hard_gated"): 0}


def test_match_sweep_is_exact_and_linear():
    """Answers of one key with 100,000 decisions, in time that grows with the rows."""
    import time

    from trustweave.streaming.processors import MatchProcessor

    rng = random.Random(4)
    def rows(n):
        messages = [(10 * k + rng.randrange(5), 10 * k + rng.randrange(5) + rng.choice([0, 3, 400]), False, True) for k in range(n)]
        decisions = [(k, 10 * k + rng.randrange(10), rng.random() < 0.95, rng.random() < 0.95) for k in range(n)]
        return messages, sorted(decisions, key=lambda d: d[1])

    messages, decisions = rows(400)
    processor = MatchProcessor(["k"], 60, 25, 1000)
    got = {r[0]: (r[5], r[2]) for r in processor._settle(decisions, messages)}
    for frame, at, member, expected in decisions:
        row = ("s", "t", frame, at, "a", member, expected)
        seen = [("s", "t", "a", m[0], m[1], m[2], m[3], None) for m in messages if m[1] <= at + 1025]
        assert got[frame] == match_one(row, seen, "buffered_nearest", 60, 25)
    took = []
    for n in (25_000, 100_000):
        messages, decisions = rows(n)
        began = time.perf_counter()
        assert sum(1 for _ in processor._settle(decisions, messages)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


class _Handle:
    """State variables in plain dictionaries, counting what is read from slots."""

    class Value:
        def __init__(self):
            self.held = None

        exists = lambda self: self.held is not None
        get = lambda self: self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Items(Value):
        get = lambda self: iter(self.held or ())

        def appendList(self, rows):
            self.held = [*(self.held or ()), *rows]

        def put(self, rows):
            self.held = list(rows)

    class Map:
        def __init__(self):
            self.held, self.read = {}, 0

        containsKey = lambda self, k: k in self.held

        def getValue(self, k):
            self.read += len(self.held[k][0])
            return self.held[k]

        def updateValue(self, k, v):
            self.held[k] = v

        def removeKey(self, k):
            del self.held[k]

        def clear(self):
            self.held = {}

    def __init__(self):
        self.timers = set()

    getValueState = lambda self, *_: self.Value()
    getListState = lambda self, *_: self.Items()
    getMapState = lambda self, *_: self.Map()
    registerTimer = lambda self, ms: self.timers.add(ms)

    def expire(self, processor, key, until):
        out = []
        while due := sorted(t for t in self.timers if t <= until):
            self.timers.discard(due[0])
            out += list(processor.handleExpiredTimer(key, None, type("T", (), {"getExpiryTimeInMs": lambda _: due[0]})()))
        return out


def _arrow_rows(decisions, messages):
    import pandas as pd

    rows = [(True, f, t, -1, m, e, False, False) for f, t, m, e in decisions] + [(False, -1, s, a, False, False, e, p) for s, a, e, p in messages]
    return pd.DataFrame(rows, columns=["is_decision", "sync_frame_id", "time_ns", "arrival_ns", "member", "message_expected", "empty_scene", "pose_valid"])


def test_reads_per_timer_do_not_grow_with_history():
    """A key with 400 micro-batches: answers are the rules', late timers read what early ones do."""
    from trustweave.streaming.processors import MatchProcessor

    rng = random.Random(8)
    ahead, wait, age = 2 * SECOND, 8 * SECOND, 5 * SECOND
    processor, handle = MatchProcessor(["k"], age, ahead, wait), _Handle()
    processor.init(handle)
    messages, decisions, got, reads, held = [], [], {}, [], []
    for step in range(400):
        at = 10 * step * SECOND
        sent = [(at + rng.randrange(10 * SECOND), 0, rng.random() < 0.1, rng.random() < 0.8) for _ in range(rng.choice([0, 4, 9]))]
        sent = [(s, s + rng.choice([0, 1, 7 * SECOND]), e, p) for s, _, e, p in sent]
        asked = [(4 * step + k, at + rng.randrange(10 * SECOND), True, True) for k in range(4)]
        messages, decisions = messages + sent, decisions + asked
        processor.handleInputRows(("a",), iter([_arrow_rows(asked, sent)]), None)
        before = processor.slots.read
        for frame in handle.expire(processor, ("a",), at // 1_000_000 - 20_000):
            got |= {r.sync_frame_id: (r.reason_code, None if r.source_time_ns is None or r.source_time_ns != r.source_time_ns else int(r.source_time_ns)) for r in frame.astype(object).where(frame.notna(), None).itertuples()}
        reads.append(processor.slots.read - before)
        held.append(sum(len(v[0]) for v in processor.slots.held.values()))
    for frame in handle.expire(processor, ("a",), 10**9):
        got |= {r.sync_frame_id: (r.reason_code, None if r.source_time_ns is None else int(r.source_time_ns)) for r in frame.astype(object).where(frame.notna(), None).itertuples()}
    for frame, at, member, expected in decisions:
        seen = [("s", "t", "a", *m, None) for m in messages if m[1] <= at + ahead + wait]
        assert got[frame] == match_one(("s", "t", frame, at, "a", member, expected), seen, "buffered_nearest", age, ahead)
    assert max(reads[300:]) <= 1.5 * max(reads[20:120]) and max(held) < 60
    assert not processor.slots.held and processor.newest.exists()


def test_messages_without_decisions_leave_the_state():
    from trustweave.streaming.processors import MatchProcessor

    for forget in (None, 100 * SECOND):
        processor, handle = MatchProcessor(["k"], 5 * SECOND, 0, 0, forget), _Handle()
        processor.init(handle)
        for step in range(50):
            processor.handleInputRows(("a",), iter([_arrow_rows([], [(step * SECOND, step * SECOND, False, True)])]), None)
        handle.expire(processor, ("a",), 90_000)
        assert not processor.slots.held and processor.newest.get()[0] == 49 * SECOND
        handle.expire(processor, ("a",), 1_000_000)
        assert processor.newest.exists() == processor.index.exists() == (forget is None) and not handle.timers


def test_state_of_silent_keys_is_removed(spark, tmp_path):
    """After the bound, the state store holds rows of the last key alone."""
    jobs.use_rocksdb(spark)
    schema = "agent_id string, decision_time_ns bigint, risk_score double"
    batches = [[(str(k), t * SECOND, 0.5) for k in range(20) for t in (1, 2, 3)]] + [[(f"late{t}", t * SECOND, 0.5)] for t in (500, 900, 990, 999)]
    df = spark.createDataFrame(batches[0], schema)
    held = {}
    for expire in (None, 50 * SECOND):
        path = tmp_path / f"in-{expire}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
        out = jobs.smooth_stream(_stream(spark, df, path), ["agent_id"], delay="0 seconds", expire_after_ns=expire)
        jobs.run_available(out, str(tmp_path / f"out-{expire}"), str(tmp_path / f"cp-{expire}"))
        state = spark.read.format("statestore").option("path", str(tmp_path / f"cp-{expire}")).option("stateVarName", "memory").load()
        held[expire] = {r.key.agent_id for r in state.select("key").collect()}
    assert {str(k) for k in range(20)} <= held[None]
    assert not held[50 * SECOND] & {str(k) for k in range(20)} and len(held[50 * SECOND]) <= 3


def test_event_time_is_exact(spark):
    row = spark.sql("SELECT 1704067200000000001L AS a, 1704067200000000000L AS b, 999L AS c").select(
        *[F.unix_micros(jobs.event_time(F.col(c))).alias(c) for c in "abc"]).first()
    assert tuple(row) == (1704067200000001, 1704067200000000, 1)


def test_streams_in_buckets_equal_streams_by_key(spark, tmp_path):
    """Keys dealt to buckets get the same answers; calls and timers follow buckets, not keys."""
    jobs.use_rocksdb(spark)
    random.seed(11)
    schema = "agent_id string, decision_time_ns bigint, risk_score double, reset boolean"
    rows = [
        (str(k), t * SECOND + k, None if random.random() < 0.3 else random.random(), random.random() < 0.1)
        for k in range(30) for t in range(1, 40) if random.random() < 0.5
    ]
    df = spark.createDataFrame([*rows, ("flush", 10_000 * SECOND, 0.0, False)], schema)
    _files(spark, df, tmp_path / "in", 3, "decision_time_ns")
    got = {}
    for expire in (None, 3 * SECOND):
        for buckets in (None, 4):
            at = tmp_path / f"{expire}-{buckets}"
            out = jobs.smooth_stream(_stream(spark, df, tmp_path / "in"), ["agent_id"], delay="0 seconds", expire_after_ns=expire, buckets=buckets)
            jobs.run_available(out, str(at / "out"), str(at / "cp"))
            got[expire, buckets] = sorted(map(repr, spark.read.schema(out.schema).parquet(str(at / "out")).filter("agent_id <> 'flush'").collect()))
        assert got[expire, None] == got[expire, 4] and got[expire, 4]
        state = spark.read.format("statestore").option("path", str(at / "cp")).option("stateVarName", "memory").load()
        assert {r.key.bucket for r in state.select("key").collect()} <= set(range(4))


def test_match_in_a_bucket_equals_rules_and_forgets():
    """400 micro-batches of a bucket with three keys: answers are the rules', and of messages
    that are too old only the newest of each key stays."""
    from trustweave.streaming.processors import MatchManyProcessor, _unpacked

    rng = random.Random(8)
    ahead, wait, age = 2 * SECOND, 8 * SECOND, 5 * SECOND
    processor, handle = MatchManyProcessor(["k"], age, ahead, wait), _Handle()
    processor.init(handle)
    size = lambda: len(_unpacked(processor.messages.get(), ["k"]))
    messages, decisions, frames, held = {k: [] for k in "abc"}, {k: [] for k in "abc"}, [], []
    for step in range(400):
        at = 10 * step * SECOND
        parts = []
        for k in "abc":
            sent = [(at + rng.randrange(10 * SECOND), rng.random() < 0.1, rng.random() < 0.8) for _ in range(rng.choice([0, 4, 9]))]
            sent = [(s, s + rng.choice([0, 1, 7 * SECOND]), e, p) for s, e, p in sent]
            asked = [(4 * step + i, at + rng.randrange(10 * SECOND), True, True) for i in range(4)]
            messages[k] += sent
            decisions[k] += asked
            parts.append(_arrow_rows(asked, sent).assign(k=k))
        processor.handleInputRows((0,), iter(parts), None)
        frames += handle.expire(processor, (0,), at // 1_000_000 - 20_000)
        held.append(size())
    frames += handle.expire(processor, (0,), 10**9)
    got = {(r.k, r.sync_frame_id): (r.reason_code, None if r.source_time_ns is None else int(r.source_time_ns))
           for f in frames for r in f.astype(object).where(f.notna(), None).itertuples()}
    for k in "abc":
        for frame, at, member, expected in decisions[k]:
            seen = [("s", "t", k, *m, None) for m in messages[k] if m[1] <= at + ahead + wait]
            assert got[k, frame] == match_one(("s", "t", frame, at, k, member, expected), seen, "buffered_nearest", age, ahead)
    assert max(held) < 180 and size() == 3 and processor.decisions.held is None
