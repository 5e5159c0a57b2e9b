"""As-of matching of expected observations to source messages.

Every membership row comes back with a reason; none is dropped. There is no
message-by-decision join: messages and decisions are merged into one time line per
source key and answered by running values (:mod:`trustweave.operators.ordered`).

A message can be used for a decision at ``d`` when its source and arrival are not
after ``d + lookahead``. As arrivals never precede sources, a *past* source is
usable from ``max(source, arrival - lookahead)`` on, so the newest usable past
source is a running maximum over that time. *Future* sources (buffered policy
only) need the smallest source after ``d`` among those that arrived by the limit;
see :func:`nearest_future`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trustweave.operators.ordered import DAY_NS, Running, running, time_slot
from trustweave.schemas import BUFFERED, CAUSAL, SOURCE_KEY
from trustweave.sources.stage import stage


def _check(policy: str, max_age_ns: int, lookahead_ns: int) -> None:
    if policy not in (CAUSAL, BUFFERED):
        raise ValueError("matching needs the causal or the buffered policy")
    if max_age_ns < 0:
        raise ValueError("max_age_ns must be nonnegative")
    if policy == CAUSAL and lookahead_ns != 0:
        raise ValueError("causal matching cannot declare a look-ahead")
    if policy == BUFFERED and lookahead_ns <= 0:
        raise ValueError("buffered matching requires a positive look-ahead")


#: Rows that a task sweeps at once, whole slots at least.
SWEEP_ROWS = 200_000


def _sweep(group: np.ndarray, is_decision: np.ndarray, time: np.ndarray, arrival: np.ndarray, lookahead_ns: int):
    """(decision rows, message rows): for each decision the first later message that arrived by
    its limit, if there is one. Rows are sorted by group, time, messages first."""
    message = np.flatnonzero(~is_decision)
    first = np.ones(len(group), bool)  # equal decisions are asked once
    first[1:] = (group[1:] != group[:-1]) | (time[1:] != time[:-1]) | (is_decision[1:] != is_decision[:-1])
    asked = np.flatnonzero(is_decision & first)
    at = np.cumsum(~is_decision)[asked]  # messages up to the decision
    limit = time[asked] + lookahead_ns
    # least arrival of 2**k messages from each place on; the end stops every search
    least = [np.append(arrival[message], np.iinfo(np.int64).min)]
    while (1 << len(least)) <= len(least[0]):
        step, last = 1 << (len(least) - 1), least[-1]
        least.append(np.minimum(last, np.append(last[step:], np.full(step, last[-1]))))
    for k in range(len(least) - 1, -1, -1):
        at = np.where(least[k][at] > limit, np.minimum(at + (1 << k), len(message)), at)
    there = at < len(message)
    asked, limit, found = asked[there], limit[there], message[at[there]]
    fits = (group[found] == group[asked]) & (time[found] <= limit)
    return asked[fits], found[fits]


def nearest_future(
    decisions: DataFrame, messages: DataFrame, keys: list[str], lookahead_ns: int
) -> DataFrame:
    """Smallest source after each decision among messages arrived by the limit.

    Time is cut into slots as wide as the look-ahead, so a decision's messages lie in its own
    slot and the next: a message is listed in two slots, and each slot is swept on its own.
    In a slot the messages lie by source; the answer is the first one from the decision on
    whose arrival is within the limit, which a table of least arrivals over runs of 2**k
    messages finds in a few steps for all decisions at once. No pairs are formed. Returns
    one row per answered (keys, decision_time_ns) with ``future`` (the message).
    """
    slot = time_slot(F.col("__t"), lookahead_ns)
    asked = decisions.select(*keys, F.col("decision_time_ns").alias("__t"), F.lit(True).alias("__asks")).withColumn("__slot", slot)
    sent = messages.select(*keys, F.col("source_time_ns").alias("__t"), F.lit(False).alias("__asks"), "arrival_time_ns", "__message").withColumn(
        "__slot", F.explode(F.array(slot - 1, slot))
    )
    by = [*keys, "__slot"]
    line = sent.unionByName(asked, allowMissingColumns=True).select(*by, "__t", "__asks", "arrival_time_ns", "__message")
    line = line.repartition(*by).sortWithinPartitions(*by, "__t", "__asks")
    n = len(by)

    def answer(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        group = np.cumsum(_changes(rows, n))
        asks = rows.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
        arrival = pc.fill_null(rows.column(n + 2), 0).to_numpy()
        decision, message = _sweep(group, asks, rows.column(n).to_numpy(), arrival, lookahead_ns)
        decision, message = pa.array(decision), pa.array(message)
        out = [rows.column(k).take(decision) for k in range(n - 1)] + [rows.column(n).take(decision), rows.column(n + 3).take(message)]
        return pa.Table.from_arrays(out, [*keys, "decision_time_ns", "future"]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < SWEEP_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = np.flatnonzero(_changes(rows, n))  # the last slot may go on
            if len(cut):
                yield from answer(rows.slice(0, int(cut[-1]))).to_batches()
                rows = rows.slice(int(cut[-1]))
            held = rows.to_batches()
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()

    schema = T.StructType([*[line.schema[k] for k in keys], T.StructField("decision_time_ns", T.LongType()), T.StructField("future", line.schema["__message"].dataType)])
    return line.mapInArrow(run, schema)


def _changes(rows: pa.Table, n: int) -> np.ndarray:
    """Whether a row's first n columns differ from those of the row before."""
    out = np.zeros(len(rows), bool)
    for k in range(n):
        value = rows.column(k).combine_chunks()
        value = value.chunk(0) if isinstance(value, pa.ChunkedArray) else value
        differs = pc.fill_null(pc.not_equal(value[1:], value[:-1]), False).to_numpy(zero_copy_only=False)
        nulls = value.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= differs | (nulls[1:] != nulls[:-1])
    return out


def match_messages(
    memberships: DataFrame,
    messages: DataFrame,
    *,
    policy: str = CAUSAL,
    max_age_ns: int,
    lookahead_ns: int = 0,
    slot_ns: int = DAY_NS,
    keys: list[str] = SOURCE_KEY,
) -> DataFrame:
    """Match each membership row; append source, age, flags and ``reason_code``.

    ``slot_ns`` bounds how many rows of one key share a task (see ``choose_slot_ns``); the
    search for future sources has slots as wide as the look-ahead. Messages must be unique
    per (key, source time): see ``duplicate_keys``.
    """
    _check(policy, max_age_ns, lookahead_ns)
    source, arrival = F.col("source_time_ns"), F.col("arrival_time_ns")
    facts = messages.select(
        *keys, "source_time_ns", "arrival_time_ns",
        F.struct(
            "source_time_ns", "arrival_time_ns", "empty_scene", "pose_valid",
            "pose_source_time_ns",
        ).alias("__message"),
    )
    usable = F.greatest(source, arrival - lookahead_ns)
    # one moment when sent and usable coincide, else one for each
    moment = lambda t, sent, use: F.struct(
        t.alias("t"), F.lit(sent).alias("sent"), F.lit(use).alias("use")
    )
    moments = F.when(usable == source, F.array(moment(source, True, True))).otherwise(
        F.array(moment(source, True, False), moment(usable, False, True))
    )
    seen = facts.withColumn("__m", F.explode(moments)).select(
        *keys, F.col("__m.t").alias("__t"), F.lit(0).alias("__kind"),
        F.when(F.col("__m.sent"), F.col("__message")).alias("__sent"),
        F.when(F.col("__m.use"), F.col("__message")).alias("__past"),
    )
    asked = memberships.select(
        "*", F.col("decision_time_ns").alias("__t"), F.lit(1).alias("__kind")
    )
    line = asked.unionByName(seen, allowMissingColumns=True)
    line = running(
        line, keys, ["__t", "__kind"], time_slot(F.col("__t"), slot_ns),
        [
            Running("past", F.col("__past"), "max"),
            Running("seen_before", F.col("__sent.source_time_ns"), "max"),
            Running("next_sent", F.col("__sent"), "min", reverse=True, include_current=False),
        ],
    )
    rows = line.filter("__kind = 1").select(
        *memberships.columns, "past", "seen_before", "next_sent",
        F.col("next_sent.source_time_ns").alias("seen_after"),
    )

    decision = F.col("decision_time_ns")
    limit = decision + lookahead_ns
    if policy == BUFFERED:
        # A future source can only win when it is closer than the newest past one.
        # Mostly the very next message has arrived in time and is the answer; only
        # decisions whose next message is late need the search.
        # Two branches read the decisions again, so they are written once.
        rows = stage(rows)
        past_gap = decision - F.col("past.source_time_ns")
        wanted = (F.col("seen_after") <= limit) & (
            F.col("past").isNull() | (F.col("seen_after") - decision < past_gap)
        )
        prompt = F.col("next_sent.arrival_time_ns") <= limit
        open_rows = rows.filter(wanted & ~prompt).select(*keys, "decision_time_ns")
        ahead = nearest_future(open_rows, facts.filter(arrival - lookahead_ns < source), keys, lookahead_ns)
        rows = rows.join(ahead, [*keys, "decision_time_ns"], "left")
        future = F.when(wanted & prompt, F.col("next_sent")).otherwise(F.col("future"))
        gain = future["source_time_ns"] - decision
        nearest = F.when(
            future.isNotNull() & (F.col("past").isNull() | (gain < past_gap)), future
        ).otherwise(F.col("past"))
    else:
        nearest = F.col("past")
    return classify(
        rows.withColumn("__found", nearest), memberships.columns,
        policy=policy, max_age_ns=max_age_ns, lookahead_ns=lookahead_ns,
    )


def classify(
    rows: DataFrame, columns: list[str], *, policy: str, max_age_ns: int, lookahead_ns: int
) -> DataFrame:
    """Turn a candidate and its surroundings into the reason for every row."""
    decision = F.col("decision_time_ns")
    limit = decision + lookahead_ns
    found = F.col("__found")
    age = decision - found["source_time_ns"]
    any_message = F.col("seen_before").isNotNull() | F.col("seen_after").isNotNull()
    near_past = decision - F.col("seen_before") <= max_age_ns
    near_next = (F.col("seen_after") <= limit) & (F.col("seen_after") - decision <= max_age_ns)
    no_candidate = (
        F.when(F.coalesce(near_past, F.lit(False)) | F.coalesce(near_next, F.lit(False)), "late")
        .when(F.col("seen_before").isNull() & (F.col("seen_after") > limit), "unmatched")
        .when(F.col("seen_before").isNotNull(), "stale")
        .otherwise("out_of_range")
    )
    expected = F.col("member") & F.col("message_expected") & any_message
    reason = (
        F.when(~F.col("member"), "not_member")
        .when(~expected, "missing_message")
        .when(found.isNull(), no_candidate)
        .when(F.abs(age) > max_age_ns, F.when(age > 0, "stale").otherwise("out_of_range"))
        .when(found["empty_scene"], "empty_scene")
        .when(~found["pose_valid"], "invalid_pose")
        .otherwise("matched")
    )
    matched = F.col("reason_code").isin("matched", "empty_scene", "invalid_pose")
    pose = F.when(F.col("source_matched") & found["pose_valid"], found["pose_source_time_ns"])
    return (
        rows.withColumn("reason_code", reason)
        .withColumn("source_matched", matched)
        .withColumn("pose_source_time_ns", pose)
        .select(
            *columns,
            expected.alias("message_present"),
            "source_matched",
            (F.col("reason_code") == "matched").alias("evidence_available"),
            "reason_code",
            F.lit(policy).alias("match_policy"),
            F.when(F.col("source_matched"), found["source_time_ns"]).alias("source_time_ns"),
            F.when(F.col("source_matched"), age).alias("match_age_ns"),
            F.lit(lookahead_ns).cast("bigint").alias("lookahead_buffer_ns"),
            "pose_source_time_ns",
            (decision - F.col("pose_source_time_ns")).alias("pose_age_ns"),
        )
    )


def reason_counts(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    return frames.groupBy(*(by or []), "reason_code").agg(F.count("*").alias("rows"))
