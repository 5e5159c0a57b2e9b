"""Stateful processors: rows wait in state until the watermark has passed them.

A micro-batch sets a timer per key, at its last due time. Until the watermark has passed
that time the rows wait, and then all that are due are handled in time order, so the work
is linear in rows and batch borders can't change a result. A second timer, when what the key
holds can't matter any more, takes it out of the state: a silent key leaves nothing behind
but, for matching without a bound on memory, its newest message.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATES = ("normal", "quarantined", "unknown")


def _ms(ns: int) -> int:
    """Timer time (milliseconds) at or after a nanosecond time."""
    return -(-int(ns) // 1_000_000)


def _opt(value):
    return None if pd.isna(value) else value


class SmoothProcessor(StatefulProcessor):
    """Smoothing with missing values held, and threshold labels."""

    ANSWER = ("decision_time_ns", "value", "ewma", "available", "previous_state", "current_state")

    def __init__(self, keys, alpha, threshold, initial, expire_after_ns):
        self.keys, self.alpha, self.threshold = keys, alpha, threshold
        self.initial, self.expire = initial, expire_after_ns

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time bigint, value double, reset boolean")
        self.memory = handle.getValueState("memory", "value double, label string, time bigint")

    def handleInputRows(self, key, rows, timerValues):
        due = 0
        for batch in rows:
            self.waiting.appendList([
                (int(t), _opt(v), bool(r))
                for t, v, r in zip(batch["decision_time_ns"], batch["value"], batch["reset"])
            ])
            due = max(due, _ms(batch["decision_time_ns"].max()))
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.waiting.get())
        ready = sorted((tuple(r) for r in held if _ms(r[0]) <= limit), key=lambda r: r[0])
        if not ready:
            if self._silent(limit):  # any row to come would start anew
                self.memory.clear()
            return
        rest = [tuple(r) for r in held if _ms(r[0]) > limit]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        value, label, last = (
            tuple(self.memory.get()) if self.memory.exists() else (None, "unknown", None)
        )
        out, (value, label, last) = self._walk(key, ready, value, label, last)
        self.memory.update((value, label, last))
        if self.expire is not None:
            self.handle.registerTimer(_ms(last + self.expire) + 1)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, *self.ANSWER])

    def _walk(self, key, ready, value, label, last):
        """Answers of one key's rows in time order, and its memory after them."""
        out = []
        for time, seen, reset in ready:
            silent = last is not None and self.expire is not None and time - last > self.expire
            if reset or silent:
                value, label = None, "unknown"
            last = time
            if reset:
                continue
            previous = label
            if seen is not None:
                start = self.initial if value is None else value
                value = seen if start is None else self.alpha * seen + (1 - self.alpha) * start
                label = "quarantined" if value >= self.threshold else "normal"
            else:
                label = "unknown"
            out.append((*key, time, seen, value, seen is not None, previous, label))
        return out, (value, label, last)

    def _silent(self, limit):
        """The watermark is further past the key's last row than its memory lasts."""
        if self.expire is None or not self.memory.exists():
            return False
        return limit * 1_000_000 - tuple(self.memory.get())[2] > self.expire

    def close(self):
        pass


def _dealt(rows, width):
    """Rows whose first ``width`` columns are a key, by key, in their order."""
    by: dict[tuple, list[tuple]] = {}
    for row in rows:
        by.setdefault(tuple(row[:width]), []).append(tuple(row[width:]))
    return by


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one element of a state list; row by row they would cost a conversion each."""
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(elements, columns) -> pd.DataFrame:
    """Rows of all elements in the order of their coming."""
    tables = [pa.ipc.open_stream(bytes(e[0])).read_all() for e in elements]
    return pa.concat_tables(tables).to_pandas() if tables else pd.DataFrame(columns=columns)


def _tuples(rows: pd.DataFrame):
    return zip(*[rows[c].tolist() for c in rows.columns])


def _store(state, rows: pd.DataFrame) -> None:
    """Replace what a state list holds."""
    state.put([_packed(rows)]) if len(rows) else state.clear()


class SmoothManyProcessor(SmoothProcessor):
    """:class:`SmoothProcessor` for many keys of one bucket: a call, a timer and a list in the
    state serve all of them. What it answers for each key is the same."""

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.memory = handle.getListState("memory", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        due = 0
        for batch in rows:
            self.waiting.appendList([_packed(batch[[*self.keys, "decision_time_ns", "value", "reset"]])])
            due = max(due, _ms(batch["decision_time_ns"].max()))
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit, n = expiredTimerInfo.getExpiryTimeInMs(), len(self.keys)
        held = _unpacked(self.waiting.get(), [*self.keys, "decision_time_ns", "value", "reset"])
        is_due = held["decision_time_ns"] <= limit * 1_000_000
        if is_due.any():
            _store(self.waiting, held[~is_due])
        elif self.expire is None:
            return
        # a value that is not a number stands for none, as a null does
        known = lambda v: None if v is None or v != v else v
        remembered = _unpacked(self.memory.get(), [*self.keys, "value", "label", "time"])
        memory = {k: (known(m[0][0]), *m[0][1:]) for k, m in _dealt(_tuples(remembered), n).items()}
        out = []
        for k, ready in _dealt(_tuples(held[is_due].sort_values("decision_time_ns", kind="stable")), n).items():
            answers, memory[k] = self._walk(k, [(t, known(v), r) for t, v, r in ready], *memory.get(k, (None, "unknown", None)))
            out += answers
        if self.expire is not None:  # any row to come of a silent key would start anew
            memory = {k: m for k, m in memory.items() if limit * 1_000_000 - m[2] <= self.expire}
        _store(self.memory, pd.DataFrame([(*k, *m) for k, m in memory.items()], columns=[*self.keys, "value", "label", "time"]).astype({"value": "float64"}))
        if self.expire is not None and memory:
            self.handle.registerTimer(max(_ms(min(m[2] for m in memory.values()) + self.expire) + 1, limit + 1))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, *self.ANSWER])


class MatchProcessor(StatefulProcessor):
    """As-of matching of decisions to the messages that arrived by their settling time.

    Messages lie in slots of time, by the earlier of source and arrival. A timer reads the
    slots up to the last decision's settling and folds those that are too old for any decision
    to come into one message, so a key's history is not read again. With ``forget_after_ns`` a
    key without rows for so long is forgotten altogether.
    """

    ITEMS = ("source", "arrival", "empty", "pose", "received")

    def __init__(self, keys, max_age_ns, lookahead_ns, wait_ns, forget_after_ns=None):
        self.keys, self.max_age = keys, max_age_ns
        self.lookahead, self.wait = lookahead_ns, wait_ns
        self.width = max(max_age_ns + lookahead_ns, 1_000_000_000)
        self.forget = forget_after_ns

    def init(self, handle):
        self.handle = handle
        self.decisions = handle.getListState(
            "decisions", "frame bigint, time bigint, member boolean, expected boolean")
        self.slots = handle.getMapState(
            "slots", "slot bigint",
            "source array<bigint>, arrival array<bigint>, empty array<boolean>, pose array<boolean>, received array<bigint>")
        self.index = handle.getValueState("index", "slots array<bigint>, received bigint, last bigint")
        self.newest = handle.getValueState(
            "newest", "source bigint, arrival bigint, empty boolean, pose boolean, received bigint")

    def handleInputRows(self, key, rows, timerValues):
        due = 0
        live, received, last = self._index()
        new: dict[int, list[tuple]] = {}
        idle = None
        for batch in rows:
            asked = batch[batch["is_decision"]]
            sent = batch[~batch["is_decision"].astype(bool)]
            if len(asked):
                self.decisions.appendList([
                    (int(f), int(t), bool(m), bool(e)) for f, t, m, e in zip(
                        asked["sync_frame_id"], asked["time_ns"], asked["member"],
                        asked["message_expected"])
                ])
                last = max(last, int(asked["time_ns"].max()))
                due = max(due, _ms(int(asked["time_ns"].max()) + self.lookahead + self.wait))
            for s, a, e, p in zip(
                sent["time_ns"], sent["arrival_ns"], sent["empty_scene"], sent["pose_valid"]
            ):
                item = (int(s), int(a), bool(e), bool(p), received)
                new.setdefault(min(item[0], item[1]) // self.width, []).append(item)
                received += 1
                idle = max(idle or 0, item[0], item[1])
        for slot, items in new.items():
            self._write(slot, self._read(slot) + items)
        if idle is not None:
            last = max(last, idle)
            # by then no decision to come can need the messages
            self.handle.registerTimer(_ms(idle + self.max_age + self.lookahead + self.wait) + 2)
        self.index.update((sorted({*live, *new}), received, last))
        if due:
            self.handle.registerTimer(due)
        if self.forget is not None:
            self.handle.registerTimer(_ms(last + self.forget) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit = expiredTimerInfo.getExpiryTimeInMs()
        settle = self.lookahead + self.wait
        live, received, last = self._index()
        held = [tuple(d) for d in self.decisions.get()]
        ready = sorted((d for d in held if _ms(d[1] + settle) <= limit), key=lambda d: d[1])
        rest = [d for d in held if _ms(d[1] + settle) > limit]
        old = self._old(rest, limit)
        # slots for the answers, and slots that begin before what still matters
        end = max([(d[1] + settle) // self.width for d in ready], default=-1)
        cached = {k: self._read(k) for k in live if k <= end or k * self.width < old}
        if ready:
            newest = [tuple(self.newest.get())] if self.newest.exists() else []
            messages = sorted([*newest, *(m for items in cached.values() for m in items)], key=lambda m: m[4])
            out = [(*key, *answer) for answer in self._settle(ready, messages)]
            if rest:
                self.decisions.put(rest)
            else:
                self.decisions.clear()
        self._fold({k: v for k, v in cached.items() if k * self.width < old}, old, live, received, last)
        if self.forget is not None and not rest and limit * 1_000_000 - last > self.forget:
            for state in (self.slots, self.index, self.newest):
                state.clear()
        if not ready:
            return
        yield self._frame(out)

    def _frame(self, out):
        names = list(self.keys) + [
            "sync_frame_id", "decision_time_ns", "source_time_ns", "match_age_ns",
            "message_present", "reason_code"]
        columns = dict(zip(names, zip(*out)))
        for c in ("source_time_ns", "match_age_ns"):  # never by way of doubles
            columns[c] = pd.array(columns[c], dtype="Int64")
        return pd.DataFrame(columns)

    def _old(self, rest, limit):
        """Messages before this time are too old for every decision to come: those lie after
        the timer's time less the settling."""
        horizon = limit * 1_000_000 - self.lookahead - self.wait
        return min([horizon, *(d[1] for d in rest)]) - self.max_age - 1_000_000

    def _fold(self, cached, old, live, received, last):
        """Of the messages that are too old, only the newest can change an answer."""
        stale = [tuple(self.newest.get())] if self.newest.exists() else []
        gone = set()
        for slot, items in cached.items():
            left = [m for m in items if m[0] >= old or m[1] >= old]
            if len(left) < len(items):
                stale += [m for m in items if m[0] < old and m[1] < old]
                if left:
                    self._write(slot, left)
                else:
                    self.slots.removeKey((slot,))
                    gone.add(slot)
        if stale:
            self.newest.update(max(stale))
        if gone:
            self.index.update(([k for k in live if k not in gone], received, last))

    def _index(self):
        """Slots in use, messages received so far, time of the latest row."""
        if not self.index.exists():
            return [], 0, 0
        slots, received, last = tuple(self.index.get())
        return list(slots), received, last

    def _read(self, slot):
        value = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else None
        return list(zip(*value)) if value is not None else []

    def _write(self, slot, items):
        self.slots.updateValue((slot,), tuple(list(c) for c in zip(*items)))

    def _settle(self, decisions, messages):
        """Answers of decisions in time order, by one sweep over the arrivals.

        ``usable`` holds the sources that arrived within the look-ahead, ``seen`` those that
        arrived until the settling, both sorted; equal sources keep their order of receipt.
        """
        arrivals = sorted((m[1], n) for n, m in enumerate(messages))
        usable, seen = [], []
        near = far = 0
        for frame, time, member, expected in decisions:
            limit = time + self.lookahead
            while far < len(arrivals) and arrivals[far][0] <= limit + self.wait:
                n = arrivals[far][1]
                insort(seen, (messages[n][0], n))
                far += 1
            while near < len(arrivals) and arrivals[near][0] <= limit:
                n = arrivals[near][1]
                insort(usable, (messages[n][0], n))
                near += 1
            reason, best = self._answer(time, limit, member, expected, usable, seen, messages)
            present = reason not in ("not_member", "missing_message")
            yield frame, time, best, None if best is None else time - best, present, reason

    def _answer(self, time, limit, member, expected, usable, seen, messages):
        if not member:
            return "not_member", None
        if not expected or not seen:
            return "missing_message", None
        after = bisect_right(usable, (time, len(messages)))
        sources = [usable[k][0] for k in (after - 1, after) if 0 <= k < len(usable) and usable[k][0] <= limit]
        if sources:
            source = min(sources, key=lambda s: (abs(time - s), s > time))
            best = messages[usable[bisect_left(usable, (source, -1))][1]]
            age = time - source
            if abs(age) > self.max_age:
                return ("stale" if age > 0 else "out_of_range"), None
            return ("empty_scene" if best[2] else "matched" if best[3] else "invalid_pose"), source
        close = bisect_left(seen, (time - self.max_age, -1))
        if close < len(seen) and seen[close][0] <= min(limit, time + self.max_age):
            return "late", None
        if seen[0][0] > limit:
            return "unmatched", None
        return ("stale" if seen[0][0] < time else "out_of_range"), None

    def close(self):
        pass


class MatchManyProcessor(MatchProcessor):
    """:class:`MatchProcessor` for many keys of one bucket: a call, a timer and a list in the
    state serve all of them. What it answers for each key is the same.

    Messages stay in the order of their receipt. A timer reads the bucket's messages, which are
    those of the settling and the age, and of each key the newest of those that are too old; the
    others leave the state then.
    """

    ASKED = ("sync_frame_id", "time_ns", "member", "message_expected")
    SENT = ("time_ns", "arrival_ns", "empty_scene", "pose_valid")

    def __init__(self, keys, max_age_ns, lookahead_ns, wait_ns):
        super().__init__(keys, max_age_ns, lookahead_ns, wait_ns)

    def init(self, handle):
        self.handle = handle
        self.decisions = handle.getListState("decisions", "rows binary")
        self.messages = handle.getListState("messages", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        settle = self.lookahead + self.wait
        due = idle = 0
        for batch in rows:
            is_asked = batch["is_decision"].astype(bool)
            asked, sent = batch[is_asked], batch[~is_asked]
            if len(asked):
                flags = {c: bool for c in self.ASKED[2:]}
                self.decisions.appendList([_packed(asked[[*self.keys, *self.ASKED]].astype(flags))])
                due = max(due, _ms(int(asked["time_ns"].max()) + settle))
            if len(sent):
                flags = {c: bool for c in self.SENT[2:]}
                self.messages.appendList([_packed(sent[[*self.keys, *self.SENT]].astype(flags))])
                latest = int(max(sent["time_ns"].max(), sent["arrival_ns"].max()))
                # by then no decision to come can need the messages
                idle = max(idle, _ms(latest + self.max_age + settle) + 2)
        for timer in {due, idle} - {0}:
            self.handle.registerTimer(timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        limit, n = expiredTimerInfo.getExpiryTimeInMs(), len(self.keys)
        held = _unpacked(self.decisions.get(), [*self.keys, *self.ASKED])
        is_due = held["time_ns"] + (self.lookahead + self.wait) <= limit * 1_000_000
        rest = held[~is_due]
        sent = _dealt(_tuples(_unpacked(self.messages.get(), [*self.keys, *self.SENT])), n)
        out = []
        for k, ready in _dealt(_tuples(held[is_due].sort_values("time_ns", kind="stable")), n).items():
            messages = [(*m, i) for i, m in enumerate(sent.get(k, ()))]
            out += [(*k, *answer) for answer in self._settle(ready, messages)]
        if is_due.any():
            _store(self.decisions, rest)
        waiting = _dealt(_tuples(rest), n)
        kept, before = [], 0
        for k, messages in sent.items():
            old = self._old(waiting.get(k, ()), limit)
            newest = max((m for m in messages if m[0] < old and m[1] < old), default=None)
            kept += [(*k, *m) for m in messages if m[0] >= old or m[1] >= old or m is newest]
            before += len(messages)
        if len(kept) < before:
            _store(self.messages, pd.DataFrame(kept, columns=[*self.keys, *self.SENT]))
        if out:
            yield self._frame(out)
