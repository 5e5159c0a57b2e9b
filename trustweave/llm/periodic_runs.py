"""Runs of repeated word sequences in texts, and the texts with each run cut to one period.

A run is a stretch of words with smallest period q, of at least ``least`` words and
``exponent`` periods, that no neighbouring word extends. Words are runs of bytes other
than ASCII white space. Method: online dyadic square catching.

* For each k the words fall into blocks of 2**k. A completed block is a catcher: it waits
  for the suffixes that end at later appended words, at a distance q of 2**k to
  2**(k+1) - 1. An appended word advances one comparison per k, since exactly one block
  lies at that distance of its suffix; the comparison reads words up to that one only.
  Suffixes are compared by hashes that double with k.
* A caught suffix is a square's evidence. Catches of neighbouring blocks at the same
  distance are one chain. A run of four periods holds two neighbouring blocks at least, so
  single catches are let go; a chain is widened word by word, exactly, by less than a block
  to each side, and reported once as a run if it is long enough.
* Shorter periods come first. A chain within a run already reported has that run's period,
  so it is no run of its own: texts of one repeated word stay near linear.

The work is O(n log n) for n words, at most a few chains being widened for each block; the
memory is O(n) for one text. All words of a batch are appended together; results depend on
each text alone. Nothing is shuffled: a task reads its rows once, and a lost one is redone.

Defined cases: a null or empty text has no words and no run; a row's other columns are
carried, and one named like a result is replaced; repeated rows are judged each on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from trustweave.llm.batches import name, slices, small_batches
from trustweave.llm.text import SPACE, chunks, constants, mix, words

#: Columns that ``find_runs`` adds.
ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_LEFT, _RIGHT = constants(2, 31)


def _chains(hashed: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block's start, last block's start, period) of catches by two blocks or more."""
    size = 1 << k
    at = np.arange(len(hashed))  # where an appended word's suffix of 2**k words begins
    block = ((at >> k) - 1) << k
    at, block = at[size:], block[size:]
    caught = (hashed[at] == hashed[block]) & (row[block] == row[at + size - 1])
    at, block = at[caught], block[caught]
    period = at - block
    order = np.lexsort((block, period))
    block, period = block[order], period[order]
    joined = np.zeros(len(block) + 1, bool)  # to the catch before
    joined[1:-1] = (period[1:] == period[:-1]) & (block[1:] - block[:-1] == size)
    heads = np.flatnonzero(~joined[:-1] & joined[1:])
    ends = np.flatnonzero(joined[:-1] & ~joined[1:])
    return block[heads], block[ends], period[heads]


def runs_of(values: np.ndarray, row: np.ndarray, bounds: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in rows of words; places count over all rows."""
    found: list[tuple[int, int, int]] = []
    longest = int(np.diff(bounds).max(initial=0))
    hashed, k = values, 0
    while exponent << k <= longest:
        size = 1 << k
        first, last, period = _chains(hashed, row, k)
        if len(first) and found:  # within a run of a shorter period
            known = np.array(sorted(found))
            reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
            place = np.searchsorted(known[:, 0], first, "right") - 1
            inside = (place >= 0) & (reach[place] >= last + size + period)
            first, last, period = first[~inside], last[~inside], period[~inside]
        for a, b, q in zip(first.tolist(), last.tolist(), period.tolist()):
            low = max(int(bounds[row[a]]), a - size)
            high = min(int(bounds[row[a] + 1]) - q, b + 2 * size)
            differ = np.flatnonzero(values[low:high] != values[low + q:high + q]) + low
            cut = int(np.searchsorted(differ, a))
            start = int(differ[cut - 1]) + 1 if cut else low
            end = int(differ[cut]) if cut < len(differ) else high
            if end >= b + size and end - start + q >= max(least, exponent * q):
                found.append((start, end - start + q, q))
        k += 1
        half = size
        hashed = mix(hashed[:-half] * _LEFT + hashed[half:] * _RIGHT)
    return sorted(found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Truth values of n words: false where a run repeats its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def find_runs(
    docs: DataFrame, *, text: str = "text", columns: Sequence[str] | None = None, least: int = 6, exponent: int = 4,
    order_key: str | None = None, order: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """Append n_words, runs (by start, then period) and the collapsed text (kept words, one
    space between).

    ``exponent`` is a whole number of 4 or more. With ``order``, the words of a row are first
    put in the order that ``order(order_key's value, number of words)`` gives (None: as they
    are). ``columns`` are carried (default: all).
    """
    if exponent < 4:
        raise ValueError("two neighbouring blocks are certain for four periods or more")
    small_batches(docs.sparkSession)
    fields = T.StructType.fromDDL(ADDED).fields
    new = {f.name.lower() for f in fields}
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in new]
    key = [name(order_key).cast("long")] if order else []
    rows = docs.select(*[name(c) for c in kept], *key, name(text).cast("string"))
    place = len(rows.columns) - 1
    added = [pa.int64(), pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")])), pa.string()]

    def one(column: pa.Array, keys: list | None) -> list[pa.Array]:
        counts: list[int] = []
        runs: list[list[dict]] = []
        collapsed: list[str] = []
        for t in chunks(column):
            w = words(t, SPACE)
            n = w.counts(t.n)
            bounds = np.concatenate([[0], np.cumsum(n)])
            values, moved = w.hash, {}
            for i in range(t.n) if order else ():
                index = order(keys[t.first + i], int(n[i]))
                if index is not None:
                    moved[i] = index
                    values = values.copy() if len(moved) == 1 else values
                    values[bounds[i]:bounds[i + 1]] = w.hash[bounds[i] + index]
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(t.n)]
            for start, length, period in runs_of(values, w.row, bounds, least, exponent):
                i = int(w.row[start])
                found[i].append((start - int(bounds[i]), length, period))
            raw = t.data.tobytes()
            for i in range(t.n):
                own = raw[t.bounds[i]:t.bounds[i + 1]].split()
                if i in moved:
                    own = [own[j] for j in moved[i].tolist()]
                if found[i]:
                    own = [own[j] for j in np.flatnonzero(kept_words(len(own), found[i])).tolist()]
                collapsed.append(b" ".join(own).decode("utf-8", "replace"))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found[i]])
            counts += n.tolist()
        return [pa.array(v, kind) for v, kind in zip((counts, runs, collapsed), added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                part = batch.slice(low, high - low)
                made = one(part.column(place), part.column(place - 1).to_pylist() if order else None)
                out = [*part.columns[:len(kept)], *made]
                yield pa.RecordBatch.from_arrays(out, [str(i) for i in range(len(out))])

    # numbered names inside, so that no name clashes on the way
    placed = [*rows.schema.fields[:len(kept)], *fields]
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(placed)])
    out = rows.toDF(*[str(i) for i in range(len(rows.columns))]).mapInArrow(run, schema)
    return out.toDF(*kept, *[f.name for f in fields])
