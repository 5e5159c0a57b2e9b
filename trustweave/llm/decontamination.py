"""Benchmark passages in documents, within an edit distance, by CGK embedding and LSH.

Texts are sequences of words (lower-cased runs of letters and digits; in scripts that set no
spaces each character is a word), and the distance counts words inserted, deleted or
replaced. The CGK embedding walks over a sequence and
stays on a word or steps on by a random bit of that word and step; two sequences that
differ by few edits fall into step again, so their walks agree at most steps: edit
distance has become Hamming distance. Bit sampling then hashes the words read at a few
steps; ``repeats`` walks with their own randomness are hashed for every word of every
document, and for every place in every item where the sampled steps fit. Equal hashes
name a window of the item's size around the hit.

Each such window is verified exactly: the least edit distance of the item to any passage
there (bit-parallel dynamic programming), which must not pass ``1 - similarity`` of the
item's words. So results have no false hit; ``recall`` of the search is measured in the
tests at the largest allowed distance.

Plan: one scan and one map; documents are never shuffled. Items are a query set: blocks of
at most ``BLOCK_WORDS`` words are broadcast, each in a pass over all documents.

Items of ``min_exact`` to ``min_words`` - 1 words allow no sampled walk; they are looked up whole,
by a hash of all their words, and match verbatim only.

Defined cases: null or empty texts hold no passage; items of fewer than ``min_exact`` words
are no evidence and match nothing; equal items are all reported; repeated documents and
rows with null ids are judged alike, each on its own; passages don't span rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trustweave.llm.batches import name, with_text_columns
from trustweave.llm.text import NOT_ALNUM, chunks, constants, windows, words

#: Words of the items that one broadcast may hold (about 200 bytes each with all hashes).
BLOCK_WORDS = 200_000
HITS = "array<struct<item_id:bigint,start_word:int,end_word:int,distance:int,n_words:int>>"


#: Scripts without spaces between words.
_UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_UNSPACED_JAVA = _UNSPACED.replace("\\p{", "\\p{Is")
_UNSPACED_LEADS = np.zeros(256, bool)
_UNSPACED_LEADS[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True


def spaced(column: pa.Array) -> pa.Array:
    """The texts, with spaces around each character of a script that sets none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data = column.buffers()[2]
    if data is None or not _UNSPACED_LEADS[np.frombuffer(data, np.uint8)].any():
        return column
    return pc.replace_substring_regex(column, _UNSPACED, r" \0 ")


class Walks:
    """The embedding's walks and the steps that each repeat samples."""

    def __init__(self, repeats: int, steps: int = 12, samples: int = 5, distinct: int = 4):
        self.steps, self.distinct = steps, distinct
        self.factors = constants(repeats, 31)
        # the first step and others spread over the walk, by repeat
        self.sampled = [sorted({0} | {1 + int(c % np.uint64(steps - 1)) for c in constants(3 * samples, 32 + r)[: samples - 1]} | {steps - 1 - r % 3}) for r in range(repeats)]
        self.fold = constants(steps, 33)

    def hashes(self, values: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a walk from each place: the sampled words' hash, the last place, and how many
        different places were sampled. The sequence is followed by zeros."""
        n = len(values)
        padded = np.concatenate([values, np.zeros(self.steps, np.uint64)]) * self.factors[repeat]
        at, key = np.arange(n), np.zeros(n, np.uint64)
        seen, last = np.zeros(n, np.int8), np.full(n, -1)
        for j in range(self.sampled[repeat][-1] + 1):
            word = padded.take(at)
            if j in self.sampled[repeat]:
                key += word * self.fold[j]
                seen += at != last
                last = at.copy()
            at += ((word >> np.uint64(40 + j)) & np.uint64(1)).astype(np.int64)
        return key, last, seen

    def keys(self, padded: np.ndarray, n: int, repeat: int) -> tuple[np.ndarray, np.ndarray]:
        """Only the hashes and last places, for many words at once."""
        padded = padded * self.factors[repeat]
        at, key = np.arange(n), np.zeros(n, np.uint64)
        sampled = set(self.sampled[repeat])
        for j in range(self.sampled[repeat][-1] + 1):
            word = padded.take(at)
            if j in sampled:
                key += word * self.fold[j]
            if j < self.sampled[repeat][-1]:
                at += ((word >> np.uint64(40 + j)) & np.uint64(1)).view(np.int64)
        return key, at


def edit_ends(item: dict[int, int], n: int, text: Sequence[int]) -> tuple[int, int]:
    """Least distance of the item to any passage of ``text``, and where the first such ends.

    ``item`` has for each of its words the bits of its places. All n rows of a column of
    the table are the bits of two integers.
    """
    full = (1 << n) - 1
    up, down, score, top = full, 0, n, 1 << (n - 1)
    best, end = n, 0
    for k, word in enumerate(text):
        eq = item.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(xh | up)) & full, up & xh
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full
        up, down = (less | ~(xv | more)) & full, more & xv
        if score < best:
            best, end = score, k + 1
    return best, end


class Index:
    """Hashes of some items, and the exact check."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, repeats: int, min_words: int, min_exact: int = 3):
        self.walks = Walks(repeats)
        self.items = []
        exact: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by number of words: hash, item
        entries: list[list[np.ndarray]] = [[] for _ in range(repeats)]
        texts = spaced(pa.array([t.lower() for _, t in items], pa.large_string()))
        for t in chunks(texts):
            found = words(t, NOT_ALNUM)
            bounds = np.searchsorted(found.row, np.arange(t.n + 1))
            for r in range(t.n):
                own = found.hash[bounds[r]:bounds[r + 1]]
                n = len(own)
                if n < min_words:
                    if n >= max(1, min_exact):
                        exact[n].append((int(windows(own, np.zeros(n), n, n)[0][0]), items[t.first + r][0]))
                    continue
                number, values = len(self.items), own.tolist()
                self.items.append((items[t.first + r][0], n, int((1 - similarity) * n + 1e-9), set(values), _places(values), _places(values[::-1])))
                for k in range(repeats):
                    key, last, seen = self.walks.hashes(own, k)
                    ok = np.flatnonzero((last < n) & (seen >= min(self.walks.distinct, n)))
                    entries[k].append(np.stack([key[ok], np.full(len(ok), number, np.uint64), ok.astype(np.uint64)], 1))
        self.exact = {}
        for n, pairs in exact.items():
            pairs.sort(key=lambda p: p[0])
            self.exact[n] = (np.array([p[0] for p in pairs], np.uint64), [p[1] for p in pairs])
        self.keys, self.numbers, self.offsets, self.maps = [], [], [], []
        for per_repeat in entries:
            table = np.concatenate(per_repeat) if per_repeat else np.zeros((0, 3), np.uint64)
            table = table[np.argsort(table[:, 0], kind="stable")]
            bits = np.zeros(1 << 20, bool)
            bits[(table[:, 0] >> np.uint64(44)).astype(np.int64)] = True
            self.keys.append(table[:, 0].copy())
            self.numbers.append(table[:, 1].astype(np.int64))
            self.offsets.append(table[:, 2].astype(np.int64))
            self.maps.append(bits)

    def candidates(self, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of the item's window, item and row of each hit; walks stay in their row."""
        n = len(values)
        padded = np.concatenate([values, np.zeros(self.walks.steps, np.uint64)])
        starts, numbers, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        row_ends = np.searchsorted(row, row, "right") if n else row
        for k in range(len(self.keys)):
            key, last = self.walks.keys(padded, n, k)
            at = np.flatnonzero(self.maps[k][(key >> np.uint64(44)).view(np.int64)] & (last < row_ends))
            low, high = np.searchsorted(self.keys[k], key[at], "left"), np.searchsorted(self.keys[k], key[at], "right")
            count = high - low
            hit = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            starts.append(np.repeat(at, count) - self.offsets[k][hit])
            numbers.append(self.numbers[k][hit])
            rows.append(np.repeat(row[at], count))
        return np.concatenate(starts), np.concatenate(numbers), np.concatenate(rows)

    def hits(self, column: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(column))]
        if not self.items and not self.exact:
            return out
        for t in chunks(spaced(column)):
            found = words(t, NOT_ALNUM)
            if not len(found.hash):
                continue
            bounds = np.searchsorted(found.row, np.arange(t.n + 1))
            for row, hit in self._whole(found.hash, found.row, bounds):
                out[t.first + row].append(hit)
            if not self.items:
                continue
            starts, numbers, rows = self.candidates(found.hash, found.row)
            # a start may lie before its row, if the passage's head is missing
            order = np.lexsort((starts, numbers))
            regions: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for s, number, row in zip(starts[order].tolist(), numbers[order].tolist(), rows[order].tolist()):
                _, n, most, *_ = self.items[number]
                low, high = max(bounds[row], s - most), min(bounds[row + 1], s + n + most)
                if high - low < n - most:
                    continue
                merged = regions[row, number]
                if merged and low <= merged[-1][1] and high - merged[-1][0] <= 4 * (n + most):
                    merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
                else:
                    merged.append((low, high))
            for (row, number), parts in regions.items():
                best = self._best(number, found.hash, parts, bounds[row])
                if best:
                    out[t.first + row].append(best)
        return out

    def _whole(self, values: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> list[tuple[int, dict]]:
        """(row, hit) of each short item that a row holds verbatim, at its first place."""
        out = []
        for n, (keys, ids) in self.exact.items():
            hashed, at = windows(values, row, n, n)
            low, high = np.searchsorted(keys, hashed, "left"), np.searchsorted(keys, hashed, "right")
            seen = set()
            for k in np.flatnonzero(high > low).tolist():
                place, own = int(at[k]), int(row[at[k]])
                for i in range(low[k], high[k]):
                    if (own, i) not in seen:
                        seen.add((own, i))
                        start = place - int(bounds[own])
                        out.append((own, {"item_id": ids[i], "start_word": start, "end_word": start + n, "distance": 0, "n_words": n}))
        return out

    def _best(self, number: int, values: np.ndarray, parts: list[tuple[int, int]], first: int) -> dict | None:
        item_id, n, most, distinct, forward, backward = self.items[number]
        best: tuple[int, int, int] | None = None
        for low, high in parts:
            window = values[low:high].tolist()
            if len(distinct) - len(distinct.intersection(window)) > most:
                continue
            distance, end = edit_ends(forward, n, window)
            if distance <= most and (best is None or distance < best[0]):
                _, length = edit_ends(backward, n, window[:end][::-1])
                best = (distance, low + end - length, low + end)
                if distance == 0:
                    break
        if best is None:
            return None
        return {"item_id": item_id, "start_word": int(best[1] - first), "end_word": int(best[2] - first), "distance": best[0], "n_words": n}


def _places(values: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, v in enumerate(values):
        out[v] = out.get(v, 0) | 1 << k
    return out


def find_passages(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", columns: Sequence[str] | None = None, item_id: str = "item_id", item_text: str = "text",
    similarity: float = 0.8, repeats: int = 6, min_words: int = 8, min_exact: int = 3,
) -> DataFrame:
    """Append ``hits`` to ``columns`` (default: all): the closest passage of each item found,
    with its word places (end exclusive), distance and the item's number of words."""
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() != "hits"]
    items = benchmark.select(name(item_id).cast("long").alias("id"), name(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    n_words = F.size(F.split(F.col("text"), r"[^\p{L}\p{N}]+")) + F.regexp_count(F.col("text"), F.lit(_UNSPACED_JAVA))
    blocks = max(1, -(-(items.agg(F.sum(n_words)).first()[0] or 0) // BLOCK_WORDS))
    lower = F.lower(name(text).cast("string"))
    rows = docs.select(*[name(c) for c in kept], lower.alias("__lower"))
    hashed = F.pmod(F.xxhash64("text"), F.lit(blocks))
    for b in range(blocks):
        block = [(r["id"], r["text"]) for r in items.where(hashed == b).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, similarity, repeats, min_words, min_exact))

        def make(shared=shared):
            index = shared.value
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("distance", pa.int32()), ("n_words", pa.int32())]))
            return lambda column: [pa.array(index.hits(column), kind)]

        carried = [*kept, *[f"__hits{k}" for k in range(b)], *["__lower"] * (b < blocks - 1)]
        rows = with_text_columns(rows, make, f"__hits{b} {HITS}", text="__lower", columns=carried)
    found = reduce(lambda x, y: F.concat(x, y), [F.col(f"__hits{b}") for b in range(blocks)])
    return rows.select(*[name(c) for c in kept], found.alias("hits"))
