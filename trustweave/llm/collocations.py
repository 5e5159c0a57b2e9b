"""Phrases of two or three words that occur together more than their parts would suggest.

Counting is a truncated suffix tree, built piece by piece in the manner of ERA:

1. Vertical partitioning. Words are counted; the first words of suffixes, in a fixed number
   of bins by hash, are packed into groups of at most ``budget`` suffixes. A bin beyond the
   budget has its prefix extended by the second word, and a pair of words that alone exceeds
   it (found by bounded heavy-hitter tables) by the third.
2. Subtrees. A suffix is cut to three words. Each task sorts the suffixes of its own texts,
   counts equal ones, and sends each group a small trie as one binary row: equal prefixes are
   written once. Each group merges its tries on its own, whatever other groups do.
3. Leaf totals. A node's count is the total of the leaves below it. Nodes of ``min_count``
   occurrences go on; those of an extended pair are partial and are added up once more.

The rest is joins among frequent phrases, whose number is bounded by the corpus divided by
``min_count``. Words are 64-bit hashes that include the language, and become text again by a
join at the end. No group holds more than its tries: pending suffixes are merged whenever a
few million have come. Nothing is broadcast but the tables of bins and of extended pairs,
both of a fixed size.

A phrase's score is floor(1000000 a a / (l r)) at its worst cut into a left part with l and a
right part with r occurrences (ties: the leftmost), in exact decimals. A phrase of two words
is dropped if a frequent phrase of three holds it and has at least ``absorb`` percent of its
occurrences.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows
count each time; other columns are not looked at; without words the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trustweave.llm.batches import name, slices, small_batches
from trustweave.llm.staging import staged
from trustweave.llm.text import Texts, byte_class, chunks, constants, mix, words

#: Suffixes of one group, about 32 bytes each in its task.
BUDGET = 500_000
#: Bins of first words; pairs that a task reports hold at least one in PAIR_SHARE of its pairs.
BINS, PAIR_SHARE = 1 << 16, 4096
#: Parts of an extended pair.
PAIR_PARTS = 64
#: Suffixes that a task sorts at once, and those that a group holds before it merges them.
FLUSH, MERGE = 1_000_000, 2_000_000
#: Parts of each language in the first round of the top list.
TOP_PARTS = 64

_SPLIT = byte_class(*b".,;:!?", range(0x0A, 0x0E))
_BREAK = _SPLIT | byte_class(0x20, 0x09)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_A, _B, _C = constants(3, 41)


class Tokens(NamedTuple):
    """Words of some rows: hash with language, and whether the next word, and the next but
    one, are in the same piece; the bytes they were read from."""

    hash: np.ndarray
    next: np.ndarray
    third: np.ndarray
    raw: bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def _tokens(texts: pa.Array, langs: list[str]) -> Iterator[Tokens]:
    known: dict[str, int] = {}
    for t in chunks(texts):
        t = Texts(_LOWER[t.data], t.bounds, t.first)
        w = words(t, _BREAK)
        own = langs[t.first:t.first + t.n]
        for x in own:
            if x not in known:
                known[x] = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest())
        hashed = mix(w.hash ^ np.array([known[x] for x in own], np.uint64)[w.row]) if len(w.hash) else w.hash
        piece = np.cumsum(_SPLIT[t.data])[w.start] if len(w.hash) else w.start
        near = np.zeros(len(hashed), bool)
        near[:-1] = (w.row[1:] == w.row[:-1]) & (piece[1:] == piece[:-1])
        after = np.zeros(len(hashed), bool)
        after[:-1] = near[:-1] & near[1:]
        yield Tokens(hashed, near, after, t.data.tobytes(), w.start, w.end, w.row + t.first)


def _batches(make: Callable) -> Callable:
    """A function of (texts, languages) slices, as one of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for low, high in slices(batch.column(1)):
                    part = batch.slice(low, high - low)
                    yield part.column(1), part.column(0).to_pylist()

        yield from make(parts())

    return run


def _same(*keys: np.ndarray) -> np.ndarray:
    """Starts of groups of equal rows in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


_WORDS = "pair boolean, h long, h2 long, lang string, word string, f long"


def _count_words(parts) -> Iterator[pa.RecordBatch]:
    """Words of each slice with their counts; at the end the most frequent pairs."""
    pairs, total = np.zeros((3, 0), np.uint64), 0
    for texts, langs in parts:
        tokens = list(_tokens(texts, langs))
        hashed = np.concatenate([t.hash for t in tokens]) if tokens else np.zeros(0, np.uint64)
        if not len(hashed):
            continue
        unique, place, times = np.unique(hashed, return_index=True, return_counts=True)
        first = np.cumsum([0, *[len(t.hash) for t in tokens]])
        of = np.searchsorted(first, place, "right") - 1
        place = place - first[of]
        text, lang = [], []
        for k, t in enumerate(tokens):
            at = place[of == k]
            text += [t.raw[a:b] for a, b in zip(t.start[at].tolist(), t.end[at].tolist())]
            lang += [langs[r] for r in t.row[at].tolist()]
        order = np.argsort(of, kind="stable")
        unique, times = unique[order], times[order]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.zeros(len(unique), bool)), pa.array(unique.view(np.int64)), pa.array(np.zeros(len(unique), np.int64)),
            pa.array(lang, pa.string()), pa.array(text, pa.binary()).cast(pa.string()), pa.array(times.astype(np.int64)),
        ], [c.split()[0] for c in _WORDS.split(", ")])
        left = np.concatenate([t.hash[t.next] for t in tokens])
        right = np.concatenate([t.hash[1:][t.next[:-1]] for t in tokens])
        pairs = np.concatenate([pairs, np.stack([left, right, np.ones(len(left), np.uint64)])], axis=1)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        heads = _same(pairs[0], pairs[1])
        if len(heads):
            pairs = np.stack([pairs[0, heads], pairs[1, heads], np.add.reduceat(pairs[2], heads)])
        total += len(left)
        pairs = pairs[:, pairs[2] * np.uint64(PAIR_SHARE) >= np.uint64(total)]
    n = pairs.shape[1]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.ones(n, bool)), pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64)), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(pairs[2].astype(np.int64)),
    ], [c.split()[0] for c in _WORDS.split(", ")])


class Groups(NamedTuple):
    """Where suffixes go: the first group of each bin, its parts by second word, and the
    extended pairs' hashes, sorted."""

    base: np.ndarray
    parts: np.ndarray
    pairs: np.ndarray

    def of(self, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
        """Groups of suffixes; those of extended pairs are below zero."""
        cell = (h1 >> np.uint64(48)).astype(np.int64)
        group = self.base[cell] + (mix(h2) % self.parts[cell].astype(np.uint64)).astype(np.int64)
        if len(self.pairs):
            pair = _pair(h1, h2)
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            wide = self.pairs[place] == pair
            group[wide] = -1 - (place[wide] * PAIR_PARTS + (mix(h3[wide]) % np.uint64(PAIR_PARTS)).astype(np.int64))
        return group


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h1 * _A + h2 * _B)


def pack_groups(load: np.ndarray, pairs: np.ndarray, budget: int) -> Groups:
    """Neighbouring bins share a group while their load is within the budget."""
    base, parts = np.zeros(BINS, np.int64), np.maximum(1, -(-load // budget))
    group, held = 0, 0
    for cell, now in enumerate(load.tolist()):
        if held and held + now > budget:
            group, held = group + 1, 0
        base[cell], held = group, held + now
        if parts[cell] > 1:
            group, held = group + int(parts[cell]), 0
    return Groups(base, parts, np.sort(pairs))


def _pack(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted distinct suffixes as a trie: each prefix once, with its number of children."""
    two, one = _same(h1, h2), _same(h1)
    children = np.diff(np.append(np.searchsorted(two, one), len(two))).astype(np.int32)
    leaves = np.diff(np.append(two, len(h1))).astype(np.int32)
    head = np.array([len(one), len(two), len(h1)], np.int64)
    return b"".join(x.tobytes() for x in (head, h1[one], children, h2[two], leaves, h3, times.astype(np.int32)))


def _unpack(blob: bytes) -> np.ndarray:
    """Rows (first, second, third word, times)."""
    n1, n2, n3 = np.frombuffer(blob, np.int64, 3)
    at, out = 24, []
    for n, kind in ((n1, np.uint64), (n1, np.int32), (n2, np.uint64), (n2, np.int32), (n3, np.uint64), (n3, np.int32)):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    h1, children, h2, leaves, h3, times = out
    return np.stack([np.repeat(np.repeat(h1, children), leaves), np.repeat(h2, leaves), h3, times.astype(np.uint64)])


def _merged(rows: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Distinct suffixes in order, with their times added; ``first`` sorts before them."""
    keys = (rows[2], rows[1], rows[0]) if first is None else (rows[2], rows[1], rows[0], first)
    order = np.lexsort(keys)
    rows, first = rows[:, order], None if first is None else first[order]
    heads = _same(rows[0], rows[1], rows[2])
    if not len(heads):
        return rows, first
    times = np.add.reduceat(rows[3], heads)
    rows = rows[:, heads]
    rows[3] = times
    return rows, None if first is None else first[heads]


def _send_tries(groups: Groups) -> Callable:
    def make(parts) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held, axis=1)
            rows, group = _merged(rows, groups.of(rows[0], rows[1], rows[2]))
            bounds = [*_same(group).tolist(), len(group)]
            blobs = [_pack(*rows[:, a:b]) for a, b in zip(bounds, bounds[1:])]
            return pa.RecordBatch.from_arrays([pa.array(group[bounds[:-1]]), pa.array(blobs, pa.binary())], ["g", "trie"])

        held, n = [], 0
        for texts, langs in parts:
            for t in _tokens(texts, langs):
                at = np.flatnonzero(t.next)
                third = np.where(t.third[at], t.hash[np.minimum(at + 2, len(t.hash) - 1)], np.uint64(0))
                held.append(np.stack([t.hash[at], t.hash[at + 1], third, np.ones(len(at), np.uint64)]))
                n += len(at)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return _batches(make)


_NODES = "h1 long, h2 long, h3 long, a long"


def _leaf_totals(min_count: int) -> Callable:
    """Tries come sorted by group; nodes of each group go out."""

    def nodes(group: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, _ = _merged(np.concatenate(held, axis=1))
        heads = _same(rows[0], rows[1])
        pairs = np.stack([rows[0, heads], rows[1, heads], np.zeros(len(heads), np.uint64), np.add.reduceat(rows[3], heads)])
        for part in (pairs, rows[:, rows[2] != 0]):
            if group >= 0:
                part = part[:, part[3] >= min_count]
            for k in range(0, part.shape[1], 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(part[:, k:k + 100_000])], ["h1", "h2", "h3", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0
        for batch in batches:
            for group, trie in zip(batch.column(0).to_pylist(), batch.column(1)):
                if group != now:
                    if held:
                        yield from nodes(now, held)
                    now, held, n = group, [], 0
                held.append(_unpack(trie.as_py()))
                n += held[-1].shape[1]
                if n >= MERGE and n >= 2 * held[0].shape[1]:
                    held = [_merged(np.concatenate(held, axis=1))[0]]
                    n = held[0].shape[1]
        if held:
            yield from nodes(now, held)

    return run


def count_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 10, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, languages): every word (h, lang, word, f); phrases of two and three
    words (h1, h2, h3 or 0, a) of ``min_count`` occurrences or more, as the words' hashes; and
    all word occurrences (lang, n)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(name(lang).cast("string"), F.lit("und")).alias("lang"), name(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_batches(_count_words), _WORDS)
    counted = staged(counted.groupBy("pair", "h", "h2", "lang", "word").agg(F.sum("f").alias("f")), "prefixes")
    of = counted.where("NOT pair").select("h", "lang", "word", "f")
    languages = of.groupBy("lang").agg(F.sum("f").alias("n"))
    load = np.zeros(BINS, np.int64)
    for cell, f in of.groupBy(F.shiftrightunsigned("h", 48).alias("cell")).agg(F.sum("f")).collect():  # BINS rows at most
        load[cell] = f
    # at most 2 * PAIR_SHARE pairs can have such a count
    least = max(budget, int(load.sum()) // (2 * PAIR_SHARE))
    wide = np.array([(r.h, r.h2) for r in counted.where(F.col("pair") & (F.col("f") > least)).select("h", "h2").collect()], np.int64).reshape(-1, 2).view(np.uint64)
    groups = pack_groups(load, _pair(wide[:, 0], wide[:, 1]), budget)
    tries = rows.mapInArrow(_send_tries(groups), "g long, trie binary").repartition("g").sortWithinPartitions("g")
    nodes = tries.mapInArrow(_leaf_totals(min_count), _NODES)
    phrases = nodes.groupBy("h1", "h2", "h3").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    return of, staged(phrases, "phrases"), languages


def _score(a: str, left: str, right: str):
    return F.expr(f"CAST(CAST(1000000 AS DECIMAL(38, 0)) * {a} * {a} DIV (CAST({left} AS DECIMAL(38, 0)) * {right}) AS BIGINT)")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 10, absorb: int = 50, top: int = 2000, budget: int = BUDGET,
) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score; by score, then
    occurrences, both falling, then phrase."""
    every, phrases, languages = count_phrases(docs, text=text, lang=lang, min_count=min_count, budget=budget)
    known = staged(every.where(F.col("f") >= min_count), "words")
    two, three = phrases.where("h3 = 0").drop("h3"), phrases.where("h3 <> 0")

    def word(k: int) -> DataFrame:
        return known.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))

    longer = three.select("h1", "h2", "a").unionByName(three.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a"))
    longer = longer.groupBy("h1", "h2").agg(F.max("a").alias("most"))
    pairs = two.join(longer, ["h1", "h2"], "left").where(F.expr(f"most IS NULL OR 100 * most < {absorb} * a"))
    pairs = pairs.join(word(1), "h1").join(word(2), "h2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"),
    )
    triples = three.join(two.withColumnRenamed("a", "f12"), ["h1", "h2"]).join(two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("f23")), ["h2", "h3"])
    triples = triples.join(word(1), "h1").join(word(2), "h2").join(word(3), "h3").withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    cut = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(cut, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(cut, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = pairs.unionByName(triples).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return found.join(languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
