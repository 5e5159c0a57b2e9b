"""Quality rules: base statistics of a text, and an n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams, one of trusted documents and one
of the whole corpus, are counted over all documents in one pass: each task sums into
``2**bucket_bits`` cells, and only cells are shuffled. A text's score is the mean log ratio
of its n-grams' probabilities, so long and short texts compare. Every document is judged
by the same fixed threshold; nothing is drawn by chance.

Words are runs of bytes other than ASCII white space. The n-grams of the ratio are words,
word pairs and pairs of word shapes; words are lower-cased, digits one sign. Shapes (kinds
of letters, digits and other signs, runs written once) are common even in a small corpus,
so noise shows before its words have been seen often.

Defined cases: a null or empty text has no words and fails the base rules; a text with
words always has a score; without trusted documents all ratios are 0; lines are cut at
\\n; repeated rows each count. A row's statistics never depend on its batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trustweave.llm.batches import name, small_batches, with_text_columns
from trustweave.llm.text import SPACE, Texts, Words, byte_class, chunks, constants, mix, windows, words

#: Fixed by the rules: signs that count as symbols.
SYMBOLS = byte_class(*b"#*$%&|<>")
NEWLINE = byte_class(0x0A)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _row_sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values by row: which equal an earlier one of their row, and which any other."""
    n = len(key)
    later, any_other = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        both = mix(key + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        later[order[1:]] = same
        any_other[order[1:]] |= same
        any_other[order[:-1]] |= same
    return later, any_other


def base_statistics(t: Texts) -> tuple[Words, np.ndarray]:
    """The words of some texts, and rows of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(t, SPACE)
    out = np.zeros((t.n, 5), np.int64)
    if len(t.data) == 0:
        return w, out
    out[:, 0] = w.counts(t.n)
    first_bytes = (t.data & 0xC0) != 0x80
    out[:, 1] = _row_sums(first_bytes & ~SPACE[t.data], t.bounds)
    out[:, 2] = _row_sums(SYMBOLS[t.data], t.bounds)
    lines = words(t, NEWLINE)  # a line without any byte has no word
    filled = np.concatenate([[0], np.cumsum(~SPACE[t.data])])
    has_word = filled[lines.end] > filled[lines.start]
    later, _ = _repeats(lines.hash[has_word], lines.row[has_word])
    out[:, 3] = np.bincount(lines.row[has_word][later], minlength=t.n)
    triples, at = windows(w.hash, w.row, 3, 41)
    _, twice = _repeats(triples, w.row[at])
    covered = np.zeros(len(w.hash), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    out[:, 4] = np.bincount(w.row[covered], minlength=t.n)
    return w, out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LOWER[0x30:0x3A] = 0x30
#: A word's shape: capitals, other letters and digits are one sign each.
_SHAPE = _LOWER.copy()
_SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 0x61
_SHAPE[0x41:0x5B] = 0x41


def shapes(t: Texts) -> Texts:
    """The texts with letters and digits by kind, runs of one sign written once."""
    kind = _SHAPE[t.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    inner = t.bounds[:-1]
    keep[inner[inner < len(kind)]] = True
    return Texts(kind[keep], np.concatenate([[0], np.cumsum(keep)])[t.bounds], t.first)


def buckets(t: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, word pair and pair of shapes, and their rows."""
    w = words(Texts(_LOWER[t.data], t.bounds, t.first), SPACE)
    pairs, at = windows(w.hash, w.row, 2, 43)
    v = words(shapes(t), SPACE)
    shape_pairs, shape_at = windows(v.hash, v.row, 2, 44)
    hashed = np.concatenate([mix(w.hash * constants(1, 45)[0]), pairs, shape_pairs])
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([w.row, w.row[at], v.row[shape_at]])


def fit_ratio(docs: DataFrame, trusted: Column, *, text: str = "text", bucket_bits: int = 16, prior: float = 5.0) -> np.ndarray:
    """Log ratio of each bucket: its count in trusted documents against that expected from
    all documents, both raised by ``prior``, so that rare n-grams say little."""
    small_batches(docs.sparkSession)
    rows = docs.select(name(text).cast("string").alias("text"), F.coalesce(trusted.cast("boolean"), F.lit(False)).alias("trusted")).where("text IS NOT NULL")
    size = 1 << bucket_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for t in chunks(batch.column(0)):
                bucket, row = buckets(t, bucket_bits)
                total[0] += np.bincount(bucket, minlength=size)
                total[1] += np.bincount(bucket[good[t.first + row]], minlength=size)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "n": total[0][at], "good": total[1][at]}, pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("good", pa.int64())]))

    sums = rows.mapInArrow(count, "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    found = np.array(sums.collect(), np.int64).reshape(-1, 3)  # at most 2**bucket_bits rows
    return log_ratio(found[:, 0], found[:, 1], found[:, 2], size, prior)


def log_ratio(bucket: np.ndarray, n: np.ndarray, good: np.ndarray, size: int, prior: float) -> np.ndarray:
    out = np.zeros(size, np.float32)
    if good.sum():
        out[bucket] = np.log((good + prior) / (n * (good.sum() / n.sum()) + prior))
    return out


def judge(
    docs: DataFrame, ratio: np.ndarray, *, text: str = "text", columns: Sequence[str] | None = None, threshold: float = -0.15,
) -> DataFrame:
    """Append the base statistics, ``base_failed``, ``score`` and ``kept`` to ``columns``."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        weights = shared.value
        bits = len(weights).bit_length() - 1

        def compute(column: pa.Array) -> list[pa.Array]:
            stats, scores = [np.zeros((0, 5), np.int64)], [np.zeros(0)]
            for t in chunks(column):
                stats.append(base_statistics(t)[1])
                bucket, row = buckets(t, bits)
                n = np.bincount(row, minlength=t.n)
                scores.append(np.bincount(row, weights[bucket], minlength=t.n) / np.maximum(n, 1))
            table = np.concatenate(stats)
            return [*[pa.array(np.ascontiguousarray(table[:, k])) for k in range(5)], pa.array(np.concatenate(scores))]

        return compute

    made = with_text_columns(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double", text=text, columns=columns)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
