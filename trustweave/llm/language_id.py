"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier for each bit says from hashed byte
n-grams whether a text's language has that bit set. Decoding picks the codeword with the
least weighted loss against all margins, so single wrong bits are outvoted.

Learning counts n-grams of every training text, by language, in one pass of partial sums
(``languages x 2**bucket_bits`` cells at most reach the driver, whatever the corpus).
A bit's classifier is the mean log ratio between the n-gram distributions of the
languages with the bit and those without, each language weighing the same. A bit's
weight is the Jensen-Shannon distance between its two sides.

Prediction uses the whole text and nothing but the text. Defined cases: a null text or
one without a letter is ``und`` with score 0; a text too short for one n-gram takes the
codeword of the even margins, flagged ambiguous; ties go to the first language in order.
Without any training text every document is ``und``. Repeated rows count each time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trustweave.llm.batches import name, small_batches, with_text_columns
from trustweave.llm.text import byte_class, chunks, constants, mix

UNDETERMINED = "und"
#: Bytes of one n-gram.
GRAM = 3
#: Most languages that a model may have; learning raises beyond.
MAX_LANGUAGES = 200
#: How fast the score falls with the loss; a lead of 1 over one rival gives 0.73.
SHARPNESS = 1.0

_LETTER = byte_class(range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_FOLD[0x41:0x5B] += 0x20


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1, one row each, columns neither constant nor alike.

    Up to five languages get all different splits; more get words drawn by hash, each
    the farthest of 64 candidates from those before.
    """
    if n <= 5:
        splits = [s for s in itertools.product((-1, 1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.float32).reshape(-1, n).T if n > 1 else np.ones((n, 1), np.float32)
    length = max(15, int(np.ceil(8 * np.log2(n))))
    drawn = np.where(mix(constants(64 * n * length, 11)) >> np.uint64(63), 1, -1).reshape(64 * n, length)
    chosen = [drawn[0]]
    for k in range(1, n):
        some = drawn[64 * k:64 * k + 64]
        chosen.append(some[(some[:, None] != np.array(chosen)[None]).sum(2).min(1).argmax()])
    code = np.array(chosen, np.float32)
    return code[:, (code.min(0) < 0) & (code.max(0) > 0)]


def grams(texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte n-gram in order, and row bounds. Letters fold ASCII case; runs of
    other characters count as one space would, so digits and symbols say nothing."""
    folded = _FOLD[texts.data]
    if len(folded) < GRAM:
        return np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64)
    code = folded[:-2].astype(np.uint32) | folded[1:-1].astype(np.uint32) << np.uint32(8) | folded[2:].astype(np.uint32) << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    row_of_first = np.repeat(np.arange(texts.n), np.diff(texts.bounds))
    keep = (row_of_first[:-2] == row_of_first[2:]) & ~((folded[:-2] == 0x20) & (folded[1:-1] == 0x20)) & ~((folded[1:-1] == 0x20) & (folded[2:] == 0x20))
    return bucket[keep].astype(np.int64), np.searchsorted(row_of_first[:-2][keep], np.arange(texts.n + 1))


#: N-grams from which a text without a near codeword is undecided.
ENOUGH = 8


class Model:
    """Codewords, bit classifiers and bit weights."""

    def __init__(self, languages: list[str], weights: np.ndarray, reliability: np.ndarray, bits: int):
        self.languages, self.weights, self.reliability, self.bits = languages, weights, reliability, bits
        self.code = codewords(len(languages))

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray, bits: int) -> Model:
        """counts: languages x buckets."""
        smooth = counts + 0.5
        share = smooth / smooth.sum(1, keepdims=True)
        code = codewords(len(languages))
        sides = [np.stack([share[code[:, b] == s].mean(0) if (code[:, b] == s).any() else share.mean(0) for b in range(code.shape[1])]) for s in (1, -1)]
        middle = (sides[0] + sides[1]) / 2
        apart = sum((s * np.log(s / middle)).sum(1) for s in sides) / 2
        return cls(languages, np.log(sides[0] / sides[1]).T.astype(np.float32), np.sqrt(np.maximum(apart, 1e-9)), bits)

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio of each text and bit, and the number of n-grams."""
        parts, sizes = [np.zeros((0, self.weights.shape[1]))], [np.zeros(0, np.int64)]
        for texts in chunks(column):
            bucket, bounds = grams(texts, self.bits)
            n = np.diff(bounds)
            total = np.zeros((texts.n, self.weights.shape[1]))
            full = np.flatnonzero(n)
            if len(full):
                total[full] = np.add.reduceat(self.weights[bucket], bounds[full], axis=0, dtype=np.float64) / n[full, None]
            parts.append(total)
            sizes.append(n)
        return np.concatenate(parts), np.concatenate(sizes)

    def decode(self, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score in 0..1, the lead of the best loss over the next, and the best loss
        (log 2 for margins that say nothing)."""
        evidence = margins * np.sqrt(n)[:, None]
        loss = np.zeros((len(margins), len(self.languages)))
        weight = self.reliability / self.reliability.sum()
        for b in range(self.code.shape[1]):
            loss += weight[b] * np.logaddexp(0, -evidence[:, b:b + 1] * self.code[None, :, b])
        order = np.sort(loss, 1)
        lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        closeness = np.exp(-SHARPNESS * (loss - order[:, :1]))
        return loss.argmin(1), 1 / closeness.sum(1), lead, order[:, 0]


def fit(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", bucket_bits: int = 15,
) -> Model | None:
    """Learn from every row with a text and a language; None if there is none."""
    small_batches(docs.sparkSession)
    rows = docs.select(name(text).cast("string").alias("text"), name(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for t in chunks(batch.column(0)):
                bucket, bounds = grams(t, bucket_bits)
                own = langs[t.first:t.first + t.n]
                per_gram = np.repeat(np.arange(t.n), np.diff(bounds))
                for x in set(own):
                    if x not in seen:
                        seen[x] = np.zeros(1 << bucket_bits, np.int64)
                    seen[x] += np.bincount(bucket[(own == x)[per_gram]], minlength=1 << bucket_bits)
        for x, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": [x] * len(at), "bucket": at.astype(np.int32), "n": c[at]}, pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    blocks = sums.groupBy("lang", F.shiftright("bucket", 8).alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    found = blocks.limit(MAX_LANGUAGES * (1 << bucket_bits - 8) + 1).collect()
    languages = sorted({r["lang"] for r in found})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return None
    counts = np.zeros((len(languages), 1 << bucket_bits))
    for r in found:
        cells = np.array(r["cells"], np.int64).reshape(-1, 2)
        counts[languages.index(r["lang"]), cells[:, 0]] = cells[:, 1]
    return Model.fit(languages, counts, bucket_bits)


def predict(
    docs: DataFrame, model: Model | None, *, text: str = "text", columns: Sequence[str] | None = None, min_lead: float = 0.002,
) -> DataFrame:
    """Append ``lang_pred``, ``score``, ``ambiguous`` (the best two codewords are nearly as
    close) and ``undecided``: the text has ``ENOUGH`` n-grams or more, and yet no codeword's loss
    is below half of that of margins that say nothing, so it is of none of the languages.
    Not all such texts are seen: n-grams that training lacks lean to the languages with less of
    it, so shorter noise, or any with two languages and little training, may seem decided.
    Without two languages to tell apart nothing is undecided."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def compute(column: pa.Array) -> list[pa.Array]:
            if m is None:
                return [pa.array([UNDETERMINED] * len(column)), pa.array(np.zeros(len(column))), pa.array(np.ones(len(column), bool)), pa.array(np.zeros(len(column), bool))]
            margins, n = m.margins(column)
            best, score, lead, loss = m.decode(margins, n)
            undecided = (n >= ENOUGH) & (loss > np.log(2) / 2) & (len(m.languages) > 1)
            return [pa.array([m.languages[k] for k in best], pa.string()), pa.array(score), pa.array(lead < min_lead), pa.array(undecided)]

        return compute

    letter = F.coalesce(name(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    out = with_text_columns(docs, make, "lang_pred string, score double, ambiguous boolean, undecided boolean", text=text, columns=columns, before={"__letter": letter})
    return out.withColumns({
        "lang_pred": F.when(F.col("__letter"), F.col("lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(F.col("__letter") & (F.col("lang_pred") != UNDETERMINED), F.col("score")).otherwise(0.0),
        "ambiguous": F.col("ambiguous") | ~F.col("__letter"),
    }).drop("__letter")


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds
